"""Queries over the fact tables: filters, pages and point look-ups. Empty filters are no filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

PAGE = 1000
RUN_PAGE = 200


def _like(column: str, text: str):
    """Contains, whatever the case; `%` and `_` in the text are wildcards."""
    return F.col(column).ilike(f"%{text}%")


def search_entities(entities: DataFrame, kind: str | None = None, text: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of entities, the latest first; ties by id."""
    found = entities
    if kind:
        found = found.filter(F.col("type") == kind)
    if text:
        found = found.filter(_like("qualified_name", text) | _like("name", text))
    return found.orderBy(F.desc("updated_at"), "id").offset(max(0, offset)).limit(min(max(0, limit), PAGE))


def query_relations(relations: DataFrame, source: str | None = None, kind: str | None = None, external: str | None = None) -> DataFrame:
    """All relations that pass the filters, without a cap."""
    found = relations
    if source:
        found = found.filter(F.col("source_id") == source)
    if kind:
        found = found.filter(F.col("type") == kind)
    if external:
        found = found.filter(_like("external_target", external))
    return found


def by_id(df: DataFrame, value: str) -> DataFrame:
    return df.filter(F.col("id") == value)


def list_insights(insights: DataFrame, status: str | None = None, kind: str | None = None, entity=None, limit: int = PAGE, order: tuple = ("id",)) -> DataFrame:
    found = insights
    for column, value in (("status", status), ("kind", kind), ("entity", entity)):
        if value not in (None, ""):
            found = found.filter(F.col(column) == value)
    return found.orderBy(*order).limit(limit)


def list_audits(audits: DataFrame, insight: str | None = None) -> DataFrame:
    """The trail in order of time, of one insight or of all."""
    found = audits if not insight else audits.filter(F.col("insight_id") == insight)
    return found.orderBy("at", "event_id") if "event_id" in audits.columns else found.orderBy("at", "id")


def list_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "id").limit(min(max(1, limit), RUN_PAGE))


def live_projects(projects: DataFrame) -> DataFrame:
    return projects.filter(F.col("deleted_at").isNull()).orderBy("created_at", "id")


def archived(config) -> F.Column:
    return F.coalesce(F.get_json_object(config, "$.archived") == "true", F.lit(False))


def language(config) -> F.Column:
    """The language that a project's configuration names, java by default."""
    return F.coalesce(F.nullif(F.get_json_object(config, "$.language"), F.lit("")), F.lit("java"))


def type_counts(relations: DataFrame) -> DataFrame:
    return relations.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def file_lines(lines: DataFrame, key: str, number: str, text: str, first: int, last: int) -> DataFrame:
    """Lines ``first`` to ``last`` of each file, as one text; both ends are kept within the file."""
    size = lines.groupBy(key).agg(F.max(number).alias("__n"))
    kept = lines.join(size, key)
    low = F.greatest(F.lit(1), F.least(F.lit(first), F.col("__n")))
    high = F.greatest(F.lit(1), F.least(F.lit(last), F.col("__n")))
    kept = kept.filter(F.col(number).between(low, high))
    rows = F.array_sort(F.collect_list(F.struct(number, text)))
    return kept.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(rows, lambda x: x[text]), "\n").alias("content"))


def file_index(entities: DataFrame) -> DataFrame:
    """(file, place, id): the entities of each file, numbered from 1 by line and id.

    Rows are dealt by ranges, so that a file of any size is numbered by many tasks: within a range, and then from the
    counts of the ranges before.
    """
    ranges = cut(entities.select("file", "start_line", "id").repartitionByRange("file", "start_line", "id").withColumn("__range", F.spark_partition_id()))
    sizes = ranges.groupBy("file", "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("file").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("file", "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("file", "__range").orderBy("start_line", "id"))
    found = ranges.withColumn("__rank", rank).join(before, ["__range", "file"])
    return found.select("file", (F.col("__before") + F.col("__rank")).alias("place"), "id")


def symbol_table(entities: DataFrame) -> DataFrame:
    """(key, id): qualified names, with the signature if there is one; the first id holds a key."""
    key = F.when(F.coalesce(F.col("signature"), F.lit("")) != "", F.concat_ws("#", "qualified_name", "signature")).otherwise(F.col("qualified_name"))
    return entities.groupBy(key.alias("key")).agg(F.min("id").alias("id"))
