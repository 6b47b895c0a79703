"""The rules that a batch of facts must pass before it is stored. Each gives rows (code, severity, subject)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.descriptors import is_method_descriptor
from ..functions.values import blank
from ..model import SCHEMA_VERSION
from .graph import on_cycles

# The codes of the rules and their severities.
RULES = {
    "UCM.EMPTY_ID": "ERROR",
    "UCM.DUP_ID": "ERROR",
    "UCM.DANGLING_SOURCE": "ERROR",
    "UCM.DANGLING_TARGET": "ERROR",
    "UCM.EXT_MISSING": "ERROR",
    "UCM.VERSION_MISMATCH": "ERROR",
    "UCM.LOCATION_REQUIRED": "ERROR",
    "UCM.REL_ID_LOC_MISMATCH": "ERROR",
    "UCM.SIGNATURE_INVALID": "ERROR",
    "UCM.CONTAINS_CYCLE": "WARNING",
    "UCM.FILE_NOT_INDEXED": "WARNING",
    "UCM.TYPEREF_DANGLING": "WARNING",
    "UCM.TYPEREF_EXTERNAL_CONFLICT": "WARNING",
}


def issue(rows: DataFrame, code: str, subject) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(RULES[code]).alias("severity"), subject.alias("subject"))


def empty_ids(entities: DataFrame) -> DataFrame:
    return issue(entities.filter(blank(F.col("id")).isNull()), "UCM.EMPTY_ID", F.col("qualified_name"))


def duplicate_ids(entities: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Every row of an id after its first, with its ``number``."""
    held = Window.partitionBy("id").orderBy(*order)
    return entities.filter(blank(F.col("id")).isNotNull()).withColumn("number", F.row_number().over(held)).filter("number > 1")


def dangling_sources(relations: DataFrame, entities: DataFrame) -> DataFrame:
    found = relations.join(entities.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    return issue(found, "UCM.DANGLING_SOURCE", F.col("id"))


def dangling_targets(relations: DataFrame, entities: DataFrame) -> DataFrame:
    found = relations.filter(blank(F.col("target_id")).isNotNull()).join(entities.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return issue(found, "UCM.DANGLING_TARGET", F.col("id"))


def external_missing(relations: DataFrame) -> DataFrame:
    return issue(relations.filter(blank(F.col("target_id")).isNull() & blank(F.col("external_target")).isNull()), "UCM.EXT_MISSING", F.col("id"))


def version_mismatch(batches: DataFrame, expected: str = SCHEMA_VERSION) -> DataFrame:
    return issue(batches.filter(~F.col("schema_version").eqNullSafe(F.lit(expected))), "UCM.VERSION_MISMATCH", F.col("schema_version"))


def location_required(relations: DataFrame) -> DataFrame:
    return issue(relations.filter(F.col("line").isNull()), "UCM.LOCATION_REQUIRED", F.col("id"))


def place_mismatch(relations: DataFrame, anchored: bool = False) -> DataFrame:
    """Ids that do not hold their `@line:col`; ``anchored`` asks for it at the end, before any `#n`."""
    mark = F.concat(F.lit("@"), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"))
    held = F.regexp_replace("id", r"#[0-9]+$", "").endswith(mark) if anchored else F.contains("id", mark)
    return issue(relations.filter(F.col("line").isNotNull() & ~F.coalesce(held, F.lit(False))), "UCM.REL_ID_LOC_MISMATCH", F.col("id"))


def invalid_signatures(entities: DataFrame, strict: bool = False) -> DataFrame:
    asked = entities.filter(blank(F.col("signature")).isNotNull() & (F.col("language") == "Java"))
    return issue(asked.filter(~is_method_descriptor(F.col("signature"), strict)), "UCM.SIGNATURE_INVALID", F.col("id"))


def contains_cycles(relations: DataFrame) -> DataFrame:
    """Children on a CONTAINS cycle or below one (by first parents), and relations that contain their own source."""
    contains = relations.filter((F.col("type") == "CONTAINS") & F.col("target_id").isNotNull())
    loops = issue(contains.filter("source_id = target_id"), "UCM.CONTAINS_CYCLE", F.col("id"))
    edges = contains.filter("source_id <> target_id")
    parent = edges.groupBy(F.col("target_id").alias("child")).agg(F.min_by("source_id", "id").alias("parent"))
    return loops.unionByName(issue(on_cycles(parent), "UCM.CONTAINS_CYCLE", F.col("child")))


def files_not_indexed(entities: DataFrame, index: DataFrame) -> DataFrame:
    """``index``: (file, id). A file entity must stand there under its qualified name or its file."""
    files = entities.filter(F.col("type") == "File")
    held = index.select(F.col("file").alias("__file"), F.col("id").alias("__id"))
    found = files.join(held, (F.col("id") == F.col("__id")) & F.col("__file").isin(F.col("qualified_name"), F.col("file")), "left_anti")
    return issue(found, "UCM.FILE_NOT_INDEXED", F.col("id"))


def repaired_type_refs(entities: DataFrame, known: DataFrame) -> DataFrame:
    """``entities`` (id, ref_kind, ref_id, ref_external): a reference to nothing becomes unknown; ``code`` is its issue."""
    held = known.select(F.col("id").alias("ref_id"), F.lit(True).alias("__known"))
    joined = entities.join(held, "ref_id", "left")
    asked = blank(F.col("ref_id")).isNotNull()
    gone = asked & F.col("__known").isNull()
    code = F.when(gone, "UCM.TYPEREF_DANGLING").when(asked & F.col("ref_external"), "UCM.TYPEREF_EXTERNAL_CONFLICT")
    return joined.select("id", F.when(gone, "unknown").otherwise(F.col("ref_kind")).alias("ref_kind"), F.when(~gone, F.col("ref_id")).alias("ref_id"), "ref_external", code.alias("code"))


def validate(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """All rules over a batch in the columns of the model's tables, as (code, severity, subject)."""
    found = [
        empty_ids(entities),
        issue(duplicate_ids(entities, ("file", "start_line", "qualified_name")), "UCM.DUP_ID", F.col("id")),
        dangling_sources(relations, entities),
        dangling_targets(relations, entities),
        external_missing(relations),
        location_required(relations),
        place_mismatch(relations),
        contains_cycles(relations),
    ]
    if "language" in entities.columns:
        found.append(invalid_signatures(entities))
    return reduce(DataFrame.unionByName, found)


def blocked(issues: DataFrame) -> bool:
    """Whether an error forbids to store the batch."""
    return not issues.filter(F.col("severity") == "ERROR").isEmpty()
