"""Sections, diagrams and their references, as rows of text in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import node_name, safe, short_name, template
from ..sources.tables import cut
from .intervals import members_by_prefix

DOCUMENTED = ("Class", "Interface", "Enum", "Annotation")
NODE_LIMIT = 200


def joined(rows: DataFrame, text: Column, order: list[str], group: list[str] = ()) -> DataFrame:
    """One text a group: the lines in order."""
    line = F.array_sort(F.collect_list(F.struct(*order, text.alias("__line"))))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(line, lambda x: x["__line"]), "\n").alias("content"))


def architecture(entities: DataFrame) -> DataFrame:
    """(id, line): a table row for each documented type."""
    types = entities.filter(F.col("type").isin(*DOCUMENTED))
    return types.select("id", template("| ${type} | `${name}` | ${doc} |", type=F.col("type"), name=F.col("qualified_name"), doc=F.col("doc_comment")).alias("line"))


def counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(content): how many documented types and relations there are."""
    rows = entities.filter(F.col("type").isin(*DOCUMENTED)).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("m"))
    rows = rows.unionByName(relations.agg(F.lit(0).alias("n"), F.count(F.lit(1)).alias("m"))).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return rows.select(F.concat(F.col("n").cast("string"), F.lit(" types, "), F.col("m").cast("string"), F.lit(" relations\n")).alias("content"))


def modules(entities: DataFrame) -> DataFrame:
    return entities.filter(F.col("type").isin(*DOCUMENTED)).select("id", template("- `${name}`", name=F.col("qualified_name")).alias("line"))


def api(entities: DataFrame) -> DataFrame:
    """(owner_name, id, line): the methods and constructors of each documented type."""
    types = entities.filter(F.col("type").isin(*DOCUMENTED))
    methods = entities.filter(F.col("type").isin("Method", "Constructor"))
    held = members_by_prefix(types.select("id", "qualified_name"), methods.select("id", "qualified_name"))
    rows = held.join(methods.select(F.col("id").alias("member"), "signature", "doc_comment"), "member")
    return rows.select("owner_name", F.col("member").alias("id"), template("- **${name}  ${sig}** — ${doc}", name=F.col("member_name"), sig=F.col("signature"), doc=F.col("doc_comment")).alias("line"))


def data_dictionary(fields: DataFrame) -> DataFrame:
    """``fields``: (id, qualified_name, type_name)."""
    return fields.select("id", template("| `${name}` | `${type}` |", name=F.col("qualified_name"), type=F.col("type_name")).alias("line"))


def call_graph(relations: DataFrame, limit: int = NODE_LIMIT, skipped: int = 0) -> DataFrame:
    """(number, line): the first ``limit`` calls of a diagram, by id; a note where templates were skipped."""
    order = [c for c in ("id", "target_id", "external_target") if c in relations.columns]
    calls = relations.filter(F.col("type") == "CALLS").orderBy(*(F.col(c).asc_nulls_last() for c in order)).limit(limit)
    target = F.coalesce("target_id", "external_target", F.lit("external")) if "external_target" in relations.columns else F.coalesce("target_id", F.lit("external"))
    rows = calls.select(F.row_number().over(Window.orderBy(*(F.col(c).asc_nulls_last() for c in order))).alias("number"), F.concat(node_name(F.col("source_id")), F.lit(" --> "), node_name(target)).alias("line"))
    if skipped:
        note = relations.sparkSession.createDataFrame([(limit + 1, f"note: calls are incomplete, {skipped} template instantiations were skipped")], "number int, line string")
        rows = rows.unionByName(note)
    return rows


def class_diagram(entities: DataFrame, relations: DataFrame, limit: int = NODE_LIMIT) -> DataFrame:
    """(section, place, line): classes with their members, types and members counting against ``limit``; then inheritance.

    The arrow points from child to parent, `parent <|-- child`.
    """
    types = entities.filter(F.col("type").isin("Class", "Interface", "Enum"))
    types = types.groupBy("qualified_name").agg(F.min_by(F.struct("id", "name"), "id").alias("t")).select("qualified_name", "t.id", "t.name")
    members = entities.filter(F.col("type").isin("Method", "Field", "Constructor"))
    held = members_by_prefix(types.select("id", "qualified_name"), members.select("id", "qualified_name"))
    shown = held.join(members.select(F.col("id").alias("member"), "name", "type"), "member")
    text = F.when(F.col("type") == "Field", safe(F.col("name"))).otherwise(F.concat(safe(F.col("name")), F.lit("()")))
    rows = types.select(F.col("qualified_name").alias("owner"), F.lit(0).alias("kind"), F.col("id").alias("key"), F.concat(F.lit("class "), safe(F.col("name"))).alias("line"))
    rows = rows.unionByName(shown.select(F.col("owner_name").alias("owner"), F.lit(1).alias("kind"), F.col("member").alias("key"), text.alias("line")))
    first = rows.orderBy("owner", "kind", "key").limit(limit)
    first = first.select(F.lit("classes").alias("section"), F.row_number().over(Window.orderBy("owner", "kind", "key")).alias("place"), "line")
    arrow = F.when(F.col("type") == "INHERITS", " <|-- ").when(F.col("type") == "IMPLEMENTS", " <|.. ")
    target = F.coalesce("target_id", "external_target") if "external_target" in relations.columns else F.col("target_id")
    edges = relations.filter(F.col("type").isin("INHERITS", "IMPLEMENTS")).select(F.lit("edges").alias("section"), F.col("id"), F.concat(short_name(target), arrow, short_name(F.col("source_id"))).alias("line"))
    return first.unionByName(edges.groupBy("section", "line").agg(F.min("id").alias("id")).select("section", F.lit(0).alias("place"), "line"))


def linked(sections: DataFrame, entities: DataFrame) -> DataFrame:
    """``sections`` (section, content) with each backquoted qualified name of one entity made a link to its id.

    Names are looked up by a join, so neither the number of names nor that of sections matters.
    """
    parts = F.split("content", "`", -1)  # names are the odd parts
    asked = sections.select("section", F.posexplode(parts).alias("i", "part"))
    known = entities.groupBy(F.col("qualified_name").alias("part")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    found = asked.join(known.filter("part <> ''"), "part", "left")
    name = F.col("i") % 2 == 1
    text = F.when(name & F.col("id").isNotNull(), F.concat(F.lit("[`"), "part", F.lit("`](#"), "id", F.lit(")"))).when(name, F.concat(F.lit("`"), "part", F.lit("`"))).otherwise(F.col("part"))
    rows = F.array_sort(F.collect_list(F.struct("i", text.alias("text"))))
    made = found.groupBy("section").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("content"))
    return sections.drop("content").join(made, "section").select(*sections.columns)


def reference_failures(refs: DataFrame, evidence: DataFrame, entities: DataFrame, insights: DataFrame) -> DataFrame:
    """(section, failure): references to nothing, evidence outside its entity, and insights that are not approved.

    ``refs``: (section, ref); ``evidence``: (section, ref, line, col). A ref `insight:<id>` is looked up as an insight.
    """
    from .intervals import evidence_inside

    missing = refs.join(entities.select(F.col("id").alias("ref")), "ref", "left_anti").select("section", F.concat(F.lit("no entity: "), "ref").alias("failure"))
    is_insight = F.startswith("ref", F.lit("insight:"))
    held = evidence_inside(evidence.filter(~is_insight), entities).filter(F.col("verdict") != "inside")
    outside = held.select("section", F.concat(F.when(F.col("verdict") == "missing", "no evidence: ").otherwise("outside: "), "ref").alias("failure"))
    asked = evidence.filter(is_insight).select("section", "ref", F.substr("ref", F.lit(9)).alias("insight"))
    status = insights.select(F.col("id").alias("insight"), "status")
    open_ = asked.join(status, "insight", "left").filter(F.coalesce("status", F.lit("")) != "approved").select("section", F.concat(F.lit("not approved: "), "ref").alias("failure"))
    return missing.unionByName(outside).unionByName(open_)


def markdown(title: str, run: str, sections: DataFrame, failures: DataFrame) -> DataFrame:
    """(content): the document: title, sections in order, and an appendix of failed references.

    ``sections``: (section, heading, content); a document is as large as its sections, one row.
    """
    bad = joined(failures, F.concat(F.lit("- "), "failure"), ["failure"], ["section"]).withColumnRenamed("content", "bad").drop("n")
    both = sections.join(bad, "section", "left")
    text = F.concat(F.lit("## "), "heading", F.lit("\n\n"), "content", F.coalesce(F.concat(F.lit("\n\n> failed references\n"), "bad"), F.lit("")))
    body = joined(both, text, ["section"])
    return body.select(F.concat(F.lit(f"# {title}\n\n> run `{run}`\n\n"), "content").alias("content"))


def display_edges(entities: DataFrame, relations: DataFrame, kinds: tuple[str, ...], limit: int = 80) -> DataFrame:
    """Edges to draw: of the given kinds, once for each source, type and target, both ends among the first nodes."""
    nodes = entities.orderBy("id").limit(limit).select("id")
    found = relations.filter(F.col("type").isin(*kinds)).join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return found.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "type", "target_id").distinct()


#: The types that make the first and the second layer of a diagram; all others make the third.
LAYERS = (("Class", "Interface", "Struct", "Union", "Enum"), ("Method", "Function", "Constructor", "Destructor"))


def layout(entities: DataFrame, limit: int = 80) -> DataFrame:
    """(id, layer, place, layer_size, widest): where the first ``limit`` nodes stand, layer by layer, places from 0.

    ``widest`` is the size of the largest layer, at least 1.
    """
    first = entities.select("id", "type").filter("id is not null").orderBy("id").limit(limit)
    layer = F.when(F.col("type").isin(*LAYERS[0]), 0).when(F.col("type").isin(*LAYERS[1]), 1).otherwise(2)
    rows = first.withColumn("layer", layer)
    own = Window.partitionBy("layer")
    placed = rows.select("id", "layer", (F.row_number().over(own.orderBy("id")) - 1).alias("place"), F.count(F.lit(1)).over(own).alias("layer_size"))
    return placed.withColumn("widest", F.max("layer_size").over(Window.partitionBy()))  # of at most ``limit`` rows


def drawn(entities: DataFrame, relations: DataFrame, kinds: tuple[str, ...], limit: int = 80) -> DataFrame:
    """Edges to draw with the places of both ends: (source_id, type, target_id, from_layer, from_place, to_layer, to_place)."""
    at = layout(entities, limit)
    ends = display_edges(entities, relations, kinds, limit)
    for side, name in (("source_id", "from"), ("target_id", "to")):
        ends = ends.join(at.select(F.col("id").alias(side), F.col("layer").alias(f"{name}_layer"), F.col("place").alias(f"{name}_place")), side)
    return ends.select("source_id", "type", "target_id", "from_layer", "from_place", "to_layer", "to_place")


def made_again(sections: DataFrame, make: Callable[[DataFrame, int], DataFrame], failures: Callable[[DataFrame], DataFrame], most: int = 2) -> tuple[DataFrame, DataFrame]:
    """``sections`` (section, …) after those that fail were made again, at most ``most`` times; and the failures left.

    ``failures`` gives (section, failure) of some sections. Only failing sections are handed to ``make`` (with the number
    of the try and their ``failures``, an array), and only what it makes is checked anew; a section that it leaves out
    stays as it was. The result has ``tries``: how often a section was made again.
    """
    held = cut(sections.withColumn("tries", F.lit(0)))
    bad = cut(failures(sections))
    for n in range(1, most + 1):
        if bad.isEmpty():
            break
        why = bad.groupBy("section").agg(F.array_sort(F.collect_set("failure")).alias("failures"))
        fresh = cut(make(held.drop("tries").join(why, "section"), n).select(*sections.columns))
        untouched = bad.join(fresh.select("section"), "section", "left_anti")
        held = cut(held.join(fresh.select("section"), "section", "left_anti").unionByName(fresh.withColumn("tries", F.lit(n))))
        bad = cut(failures(fresh).unionByName(untouched))
    return held, bad

