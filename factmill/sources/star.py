"""The supplied star schema, events, documents and labels as tables of the fact model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import relation_id


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _entity(df: DataFrame, kind: str, prefix: str, key: str, name, qualified, file, line, end, signature=None, doc=None, modifiers=None, updated=None) -> DataFrame:
    text = lambda x: F.lit(None).cast("string") if x is None else x
    return df.select(
        F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("id"),
        F.lit(kind).alias("type"),
        name.alias("name"),
        qualified.alias("qualified_name"),
        text(signature).alias("signature"),
        file.alias("file"),
        line.cast("long").alias("start_line"),
        end.cast("long").alias("end_line"),
        text(doc).alias("doc_comment"),
        text(modifiers).alias("modifiers"),
        (F.lit("1992-01-01 00:00:00").cast("timestamp_ntz") if updated is None else updated).alias("updated_at"),
    )


def places(spark: SparkSession, d: str) -> DataFrame:
    """Nations with the qualified name of each; a table of fixed size."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_regionkey", "r_name", F.concat_ws(".", "r_name", "n_name").alias("place"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations, customers, suppliers, parts and orders as entities."""
    place = places(spark, d)
    region = table(spark, d, "region")
    customer = table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("q", F.concat_ws(".", "place", "c_name"))
    supplier = table(spark, d, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    part = table(spark, d, "part")
    order = table(spark, d, "orders").join(customer.select("c_custkey", "q", "r_name"), F.col("o_custkey") == F.col("c_custkey"))
    one = F.lit(1)
    parts = [
        _entity(region, "Module", "region", "r_regionkey", F.col("r_name"), F.col("r_name"), F.lit("regions"), F.col("r_regionkey") + 1, F.col("r_regionkey") + 2),
        _entity(place, "Namespace", "nation", "n_nationkey", F.col("n_name"), F.col("place"), F.col("r_name"), one, F.lit(1000001)),
        _entity(customer, "Class", "customer", "c_custkey", F.col("c_name"), F.col("q"), F.col("r_name"), F.col("c_custkey") * 10, F.col("c_custkey") * 10 + 10,
                doc=F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")), modifiers=F.lit("public")),
        _entity(supplier, "Interface", "supplier", "s_suppkey", F.col("s_name"), F.concat_ws(".", "place", "s_name"), F.col("r_name"), F.col("s_suppkey") * 10, F.col("s_suppkey") * 10 + 5),
        _entity(part, "Enum", "part", "p_partkey", F.col("p_name"), F.concat_ws(".", F.lit("part"), "p_brand", F.col("p_partkey").cast("string")), F.lit("parts"), F.col("p_partkey"), F.col("p_partkey") + 1, doc=F.col("p_type")),
        _entity(order, "Method", "order", "o_orderkey", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.concat(F.col("q"), F.lit(".o"), F.col("o_orderkey").cast("string")), F.col("r_name"),
                F.col("o_custkey") * 10 + F.col("o_orderkey") % 10, F.col("o_custkey") * 10 + F.col("o_orderkey") % 10 + 1,
                signature=F.concat(F.lit("("), F.repeat(F.lit("I"), F.col("o_orderkey").cast("int") % 4), F.lit(")V")),
                doc=F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")), modifiers=F.when(F.col("o_orderstatus") == "O", "public"), updated=F.col("o_orderdate")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ENTITIES_SQL = """
pl AS (SELECT n_nationkey, n_name, r_regionkey, r_name, r_name || '.' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
cu AS (SELECT *, place || '.' || c_name AS q FROM customer JOIN pl ON c_nationkey = n_nationkey),
e AS (
SELECT 'region:' || r_regionkey AS id, 'Module' AS type, r_name AS name, r_name AS qualified_name, CAST(NULL AS VARCHAR) AS signature, 'regions' AS file,
    CAST(r_regionkey + 1 AS BIGINT) AS start_line, CAST(r_regionkey + 2 AS BIGINT) AS end_line, CAST(NULL AS VARCHAR) AS doc_comment, CAST(NULL AS VARCHAR) AS modifiers, TIMESTAMP '1992-01-01 00:00:00' AS updated_at FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 'Namespace', n_name, place, NULL, r_name, 1, 1000001, NULL, NULL, TIMESTAMP '1992-01-01 00:00:00' FROM pl
UNION ALL SELECT 'customer:' || c_custkey, 'Class', c_name, q, NULL, r_name, c_custkey * 10, c_custkey * 10 + 10, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, 'public', TIMESTAMP '1992-01-01 00:00:00' FROM cu
UNION ALL SELECT 'supplier:' || s_suppkey, 'Interface', s_name, place || '.' || s_name, NULL, r_name, s_suppkey * 10, s_suppkey * 10 + 5, NULL, NULL, TIMESTAMP '1992-01-01 00:00:00' FROM supplier JOIN pl ON s_nationkey = n_nationkey
UNION ALL SELECT 'part:' || p_partkey, 'Enum', p_name, 'part.' || p_brand || '.' || p_partkey, NULL, 'parts', p_partkey, p_partkey + 1, p_type, NULL, TIMESTAMP '1992-01-01 00:00:00' FROM part
UNION ALL SELECT 'order:' || o_orderkey, 'Method', 'o' || o_orderkey, q || '.o' || o_orderkey, '(' || repeat('I', CAST(o_orderkey % 4 AS INTEGER)) || ')V', r_name,
    o_custkey * 10 + o_orderkey % 10, o_custkey * 10 + o_orderkey % 10 + 1, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, CASE WHEN o_orderstatus = 'O' THEN 'public' END, o_orderdate
    FROM orders JOIN cu ON o_custkey = c_custkey)"""


def relations(spark: SparkSession, d: str) -> DataFrame:
    """CONTAINS from region to order; CALLS of parts and REFERENCES to suppliers by the lines of orders."""
    node = lambda prefix, key: F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))
    one = F.lit(1).cast("long")

    def of(df, kind, source, target, line):
        return df.select(F.lit(kind).alias("type"), source.alias("source_id"), target.alias("target_id"), line.cast("long").alias("line"), one.alias("col"))

    nation, customer, supplier = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "supplier")
    order, line = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    parts = [
        of(nation, "CONTAINS", node("region", "n_regionkey"), node("nation", "n_nationkey"), F.col("n_nationkey")),
        of(customer, "CONTAINS", node("nation", "c_nationkey"), node("customer", "c_custkey"), F.col("c_custkey")),
        of(supplier, "CONTAINS", node("nation", "s_nationkey"), node("supplier", "s_suppkey"), F.col("s_suppkey")),
        of(order, "CONTAINS", node("customer", "o_custkey"), node("order", "o_orderkey"), F.col("o_orderkey")),
        of(line, "CALLS", node("order", "l_orderkey"), node("part", "l_partkey"), F.col("l_linenumber")),
        of(line, "REFERENCES", node("order", "l_orderkey"), node("supplier", "l_suppkey"), F.col("l_linenumber")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("id", relation_id(F.col("source_id"), F.col("type"), F.col("target_id"), F.col("line"), F.col("col")))


RELATIONS_SQL = """
r0 AS (
SELECT 'CONTAINS' AS type, 'region:' || n_regionkey AS source_id, 'nation:' || n_nationkey AS target_id, CAST(n_nationkey AS BIGINT) AS line FROM nation
UNION ALL SELECT 'CONTAINS', 'nation:' || c_nationkey, 'customer:' || c_custkey, c_custkey FROM customer
UNION ALL SELECT 'CONTAINS', 'nation:' || s_nationkey, 'supplier:' || s_suppkey, s_suppkey FROM supplier
UNION ALL SELECT 'CONTAINS', 'customer:' || o_custkey, 'order:' || o_orderkey, o_orderkey FROM orders
UNION ALL SELECT 'CALLS', 'order:' || l_orderkey, 'part:' || l_partkey, l_linenumber FROM lineitem
UNION ALL SELECT 'REFERENCES', 'order:' || l_orderkey, 'supplier:' || l_suppkey, l_linenumber FROM lineitem),
r AS (SELECT *, CAST(1 AS BIGINT) AS col, source_id || ':' || type || ':' || target_id || '@' || line || ':1' AS id FROM r0)"""


def project(spark: SparkSession, d: str, region: int = 0) -> tuple[DataFrame, DataFrame]:
    """One region as a project: its entities, and the relations that start in it.

    A target outside is external: the relation has no target_id, but the outside name in external_target.
    """
    name = table(spark, d, "region").filter(F.col("r_regionkey") == region).select(F.col("r_name").alias("own"))
    whole = entities(spark, d)
    inside = whole.join(F.broadcast(name), (F.col("file") == F.col("own")) | (F.col("id") == f"region:{region}"), "left_semi")  # one row
    starts, ends = inside.select(F.col("id").alias("source_id")), inside.select(F.col("id").alias("target_id"), F.lit(True).alias("own"))
    found = relations(spark, d).join(starts, "source_id", "left_semi").join(ends, "target_id", "left")
    target = F.when(F.col("own"), F.col("target_id"))
    found = found.select(
        relation_id(F.col("source_id"), F.col("type"), target, F.col("line"), F.col("col")).alias("id"),
        "type", "source_id", target.alias("target_id"), F.when(F.col("own").isNull(), F.col("target_id")).alias("external_target"), "line", "col",
    )
    return inside, found


PROJECT_SQL = f"""{ENTITIES_SQL}, {RELATIONS_SQL},
pe AS (SELECT * FROM e WHERE id = 'region:0' OR file = (SELECT r_name FROM region WHERE r_regionkey = 0)),
pr AS (SELECT r.source_id || ':' || r.type || ':' || coalesce(t.id, 'ext') || '@' || r.line || ':1' AS id, r.type, r.source_id, t.id AS target_id,
    CASE WHEN t.id IS NULL THEN r.target_id END AS external_target, r.line, r.col
    FROM r JOIN pe s ON s.id = r.source_id LEFT JOIN pe t ON t.id = r.target_id)"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files before and after: documents by path and checksum, and an older state made from them."""
    docs = table(spark, d, "documents")
    new = docs.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("checksum"))
    old = new.filter("doc_id % 10 <> 0").select("doc_id", "path", F.when(F.col("doc_id") % 7 == 0, F.reverse("checksum")).otherwise(F.col("checksum")).alias("checksum"))
    ghosts = new.filter("doc_id % 13 = 0").select(F.col("doc_id"), F.concat(F.lit("gone/"), F.col("doc_id").cast("string")).alias("path"), "checksum")
    return old.unionByName(ghosts), new


SNAPSHOTS_SQL = """
new AS (SELECT doc_id, source || '/' || doc_id AS path, sha256(text) AS checksum FROM documents),
old AS (SELECT doc_id, path, CASE WHEN doc_id % 7 = 0 THEN reverse(checksum) ELSE checksum END AS checksum FROM new WHERE doc_id % 10 <> 0
    UNION ALL SELECT doc_id, 'gone/' || doc_id, checksum FROM new WHERE doc_id % 13 = 0)"""


def insights(spark: SparkSession, d: str) -> DataFrame:
    """An insight for every labelled document."""
    label = table(spark, d, "labels")
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("pending")
    return label.select(
        F.concat(F.lit("insight:"), F.col("doc_id").cast("string")).alias("id"),
        F.col("doc_id").alias("entity"),
        F.when(F.col("doc_id") % 2 == 0, "summary").otherwise("tech_debt").alias("kind"),
        status.alias("status"),
        (F.col("doc_id") % 100 / 100).alias("confidence"),
    )


INSIGHTS_SQL = """
ins AS (SELECT 'insight:' || doc_id AS id, doc_id AS entity, CASE WHEN doc_id % 2 = 0 THEN 'summary' ELSE 'tech_debt' END AS kind,
    CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'pending' END AS status, CAST(doc_id % 100 AS DOUBLE) / 100 AS confidence FROM labels)"""


def audits(spark: SparkSession, d: str) -> DataFrame:
    """Events as audit records: a user's events act on one insight."""
    # fixed values: which event stands for which action
    action = F.create_map(*(F.lit(x) for pair in {"signup": "create", "purchase": "approve", "error": "reject", "click": "modify", "view": "degrade"}.items() for x in pair))
    return table(spark, d, "events").select(
        F.col("event_id"), F.col("ts").alias("at"), F.concat(F.lit("project-"), (F.col("user_id") % 10).cast("string")).alias("project_id"),
        F.concat(F.lit("insight:"), F.col("user_id").cast("string")).alias("insight_id"), action[F.col("event_type")].alias("action"), "value", "event_type",
    )


AUDITS_SQL = """
au AS (SELECT event_id, ts AS moment, 'project-' || (user_id % 10) AS project_id, 'insight:' || user_id AS insight_id,
    CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'modify' WHEN 'view' THEN 'degrade' END AS action, value, event_type FROM events)"""
