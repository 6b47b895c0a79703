"""The queries of the fact engine over the supplied tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import descriptors, ids, insights as marks, names
from ..functions.locations import contains, location_text
from ..functions.values import clamp
from ..operators import diff, documents, facts, graph, insights, intervals, merge, validate
from ..sources import star

E, R, P, S, I, A = star.ENTITIES_SQL, star.RELATIONS_SQL, star.PROJECT_SQL, star.SNAPSHOTS_SQL, star.INSIGHTS_SQL, star.AUDITS_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def held(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return held


# --- graph -----------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {P},
st AS (SELECT source_id, coalesce(target_id, 'ext:' || external_target) AS id, target_id IS NOT NULL AS inside FROM pr),
b AS (SELECT 'region:0' AS id, 0 AS distance, TRUE AS inside UNION SELECT st.id, b.distance + 1, st.inside FROM b JOIN st ON st.source_id = b.id WHERE b.distance < 4 AND b.inside)
SELECT id, CASE WHEN bool_or(inside) THEN 'entity' ELSE 'external' END AS kind, CAST(min(distance) AS INTEGER) AS distance FROM b GROUP BY id""")
def subgraph_bfs(spark: SparkSession, d: str) -> DataFrame:
    entities, relations = star.project(spark, d)
    return graph.subgraph(entities, relations, "region:0", 4)[0]


@query(f"""WITH {P} SELECT id, source_id, target_id, external_target FROM pr WHERE source_id = 'region:0' OR source_id IN (SELECT target_id FROM pr WHERE source_id = 'region:0')""")
def subgraph_edges(spark, d):
    entities, relations = star.project(spark, d)
    return graph.subgraph(entities, relations, "region:0", 2)[1].select("id", "source_id", "target_id", "external_target")


@query(f"""WITH {P} SELECT external_target, count(*) AS n FROM pr WHERE target_id IS NULL GROUP BY external_target ORDER BY n DESC, external_target LIMIT 1000""")
def external_top_targets(spark, d):
    return graph.top_external(star.project(spark, d)[1])


_EDGES = "ed AS (SELECT 'd' || doc_id AS child, 'd' || CASE WHEN doc_id % 50 = 7 THEN doc_id + 1 WHEN doc_id % 50 = 8 THEN doc_id - 1 ELSE doc_id // 2 END AS parent FROM documents WHERE doc_id > 0)"


def _parents(spark, d):
    doc = star.table(spark, d, "documents").select("doc_id").filter("doc_id > 0")
    parent = F.when(F.col("doc_id") % 50 == 7, F.col("doc_id") + 1).when(F.col("doc_id") % 50 == 8, F.col("doc_id") - 1).otherwise(F.floor(F.col("doc_id") / 2))
    return doc.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("child"), F.concat(F.lit("d"), parent.cast("string")).alias("parent"))


@query(f"""WITH RECURSIVE {_EDGES}, w AS (SELECT child, parent AS at, 1 AS n FROM ed UNION ALL SELECT w.child, ed.parent, n + 1 FROM w JOIN ed ON w.at = ed.child WHERE n < 40)
SELECT DISTINCT child FROM w WHERE n = 40""")
def contains_cycle(spark, d):
    return graph.on_cycles(_parents(spark, d))


@query(f"""WITH {E}, {R}, f AS (SELECT target_id, count(*) AS n FROM r GROUP BY target_id)
SELECT e.id, coalesce(f.n, 0) AS fan_in FROM e LEFT JOIN f ON f.target_id = e.id""")
def fan_in(spark, d):
    return graph.fan_in(star.entities(spark, d).select("id"), star.relations(spark, d))


@query(f"""WITH {E}, {R}, m AS (SELECT id, split_part(qualified_name, '.', 2) AS module FROM e)
SELECT a.module AS source_id, b.module AS target_id, count(*) AS n FROM r JOIN m a ON a.id = r.source_id JOIN m b ON b.id = r.target_id WHERE a.module <> b.module GROUP BY a.module, b.module""")
def module_fold(spark, d):
    module = F.coalesce(F.get(F.split("qualified_name", r"\."), F.lit(1)), F.lit(""))
    return graph.folded(star.relations(spark, d), star.entities(spark, d).select("id", module.alias("module")))


@query("""WITH RECURSIVE m AS (SELECT 'm' || p_partkey AS id, p_partkey AS owner, p_brand || p_size AS key FROM part),
p AS (SELECT p_partkey AS child, p_partkey // 2 AS parent, 0 AS rank FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey // 3, 1 FROM part WHERE p_partkey > 3),
w AS (SELECT id, key, owner AS at, '' AS path, 0 AS n FROM m UNION ALL SELECT w.id, w.key, p.parent, w.path || lpad(CAST(p.rank AS VARCHAR), 4, '0'), n + 1 FROM w JOIN p ON p.child = w.at),
h AS (SELECT w.id, w.path, w.n, m.id AS target_id, row_number() OVER (PARTITION BY w.id ORDER BY w.n, w.path, m.id) AS k FROM w JOIN m ON m.owner = w.at AND m.key = w.key WHERE w.n > 0)
SELECT id, target_id FROM h WHERE k = 1""")
def first_overridden(spark, d):
    part = star.table(spark, d, "part")
    methods = part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("owner"), F.concat("p_brand", F.col("p_size").cast("string")).alias("key"))
    one = part.filter("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent"), F.lit(0).alias("rank"))
    two = part.filter("p_partkey > 3").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent"), F.lit(1).alias("rank"))
    return graph.first_overridden(methods, one.unionByName(two))


# --- facts -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {E} SELECT id, qualified_name, updated_at FROM e WHERE type = 'Method' AND (qualified_name ILIKE '%africa%' OR name ILIKE '%africa%') ORDER BY updated_at DESC, id LIMIT 100 OFFSET 50""")
def entity_search(spark, d):
    return facts.search_entities(star.entities(spark, d), "Method", "africa", 100, 50).select("id", "qualified_name", "updated_at")


@query(f"WITH {R} SELECT id, target_id, line FROM r WHERE type = 'CALLS' AND source_id = 'order:7'")
def relation_query(spark, d):
    return facts.query_relations(star.relations(spark, d), "order:7", "CALLS").select("id", "target_id", "line")


@query(f"WITH {P} SELECT id, external_target FROM pr WHERE external_target ILIKE '%r:1_'")
def relation_external_query(spark, d):
    return facts.query_relations(star.project(spark, d)[1], external="r:1_").filter(F.col("external_target").ilike("%r:1_")).select("id", "external_target")


@query(f"WITH {R} SELECT type, count(*) AS n FROM r GROUP BY type")
def relation_type_counts(spark, d):
    return facts.type_counts(star.relations(spark, d))


@query(f"WITH {E} SELECT id, name, qualified_name FROM e WHERE id = 'customer:42'")
def entity_by_id(spark, d):
    return facts.by_id(star.entities(spark, d), "customer:42").select("id", "name", "qualified_name")


@query(f"WITH {I} SELECT id, kind, status, confidence FROM ins WHERE status = 'approved' AND kind = 'summary' ORDER BY confidence DESC, id LIMIT 1000")
def insight_list(spark, d):
    return facts.list_insights(star.insights(spark, d), "approved", "summary", order=(F.desc("confidence"), F.col("id"))).select("id", "kind", "status", "confidence")


@query(f"WITH {A} SELECT event_id, moment, action FROM au WHERE insight_id = 'insight:3'")
def audit_trail(spark, d):
    return facts.list_audits(star.audits(spark, d), "insight:3").select("event_id", F.col("at").alias("moment"), "action")


@query("""SELECT o_orderkey AS id, o_orderdate AS started_at, o_orderstatus AS status FROM orders WHERE o_custkey % 10 = 1 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def run_list(spark, d):
    runs = star.table(spark, d, "orders").filter("o_custkey % 10 = 1").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"))
    return facts.list_runs(runs)


@query("""WITH n AS (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations JOIN n USING (conv_id)
WHERE turn BETWEEN greatest(1, least(2, n)) AND greatest(1, least(4, n)) GROUP BY conv_id""")
def file_slice(spark, d):
    return facts.file_lines(star.table(spark, d, "conversations"), "conv_id", "turn", "text", 2, 4)


@query(f"WITH {E} SELECT file, row_number() OVER (PARTITION BY file ORDER BY start_line, id) AS place, id FROM e")
def file_index(spark, d):
    return facts.file_index(star.entities(spark, d))


@query(f"WITH {E} SELECT CASE WHEN coalesce(signature, '') <> '' THEN qualified_name || '#' || signature ELSE qualified_name END AS key, min(id) AS id FROM e GROUP BY 1")
def symbol_table(spark, d):
    return facts.symbol_table(star.entities(spark, d))


# --- validation ------------------------------------------------------------------------------------------------------

_LINES = "ln AS (SELECT l_orderkey || ':' || l_linenumber AS id, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem)"


@query(f"""WITH {_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS number FROM ln)
SELECT id, l_partkey, CAST(number AS INTEGER) AS number FROM n WHERE number > 1""")
def dup_entity_ids(spark, d):
    line = star.table(spark, d, "lineitem").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return validate.duplicate_ids(line, ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).select("id", "l_partkey", "number")


def _faulty(spark, d):
    """Relations of orders with faults in them."""
    order = star.table(spark, d, "orders")
    target = F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")))
    line = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderkey") % 100)
    shown = F.when(F.col("o_orderkey") % 19 == 0, F.lit(1000000)).otherwise(F.coalesce(line, F.lit(0)))
    return order.select(
        ids.relation_id(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")), F.lit("REFERENCES"), target, shown, F.lit(1)).alias("id"), F.lit("REFERENCES").alias("type"),
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("source_id"), target.alias("target_id"),
        F.when((F.col("o_orderkey") % 11 == 0) & (F.col("o_orderkey") % 2 == 0), "outside").otherwise("").alias("external_target"), line.alias("line"), F.lit(1).alias("col"),
    )


_FAULTY = """fa0 AS (SELECT 'order:' || o_orderkey AS source_id, CASE WHEN o_orderkey % 11 <> 0 THEN 'customer:' || o_custkey END AS target_id,
    CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 2 = 0 THEN 'outside' ELSE '' END AS external_target, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 100 END AS line, o_orderkey FROM orders),
fa AS (SELECT *, source_id || ':REFERENCES:' || coalesce(target_id, 'ext') || '@' || CASE WHEN o_orderkey % 19 = 0 THEN 1000000 ELSE coalesce(line, 0) END || ':1' AS id FROM fa0)"""


@query(f"WITH {_FAULTY} SELECT 'UCM.EXT_MISSING' AS code, 'ERROR' AS severity, id AS subject FROM fa WHERE target_id IS NULL AND external_target = ''")
def external_missing(spark, d):
    return validate.external_missing(_faulty(spark, d))


@query(f"WITH {_FAULTY} SELECT 'UCM.LOCATION_REQUIRED' AS code, 'ERROR' AS severity, id AS subject FROM fa WHERE line IS NULL")
def location_required(spark, d):
    return validate.location_required(_faulty(spark, d))


@query(f"WITH {_FAULTY} SELECT 'UCM.REL_ID_LOC_MISMATCH' AS code, 'ERROR' AS severity, id AS subject FROM fa WHERE line IS NOT NULL AND NOT contains(id, '@' || line || ':1')")
def rel_id_mismatch(spark, d):
    return validate.place_mismatch(_faulty(spark, d))


@query(f"WITH {P}, {R.replace('r0 AS', 'q0 AS').replace('FROM r0', 'FROM q0').replace('r AS (', 'q AS (')} SELECT 'UCM.DANGLING_SOURCE' AS code, 'ERROR' AS severity, q.id AS subject FROM q WHERE q.source_id NOT IN (SELECT id FROM pe)")
def dangling_source(spark, d):
    return validate.dangling_sources(star.relations(spark, d), star.project(spark, d)[0])


@query(f"WITH {P}, {R.replace('r0 AS', 'q0 AS').replace('FROM r0', 'FROM q0').replace('r AS (', 'q AS (')} SELECT 'UCM.DANGLING_TARGET' AS code, 'ERROR' AS severity, q.id AS subject FROM q WHERE q.target_id NOT IN (SELECT id FROM pe)")
def dangling_target(spark, d):
    return validate.dangling_targets(star.relations(spark, d), star.project(spark, d)[0])


@query("""SELECT 'UCM.EMPTY_ID' AS code, 'ERROR' AS severity, p_name AS subject FROM part WHERE p_partkey % 23 = 0""")
def empty_id(spark, d):
    part = star.table(spark, d, "part").select(F.when(F.col("p_partkey") % 23 != 0, F.col("p_partkey").cast("string")).otherwise("").alias("id"), F.col("p_name").alias("qualified_name"))
    return validate.empty_ids(part)


@query("""SELECT 'UCM.VERSION_MISMATCH' AS code, 'ERROR' AS severity, '0.' || p_size AS subject FROM part WHERE p_partkey % 29 = 0""")
def version_mismatch(spark, d):
    part = star.table(spark, d, "part").select(F.when(F.col("p_partkey") % 29 == 0, F.concat(F.lit("0."), F.col("p_size").cast("string"))).otherwise("1.0").alias("schema_version"))
    return validate.version_mismatch(part)


@query("""WITH t AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, 'class' AS ref_kind, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_partkey END AS ref_id, l_partkey % 5 = 0 AS ref_external FROM lineitem)
SELECT t.id, CASE WHEN ref_id IS NOT NULL AND p.p_partkey IS NULL THEN 'unknown' ELSE ref_kind END AS ref_kind,
    CAST(CASE WHEN p.p_partkey IS NOT NULL THEN ref_id END AS VARCHAR) AS ref_id, ref_external,
    CASE WHEN ref_id IS NOT NULL AND p.p_partkey IS NULL THEN 'UCM.TYPEREF_DANGLING' WHEN ref_id IS NOT NULL AND ref_external THEN 'UCM.TYPEREF_EXTERNAL_CONFLICT' END AS code
FROM t LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0) p ON p.p_partkey = t.ref_id""")
def typeref_repair(spark, d):
    text = lambda c: F.col(c).cast("string")
    refs = star.table(spark, d, "lineitem").select(
        F.concat_ws(":", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey")).alias("id"), F.lit("class").alias("ref_kind"),
        F.when(F.col("l_linenumber") != 1, text("l_partkey")).alias("ref_id"), (F.col("l_partkey") % 5 == 0).alias("ref_external"),
    )
    known = star.table(spark, d, "part").filter("p_partkey % 3 <> 0").select(text("p_partkey").alias("id"))
    return validate.repaired_type_refs(refs, known)


_SIG = "CASE p_partkey % 6 WHEN 0 THEN '(I[JLa/b;)V' WHEN 1 THEN '([)V' WHEN 2 THEN '(V)I' WHEN 3 THEN '()Lx;' WHEN 4 THEN 'I' ELSE '(L;Z)[[D' END"


def _signatures(spark, d):
    # fixed values: well and ill formed signatures
    made = F.element_at(F.array(*(F.lit(x) for x in ("(I[JLa/b;)V", "([)V", "(V)I", "()Lx;", "I", "(L;Z)[[D"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return star.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), made.alias("signature"), F.lit("Java").alias("language"))


@query(f"SELECT 'UCM.SIGNATURE_INVALID' AS code, 'ERROR' AS severity, CAST(p_partkey AS VARCHAR) AS subject FROM part WHERE NOT regexp_matches({_SIG}, '^\\((\\[|[ZBCDFIJS]|L[^;)]*;)*\\)(V|\\[*([ZBCDFIJS]|L[^;]+;))$')")
def signature_validity(spark, d):
    return validate.invalid_signatures(_signatures(spark, d))


@query(f"SELECT 'UCM.SIGNATURE_INVALID' AS code, 'ERROR' AS severity, CAST(p_partkey AS VARCHAR) AS subject FROM part WHERE NOT regexp_matches({_SIG}, '^\\((\\[*([ZBCDFIJS]|L[^;]+;))*\\)(V|\\[*([ZBCDFIJS]|L[^;]+;))$')")
def signature_strict(spark, d):
    return validate.invalid_signatures(_signatures(spark, d), strict=True)


@query(f"WITH {E}, ix AS (SELECT file, id FROM e WHERE start_line % 7 <> 0) SELECT 'UCM.FILE_NOT_INDEXED' AS code, 'WARNING' AS severity, id AS subject FROM e WHERE type = 'Class' AND (file, id) NOT IN (SELECT file, id FROM ix)")
def file_not_indexed(spark, d):
    held = star.entities(spark, d)
    files = held.filter("type = 'Class'").withColumn("type", F.lit("File"))
    return validate.files_not_indexed(files, held.filter("start_line % 7 <> 0"))


# --- diff and merge --------------------------------------------------------------------------------------------------


@query(f"""WITH {S} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.checksum = n.checksum THEN 'same' ELSE 'changed' END AS change
FROM old o FULL JOIN new n ON o.path = n.path""")
def checksum_diff(spark, d):
    return diff.checksum_diff(*star.snapshots(spark, d))


_USES = "us AS (SELECT a.path AS user, b.path AS used FROM new a JOIN new b ON b.doc_id = a.doc_id // 2 WHERE a.doc_id > 1)"


def _uses(new):
    return new.filter("doc_id > 1").select(F.col("path").alias("user"), F.floor(F.col("doc_id") / 2).alias("doc_id")).join(new.select("doc_id", F.col("path").alias("used")), "doc_id").select("user", "used")


@query(f"""WITH RECURSIVE {S}, {_USES},
ch AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.checksum = n.checksum THEN 'same' ELSE 'changed' END AS change FROM old o FULL JOIN new n ON o.path = n.path),
re AS (SELECT path, 0 AS distance FROM ch WHERE change <> 'same' UNION SELECT us.user, distance + 1 FROM re JOIN us ON us.used = re.path WHERE distance < 2),
mi AS (SELECT path, min(distance) AS distance FROM re GROUP BY path)
SELECT n.path, CASE WHEN c.change <> 'same' THEN c.change ELSE 'dependent' END AS reason, CAST(m.distance AS INTEGER) AS distance FROM new n JOIN mi m ON m.path = n.path JOIN ch c ON c.path = n.path
UNION ALL SELECT path, 'deleted', 0 FROM ch WHERE change = 'deleted'""")
def affected_files(spark, d):
    old, new = star.snapshots(spark, d)
    return diff.plan(old.select("path", "checksum"), new.select("path", "checksum"), _uses(new), ratio=0.95)


@query(f"""WITH {S} SELECT n.path, 'full' AS reason, CAST(NULL AS INTEGER) AS distance FROM new n WHERE FALSE
UNION ALL SELECT path, 'full', NULL FROM new""")
def full_plan(spark, d):
    _, new = star.snapshots(spark, d)
    held = new.select("path", "checksum")
    return diff.plan(held, held, _uses(new), forced=True)


@query(f"""WITH {E}, {R}, f AS (SELECT target_id, count(*) AS n FROM r GROUP BY target_id), w AS (SELECT e.id, e.type, coalesce(f.n, 0) + 1 AS n FROM e LEFT JOIN f ON f.target_id = e.id)
SELECT CAST(sum(CASE WHEN type = 'Enum' THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS ratio, CAST(sum(CASE WHEN type = 'Enum' THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) > 0.3 AS "full" FROM w""")
def fan_in_weight_ratio(spark, d):
    held = star.entities(spark, d)
    return diff.weight_ratio(held, star.relations(spark, d), held.filter("type = 'Enum'").select("id"))


@query(f"""WITH {S}, t AS (SELECT path FROM old WHERE doc_id % 7 = 0 OR doc_id % 13 = 0), fr AS (SELECT 'f' || doc_id AS id, path AS file, checksum FROM new WHERE doc_id % 7 = 0 OR doc_id % 10 = 0)
SELECT id, file, checksum FROM fr UNION ALL SELECT 'f' || doc_id || CASE WHEN path LIKE 'gone/%' THEN 'g' ELSE '' END, path, checksum FROM old
WHERE path NOT IN (SELECT path FROM t) AND 'f' || doc_id || CASE WHEN path LIKE 'gone/%' THEN 'g' ELSE '' END NOT IN (SELECT id FROM fr)""")
def merge_batch(spark, d):
    old, new = star.snapshots(spark, d)
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    base = old.select(F.concat(name, F.when(F.col("path").startswith("gone/"), "g").otherwise("")).alias("id"), F.col("path").alias("file"), "checksum")
    fresh = new.filter("doc_id % 7 = 0 or doc_id % 10 = 0").select(name.alias("id"), F.col("path").alias("file"), "checksum")
    return merge.merge_entities(base, fresh, old.filter("doc_id % 7 = 0 or doc_id % 13 = 0").select(F.col("path").alias("file")))


@query(f"""WITH {E}, {R}, g AS (SELECT id FROM e WHERE type IN ('Class', 'Interface') AND start_line % 30 = 0)
SELECT id, source_id, target_id FROM r WHERE type = 'CONTAINS' AND source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)""")
def merge_edges(spark, d):
    gone = star.entities(spark, d).filter("type in ('Class', 'Interface') and start_line % 30 = 0").select("id")
    base = star.relations(spark, d).filter("type = 'CONTAINS'").select("id", "source_id", "target_id")
    return merge.merge_relations(base, base.limit(0), gone)


@query("""SELECT count(*) FILTER (WHERE c_custkey % 4 <> 0) AS kept, count(*) FILTER (WHERE c_custkey % 4 = 0) AS aside FROM orders JOIN customer ON o_custkey = c_custkey""")
def keyed_insert(spark, d):
    rows = star.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    kept, aside = merge.keyed(rows, "c_custkey", star.table(spark, d, "customer").filter("c_custkey % 4 <> 0"))
    both = kept.select(F.lit(1).alias("k")).unionByName(aside.select(F.lit(0).alias("k")))
    return both.agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("aside"))


@query(f"WITH {S}, n AS (SELECT *, row_number() OVER (PARTITION BY checksum ORDER BY doc_id) AS k FROM new) SELECT doc_id, path, checksum FROM n WHERE k = 1")
def first_wins_dedup(spark, d):
    return merge.first_wins(star.snapshots(spark, d)[1], ["checksum"], ["doc_id"])


@query(f"WITH {A}, n AS (SELECT *, row_number() OVER (PARTITION BY insight_id ORDER BY moment DESC, event_id DESC) AS k FROM au) SELECT insight_id, event_id, action FROM n WHERE k = 1")
def latest_state(spark, d):
    return merge.latest(star.audits(spark, d).select("insight_id", "event_id", "at", "action"), ["insight_id"], ["at", "event_id"]).select("insight_id", "event_id", "action")


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS number FROM lineitem)
SELECT 'order:' || l_orderkey || ':CALLS:ext@' || l_linenumber || ':1' || CASE WHEN number > 0 THEN '#' || number ELSE '' END AS id, l_partkey FROM n""")
def relation_subnumber(spark, d):
    line = star.table(spark, d, "lineitem").select(
        F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("source_id"), F.lit("CALLS").alias("type"), F.lit(None).cast("string").alias("target_id"), F.col("l_linenumber").alias("line"), F.lit(1).alias("col"),
        "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
    )
    held = merge.sub_numbers(line, ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])
    return held.select(ids.relation_id(F.col("source_id"), F.col("type"), F.col("target_id"), F.col("line"), F.col("col"), F.col("number")).alias("id"), "l_partkey")


# --- intervals -------------------------------------------------------------------------------------------------------

_SPANS = """sp AS (SELECT 's' || c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS file, c_custkey * 7 % 5000 AS start_line, c_custkey * 7 % 5000 + CASE WHEN c_custkey % 97 = 0 THEN 4000 ELSE c_custkey % 60 + 1 END AS end_line,
    CASE WHEN c_custkey % 3 = 0 THEN 'Method' ELSE 'Class' END AS type FROM customer)"""


def _spans(spark, d):
    start = F.col("c_custkey") * 7 % 5000
    return star.table(spark, d, "customer").select(
        F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").cast("string").alias("file"), start.alias("start_line"),
        (start + F.when(F.col("c_custkey") % 97 == 0, 4000).otherwise(F.col("c_custkey") % 60 + 1)).alias("end_line"), F.when(F.col("c_custkey") % 3 == 0, "Method").otherwise("Class").alias("type"),
    )


@query(f"""WITH {_SPANS}, pl AS (SELECT p_partkey AS place, CAST(p_partkey % 25 AS VARCHAR) AS file, p_partkey * 13 % 6000 AS line FROM part),
c AS (SELECT place, sp.id, row_number() OVER (PARTITION BY place ORDER BY end_line - start_line - CASE WHEN type = 'Method' THEN 100000 ELSE 0 END, start_line, sp.id) AS k FROM pl JOIN sp ON sp.file = pl.file AND line >= start_line AND line < end_line)
SELECT pl.place, pl.file, pl.line, c.id AS owner FROM pl LEFT JOIN c ON c.place = pl.place AND k = 1""")
def innermost_enclosing(spark, d):
    places = star.table(spark, d, "part").select(F.col("p_partkey").alias("place"), (F.col("p_partkey") % 25).cast("string").alias("file"), (F.col("p_partkey") * 13 % 6000).alias("line"))
    return intervals.innermost(places, _spans(spark, d))


@query(f"""WITH {_SPANS}, ev AS (SELECT p_partkey AS n, 's' || (p_partkey * 3) AS ref, p_partkey * 7 % 5000 AS line, p_partkey % 4 AS col FROM part)
SELECT n, ref, ev.line, ev.col, CASE WHEN sp.id IS NULL THEN 'missing' WHEN (start_line, 2) <= (ev.line, ev.col) AND (ev.line, ev.col) < (end_line, 1) THEN 'inside' ELSE 'outside' END AS verdict FROM ev LEFT JOIN sp ON sp.id = ev.ref""")
def evidence_in_interval(spark, d):
    part = star.table(spark, d, "part")
    asked = part.select(F.col("p_partkey").alias("n"), F.concat(F.lit("s"), (F.col("p_partkey") * 3).cast("string")).alias("ref"), (F.col("p_partkey") * 7 % 5000).alias("line"), (F.col("p_partkey") % 4).alias("col"))
    return intervals.evidence_inside(asked, _spans(spark, d).withColumns({"start_col": F.lit(2), "end_col": F.lit(1)}))


@query(f"WITH {E} SELECT t.id AS owner, m.id AS member FROM e m JOIN e t ON t.type = 'Class' AND m.type = 'Method' AND t.qualified_name = regexp_replace(m.qualified_name, '\\.o[0-9]+$', '')")
def member_prefix_join(spark, d):
    held = star.entities(spark, d)
    return intervals.members_by_prefix(held.filter("type = 'Class'"), held.filter("type = 'Method'")).select("owner", "member")


@query("""WITH o AS (SELECT 'a' || l_orderkey || ':' || l_linenumber || ':' || l_partkey AS id, l_suppkey AS s, l_orderkey AS line FROM lineitem WHERE l_linenumber = 1),
n AS (SELECT 'b' || l_orderkey || ':' || l_linenumber || ':' || l_partkey AS id, l_suppkey AS s, l_orderkey AS line FROM lineitem WHERE l_linenumber = 2),
j AS (SELECT o.id AS old_id, abs(o.line - n.line) AS gap FROM o JOIN n USING (s)) SELECT o.id AS old_id, min(gap) AS gap FROM o LEFT JOIN j ON j.old_id = o.id GROUP BY o.id""")
def relation_migration(spark, d):
    name = lambda p: F.concat(F.lit(p), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")))
    line = star.table(spark, d, "lineitem")
    of = lambda p, n: line.filter(F.col("l_linenumber") == n).select(name(p).alias("id"), F.col("l_suppkey").cast("string").alias("source_id"), F.lit("CALLS").alias("type"), F.lit("t").alias("target_id"), F.col("l_orderkey").alias("line")).distinct()
    old, new = of("a", 1), of("b", 2)
    found = intervals.nearest_by_position(old, new).join(old.select(F.col("id").alias("old_id"), F.col("line").alias("x")), "old_id").join(new.select(F.col("id").alias("new_id"), F.col("line").alias("y")), "new_id", "left")
    return found.groupBy("old_id").agg(F.min(F.abs(F.col("x") - F.col("y"))).alias("gap"))


# --- insights --------------------------------------------------------------------------------------------------------


@query(f"""WITH {E} SELECT 'rule-' || substring(sha256('p|' || id || '|missing-doc'), 1, 16) AS id, id AS entity_id FROM e WHERE type IN ('Method', 'Class') AND trim(coalesce(doc_comment, '')) = ''""")
def missing_doc_rule(spark, d):
    return insights.rule_insights(star.entities(spark, d), "p").select("id", "entity_id")


_SUM = "substring(sha256(coalesce(qualified_name, '') || '|' || coalesce(signature, '') || '|' || file || ':' || start_line), 1, 16)"


@query(f"""WITH {E}, {I}, k AS (SELECT id, {_SUM} AS checksum FROM e WHERE type = 'Class'), s AS (SELECT ins.id, 'customer:' || entity AS entity, status, CASE WHEN ins.entity % 3 = 0 THEN 'old' ELSE k.checksum END AS code_checksum FROM ins LEFT JOIN k ON k.id = 'customer:' || ins.entity)
SELECT s.id, s.entity FROM s LEFT JOIN k ON k.id = s.entity WHERE k.id IS NULL OR s.code_checksum IS DISTINCT FROM k.checksum""")
def stale_insights(spark, d):
    held = star.entities(spark, d).filter("type = 'Class'").select("id", marks.code_checksum(F.col("qualified_name"), F.col("signature"), F.col("file"), F.col("start_line")).alias("checksum"))
    made = star.insights(spark, d).select("id", "status", F.col("entity").alias("n"), F.concat(F.lit("customer:"), F.col("entity").cast("string")).alias("entity"))
    made = made.join(held.withColumnRenamed("id", "entity"), "entity", "left").select("id", "entity", "status", F.when(F.col("n") % 3 == 0, "old").otherwise(F.col("checksum")).alias("code_checksum"))
    return insights.stale(made, held).select("id", "entity")


@query(f"""WITH {E}, s AS (SELECT id, CAST(CASE WHEN type IN ('Class', 'Interface', 'Enum') THEN 200 WHEN type IN ('Method', 'Constructor') THEN 20 ELSE 1 END + CASE WHEN trim(coalesce(doc_comment, '')) = '' THEN 80 ELSE 0 END
    + least(100, coalesce(length(signature), 0) // 5) + CASE WHEN modifiers = 'public' THEN 50 ELSE 0 END AS BIGINT) AS score FROM e WHERE type IN ('Class', 'Method', 'Interface')),
n AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s)
SELECT id, score, CAST(rank AS INTEGER) AS rank, rank * 500 <= 60000 AS within_budget FROM n WHERE rank <= 200""")
def llm_candidates(spark, d):
    return insights.candidates(star.entities(spark, d).withColumn("modifiers", F.split("modifiers", ",")), budget=60000)


@query(f"""WITH {I}, w AS (SELECT doc_id AS entity, k.kind FROM documents, (SELECT 'summary' AS kind UNION ALL SELECT 'tech_debt') k)
SELECT entity AS entity_id, kind FROM w WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins.entity = w.entity AND ins.kind = w.kind AND ins.status NOT IN ('superseded', 'rejected'))""")
def llm_ungenerated(spark, d):
    wanted = star.table(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), F.explode(F.array(F.lit("summary"), F.lit("tech_debt"))).alias("kind"), F.lit("v1").alias("prompt_version"))
    held = star.insights(spark, d).select(F.col("entity").alias("entity_id"), "kind", "status", F.lit("v1").alias("prompt_version"))
    return insights.ungenerated(wanted, held).select("entity_id", "kind")


@query("SELECT doc_id FROM documents WHERE sha256(doc_id || '|c|v1|m') NOT IN (SELECT sha256(doc_id || '|c|v1|m') FROM labels)")
def llm_uncached(spark, d):
    key = marks.cache_key(F.col("doc_id").cast("string"), F.lit("c"), F.lit("v1"), F.lit("m")).alias("cache_key")
    return insights.uncached(star.table(spark, d, "documents").select("doc_id", key), star.table(spark, d, "labels").select(key)).select("doc_id")


@query(f"""WITH {A}, l AS (SELECT insight_id, action, row_number() OVER (PARTITION BY insight_id ORDER BY moment DESC, event_id DESC) AS k FROM au WHERE action IN ('approve', 'modify', 'reject')),
c AS (SELECT insight_id, count(*) AS version FROM au GROUP BY insight_id)
SELECT c.insight_id, coalesce(CASE WHEN action = 'reject' THEN 'rejected' WHEN action IS NOT NULL THEN 'approved' END, 'pending') AS status, version, coalesce(action <> 'reject', FALSE) AS approved FROM c LEFT JOIN l ON l.insight_id = c.insight_id AND k = 1""")
def insight_state_fold(spark, d):
    return insights.review_state(star.audits(spark, d))


@query(f"""WITH {A}, s AS (SELECT event_id, CASE WHEN action = 'reject' THEN 'rejected' ELSE 'approved' END AS after, lag(CASE WHEN action = 'reject' THEN 'rejected' ELSE 'approved' END) OVER (PARTITION BY insight_id ORDER BY moment, event_id) AS before
    FROM au WHERE action IN ('approve', 'modify', 'reject')) SELECT event_id, before, after FROM s WHERE before = 'rejected'""")
def illegal_transitions(spark, d):
    return insights.illegal_transitions(star.audits(spark, d)).select("event_id", "before", "after")


@query(f"""WITH {I} SELECT id, CASE WHEN entity % 3 = 0 THEN 'approved' WHEN status = 'approved' THEN 'superseded' ELSE status END AS status FROM ins""")
def restore_approved(spark, d):
    held = star.insights(spark, d)
    return insights.restore_approved(held, held.filter("entity % 3 = 0").select(F.col("id").alias("insight_id"))).select("id", "status")


@query(f"WITH {A} SELECT project_id, count(*) AS insight_version, max(moment) AS graph_mtime FROM au GROUP BY project_id")
def insight_versions(spark, d):
    return insights.versions(star.audits(spark, d))


@query(f"""WITH {E}, {R}, o AS (SELECT source_id, count(*) AS n FROM r GROUP BY source_id), h AS (SELECT 'customer:' || user_id AS id, count(*) AS changes FROM events GROUP BY user_id)
SELECT e.id, CAST(200 * (1 + coalesce(o.n, 0)) * (1 + coalesce(h.changes, 0)) AS BIGINT) AS weight FROM e LEFT JOIN o ON o.source_id = e.id LEFT JOIN h ON h.id = e.id WHERE e.type = 'Class'""")
def enrichment_order(spark, d):
    held = star.entities(spark, d).filter("type = 'Class'").select("id", F.lit(200).alias("weight"))
    out = star.relations(spark, d).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    heat = star.table(spark, d, "events").groupBy(F.concat(F.lit("customer:"), F.col("user_id").cast("string")).alias("id")).agg(F.count(F.lit(1)).alias("changes"))
    return insights.enrichment_order(held, out, heat)


# --- documents -------------------------------------------------------------------------------------------------------


@query(f"""WITH {E} SELECT id, '| ' || type || ' | `' || qualified_name || '` | ' || coalesce(doc_comment, '') || ' |' AS line FROM e WHERE type IN ('Class', 'Interface', 'Enum')""")
def architecture_section(spark, d):
    return documents.architecture(star.entities(spark, d))


@query(f"WITH {E} SELECT file, count(*) AS n, string_agg('- `' || qualified_name || '`', chr(10) ORDER BY id) AS content FROM e WHERE type IN ('Class', 'Interface', 'Enum') GROUP BY file")
def module_section(spark, d):
    held = star.entities(spark, d)
    rows = documents.modules(held).join(held.select("id", "file"), "id")
    return documents.joined(rows, F.col("line"), ["id"], ["file"])


@query(f"""WITH {E} SELECT t.qualified_name AS owner_name, m.id, '- **' || m.qualified_name || '  ' || coalesce(m.signature, '') || '** — ' || coalesce(m.doc_comment, '') AS line
FROM e m JOIN e t ON t.type = 'Class' AND m.type = 'Method' AND t.qualified_name = regexp_replace(m.qualified_name, '\\.o[0-9]+$', '')""")
def api_listing(spark, d):
    return documents.api(star.entities(spark, d))


@query("""SELECT p_brand AS brand, count(*) AS n, string_agg('| `' || p_name || '.' || p_partkey || '` | `' || p_type || '` |', chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY p_brand""")
def data_dictionary(spark, d):
    part = star.table(spark, d, "part")
    fields = part.select(F.col("p_partkey").alias("id"), F.concat_ws(".", "p_name", F.col("p_partkey").cast("string")).alias("qualified_name"), F.col("p_type").alias("type_name"))
    rows = documents.data_dictionary(fields).join(part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")), "id")
    return documents.joined(rows, F.col("line"), ["id"], ["brand"])


@query(f"""WITH {P}, c AS (SELECT DISTINCT id, source_id, target_id, external_target FROM pr WHERE type = 'CALLS' ORDER BY id, target_id, external_target LIMIT 200)
SELECT CAST(row_number() OVER (ORDER BY id, target_id, external_target) AS INTEGER) AS number, regexp_replace(source_id, '[^A-Za-z0-9_]', '_', 'g') || ' --> ' || regexp_replace(coalesce(target_id, external_target), '[^A-Za-z0-9_]', '_', 'g') AS line FROM c""")
def call_graph_edges(spark, d):
    return documents.call_graph(star.project(spark, d)[1].distinct())


@query(f"""WITH {E}, t AS (SELECT qualified_name, min(id) AS id, min(name) AS name FROM e WHERE type IN ('Class', 'Interface', 'Enum') GROUP BY qualified_name),
m AS (SELECT regexp_replace(qualified_name, '\\.o[0-9]+$', '') AS owner, id, name FROM e WHERE type = 'Method'),
w AS (SELECT qualified_name AS owner, 0 AS kind, id AS key, 'class ' || replace(name, ' ', '') AS line FROM t UNION ALL SELECT owner, 1, id, name || '()' FROM m),
n AS (SELECT *, row_number() OVER (ORDER BY owner, kind, key) AS place FROM w)
SELECT 'classes' AS section, CAST(place AS INTEGER) AS place, line FROM n WHERE place <= 200""")
def class_diagram(spark, d):
    return documents.class_diagram(star.entities(spark, d), star.relations(spark, d))


@query("""WITH r AS (SELECT p_partkey % 7 AS section, p_partkey AS n, 's' || (p_partkey * 3) AS ref FROM part), s AS (SELECT 's' || c_custkey AS id, c_custkey * 10 AS a FROM customer),
i AS (SELECT 'insight:' || doc_id AS ref, doc_id % 7 AS section FROM labels WHERE doc_id % 2 = 0)
SELECT section, 'no entity: ' || ref AS failure FROM r WHERE ref NOT IN (SELECT id FROM s)
UNION ALL SELECT section, CASE WHEN s.id IS NULL THEN 'no evidence: ' ELSE 'outside: ' END || ref FROM r LEFT JOIN s ON s.id = r.ref WHERE s.id IS NULL OR NOT (r.n * 30 + r.n % 15 >= s.a AND r.n * 30 + r.n % 15 < s.a + 10)
UNION ALL SELECT section, 'not approved: ' || ref FROM i WHERE ref NOT IN (SELECT 'insight:' || doc_id FROM labels WHERE quality = 1 AND toxic = 0)""")
def reference_failures(spark, d):
    part, customer = star.table(spark, d, "part"), star.table(spark, d, "customer")
    ref = F.concat(F.lit("s"), (F.col("p_partkey") * 3).cast("string")).alias("ref")
    refs = part.select((F.col("p_partkey") % 7).alias("section"), ref)
    evidence = part.select((F.col("p_partkey") % 7).alias("section"), ref, (F.col("p_partkey") * 30 + F.col("p_partkey") % 15).alias("line"), F.lit(1).alias("col"))
    known = customer.select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_custkey") * 10).alias("start_line"), F.lit(1).alias("start_col"), (F.col("c_custkey") * 10 + 10).alias("end_line"), F.lit(1).alias("end_col"))
    named = star.table(spark, d, "labels").filter("doc_id % 2 = 0").select((F.col("doc_id") % 7).alias("section"), F.concat(F.lit("insight:"), F.col("doc_id").cast("string")).alias("ref"), F.lit(1).cast("long").alias("line"), F.lit(1).alias("col"))
    states = star.insights(spark, d).select(F.substr("id", F.lit(9)).alias("id"), "status")
    return documents.reference_failures(refs, evidence.unionByName(named), known, states)


@query(f"""WITH {E}, {R}, n AS (SELECT id FROM e WHERE type IN ('Module', 'Namespace') ORDER BY id LIMIT 80) SELECT DISTINCT source_id, type, target_id FROM r WHERE type = 'CONTAINS' AND source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)""")
def display_edges(spark, d):
    return documents.display_edges(star.entities(spark, d).filter("type in ('Module', 'Namespace')"), star.relations(spark, d), ("CONTAINS", "INHERITS", "IMPLEMENTS", "DEPENDS_ON"))


_MIXED = "substr(sha256(id), 1, 8) || id"


@query(f"""WITH {E}, n AS (SELECT {_MIXED} AS id, CASE WHEN type IN ('Class', 'Interface', 'Struct', 'Union', 'Enum') THEN 0 WHEN type IN ('Method', 'Function', 'Constructor', 'Destructor') THEN 1 ELSE 2 END AS layer FROM e ORDER BY id LIMIT 80),
p AS (SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY layer) AS layer_size FROM n)
SELECT id, CAST(layer AS INTEGER) AS layer, CAST(place AS INTEGER) AS place, layer_size, max(layer_size) OVER () AS widest FROM p""")
def diagram_layout(spark, d):
    rows = star.entities(spark, d).withColumn("id", F.concat(F.substring(F.sha2("id", 256), 1, 8), "id"))
    return documents.layout(rows)


@query("""WITH s AS (SELECT p_partkey AS section, p_size AS n FROM part),
t AS (SELECT section, CASE WHEN n <= 12 THEN 0 WHEN n // 2 <= 12 OR section % 5 = 0 THEN 1 ELSE 2 END AS tries, n FROM s)
SELECT section, CAST(CASE WHEN tries > 0 AND section % 5 = 0 THEN 0 ELSE tries END AS INTEGER) AS tries,
    CAST(CASE WHEN section % 5 = 0 THEN n WHEN tries = 2 THEN n // 4 WHEN tries = 1 THEN n // 2 ELSE n END AS BIGINT) AS length,
    CASE WHEN section % 5 = 0 AND n > 12 OR tries = 2 AND n // 4 > 12 THEN 'too long' END AS failure FROM t""")
def sections_made_again(spark, d):
    """Sections that are too long are made again at half the length, twice at most; one in five is never made anew."""
    sections = star.table(spark, d, "part").select(F.col("p_partkey").alias("section"), F.col("p_size").cast("long").alias("length"))
    make = lambda bad, n: bad.filter("section % 5 <> 0").withColumn("length", F.floor(F.col("length") / 2))
    fail = lambda rows: rows.filter("length > 12").select("section", F.lit("too long").alias("failure"))
    made, left = documents.made_again(sections, make, fail)
    return made.join(left, "section", "left").select("section", "tries", "length", "failure")


# --- functions -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST((length(text) + 3) // 4 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return star.table(spark, d, "documents").select("doc_id", marks.token_estimate(F.col("text")).alias("tokens"))


@query(f"WITH {E} SELECT id, {_SUM} AS checksum FROM e")
def entity_checksum(spark, d):
    return star.entities(spark, d).select("id", marks.code_checksum(F.col("qualified_name"), F.col("signature"), F.col("file"), F.col("start_line")).alias("checksum"))


@query("""SELECT p_partkey AS id, '(' || CASE p_size % 4 WHEN 0 THEN 'I' WHEN 1 THEN '[J' WHEN 2 THEN 'Ljava/util/List;' ELSE '[[Z' END || 'Lx/' || replace(p_brand, '#', '') || ';)' || CASE WHEN p_size % 2 = 0 THEN 'V' ELSE 'D' END AS descriptor FROM part""")
def descriptor_encoding(spark, d):
    kind = F.element_at(F.array(*(F.lit(x) for x in ("int", "long...", "java.util.List<String>", "boolean[][]"))), (F.col("p_size") % 4 + 1).cast("int"))
    params = F.array(kind, F.concat(F.lit("x."), F.regexp_replace("p_brand", "#", "")))
    return star.table(spark, d, "part").select(F.col("p_partkey").alias("id"), descriptors.method_descriptor(params, F.when(F.col("p_size") % 2 == 0, "void").otherwise("double")).alias("descriptor"))


@query("""SELECT event_id, CAST(CASE WHEN value > 1 THEN least(1.0, value / 100) ELSE greatest(0.0, value) END AS DOUBLE) AS confidence FROM events""")
def confidence_extract(spark, d):
    answer = F.to_json(F.struct(F.col("value").alias("severityScore")))
    return star.table(spark, d, "events").select("event_id", marks.confidence(answer).alias("confidence"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^.*[/]', ''), '[^A-Za-z0-9_]', '_', 'g') AS node, CAST(greatest(1, least(5, page_id)) AS BIGINT) AS clamped FROM pages")
def name_functions(spark, d):
    return star.table(spark, d, "pages").select("page_id", F.regexp_replace(names.file_name(F.col("url")), "[^A-Za-z0-9_]", "_").alias("node"), clamp(F.col("page_id"), 1, 5).cast("long").alias("clamped"))


@query(f"WITH {E} SELECT id, file || '#L' || start_line || '-' || (end_line - 1) AS place, start_line <= 500 AND 500 < end_line AS holds FROM e")
def location_functions(spark, d):
    one = F.lit(1)
    return star.entities(spark, d).select("id", location_text(F.col("file"), F.col("start_line"), F.col("end_line")).alias("place"), contains(F.col("start_line"), one, F.col("end_line"), one, F.lit(500), one).alias("holds"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stage_event_counts(spark, d):
    from ..streaming.events import counts

    return counts(star.table(spark, d, "events"), "hour").withColumnRenamed("window", "hour")


@query("SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1")
def daily_tokens(spark, d):
    return star.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.floor("value")).alias("tokens"))
