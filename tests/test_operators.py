import datetime

import pytest
from pyspark.sql import functions as F

from factmill.operators import diff, documents, facts, graph, insights, intervals, merge, validate
from factmill.streaming import events


def test_subgraph_edges(spark):
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    relations = spark.createDataFrame([("1", "a", "b", None), ("2", "b", "c", None), ("3", "b", None, "out"), ("4", "c", "a", None)], "id string, source_id string, target_id string, external_target string")
    nodes, edges = graph.subgraph(entities, relations, "a", 2)
    assert {(r.id, r.kind, r.distance) for r in nodes.collect()} == {("a", "entity", 0), ("b", "entity", 1), ("c", "entity", 2), ("ext:out", "external", 2)}
    assert sorted(r.id for r in edges.collect()) == ["1", "2", "3"]
    assert [r.id for r in graph.subgraph(entities, relations, "a", 0)[0].collect()] == ["a"]
    assert graph.subgraph(entities, relations, None)[1].count() == 4
    with pytest.raises(ValueError, match="no such entity"):
        graph.subgraph(entities, relations, "z")


def test_subgraph_grows_with_depth(spark):
    entities = spark.range(40).select(F.col("id").cast("string").alias("id"))
    relations = spark.range(40).select(F.col("id").cast("string").alias("source_id"), ((F.col("id") * 3 + 1) % 45).cast("string").alias("target_id"), F.lit("x").alias("external_target"))
    before = set()
    for depth in range(5):
        now = {r.id for r in graph.subgraph(entities, relations, "1", depth)[0].collect()}
        assert before <= now
        before = now


@pytest.mark.parametrize(("pairs", "expected"), [([], []), ([("a", "b"), ("b", "c")], []), ([("a", "b"), ("b", "a"), ("c", "a"), ("x", "y")], ["a", "b", "c"]), ([(str(i), str(i + 1)) for i in range(40)], [])])
def test_cycles(spark, pairs, expected):
    rows = spark.createDataFrame(pairs, "child string, parent string")
    assert sorted(r.child for r in graph.on_cycles(rows).collect()) == expected


def test_overridden_at_any_level(spark):
    parents = [(f"t{i}", f"t{i + 1}", 0) for i in range(11)] + [("t11", "t9", 1), ("t0", "i", 1), ("i", "t2", 0)]  # with a cycle and two ways to t2
    methods = [("low", "t0", "f()"), ("high", "t11", "f()"), ("other", "t0", "g()"), ("m1", "t0", "h()"), ("m2", "t2", "h()")]
    args = spark.createDataFrame(methods, "id string, owner string, key string"), spark.createDataFrame(parents, "child string, parent string, rank int")
    got = lambda *depth: {(r.id, r.target_id) for r in graph.first_overridden(*args, *depth).collect()}
    assert got() == {("low", "high"), ("m1", "m2")}
    assert got(5) == {("m1", "m2")}


def test_threshold_is_strict(spark):
    new = spark.createDataFrame([(f"f{i}", "1") for i in range(10)], "path string, checksum string")
    old = spark.createDataFrame([(f"f{i}", "1" if i > 1 else "0") for i in range(10)], "path string, checksum string")
    uses = spark.createDataFrame([], "user string, used string")
    assert {r.reason for r in diff.plan(old, new, uses).collect()} == {"changed"}
    assert {r.reason for r in diff.plan(old, new, uses, ratio=0.19).collect()} == {"full"}
    assert {r.reason for r in diff.plan(old.limit(0), new, uses).collect()} == {"full"}


def test_deleted_files_make_their_users_dirty(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, checksum string")
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "path string, checksum string")
    uses = spark.createDataFrame([("a", "d"), ("b", "a"), ("c", "b")], "user string, used string")
    got = {(r.path, r.reason, r.distance) for r in diff.plan(old, new, uses, ratio=1.0).collect()}
    assert got == {("d", "deleted", 0), ("a", "dependent", 1), ("b", "dependent", 2)}


def test_innermost_by_brute_force(spark):
    spans = [(f"s{i}", "f", (i * 37) % 900, (i * 37) % 900 + 1 + (i * i) % (6000 if i % 9 == 0 else 70), "Method" if i % 4 == 0 else "Class") for i in range(80)]
    places = [(i, "f", (i * 13) % 1000) for i in range(150)]
    got = {r.place: r.owner for r in intervals.innermost(spark.createDataFrame(places, "place long, file string, line long"), spark.createDataFrame(spans, "id string, file string, start_line long, end_line long, type string")).collect()}
    for place, _, line in places:
        around = [(e - s - 100000 * (t == "Method"), s, n) for n, _, s, e, t in spans if s <= line < e]
        assert got[place] == (min(around)[2] if around else None)


def test_nearest_by_brute_force(spark):
    old = [(f"o{i}", "s", "CALLS", "t", (i * 29) % 200) for i in range(30)]
    new = [(f"n{i}", "s", "CALLS", "t", (i * 53) % 211) for i in range(20)] + [("far", "q", "CALLS", "t", 1)]
    schema = "id string, source_id string, type string, target_id string, line long"
    lines = {x[0]: x[4] for x in new}
    for r in intervals.nearest_by_position(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect():
        line = next(x[4] for x in old if x[0] == r.old_id)
        assert abs(lines[r.new_id] - line) == min(abs(x[4] - line) for x in new if x[1] == "s")


def test_validation(spark):
    entities = spark.createDataFrame([("a", "A", None, "Java", "f", 1), ("a", "A", "(V)V", "Java", "f", 2), ("", "B", None, "Java", "f", 3)], "id string, qualified_name string, signature string, language string, file string, start_line int")
    relations = spark.createDataFrame(
        [("a:CONTAINS:a@1:1", "CONTAINS", "a", "a", None, 1, 1), ("x", "CALLS", "z", "y", None, None, 1), ("a:CALLS:ext@1:12", "CALLS", "a", None, "", 1, 1)],
        "id string, type string, source_id string, target_id string, external_target string, line int, col int",
    )
    found = validate.validate(entities, relations)
    codes = sorted(r.code.removeprefix("UCM.") for r in found.collect())
    assert codes == ["CONTAINS_CYCLE", "DANGLING_SOURCE", "DANGLING_TARGET", "DUP_ID", "EMPTY_ID", "EXT_MISSING", "LOCATION_REQUIRED", "SIGNATURE_INVALID"]
    assert validate.blocked(found)
    assert validate.place_mismatch(relations, anchored=True).count() == 1  # `@1:1` stands in `@1:12`, but does not end it


def test_review_fold(spark):
    rows = [(1, 1, "i", "create"), (2, 1, "i", "approve"), (3, 2, "i", "degrade"), (4, 3, "j", "reject"), (5, 4, "j", "approve"), (6, 5, "k", "create")]
    audits = spark.createDataFrame(rows, "event_id long, at long, insight_id string, action string")
    got = {r.insight_id: (r.status, r.version, r.approved) for r in insights.review_state(audits).collect()}
    assert got == {"i": ("approved", 3, True), "j": ("approved", 2, True), "k": ("pending", 1, False)}
    assert [r.event_id for r in insights.illegal_transitions(audits).collect()] == [5]


def test_rule_ids_are_stable(spark):
    entities = spark.createDataFrame([("a", "Class", " "), ("b", "Class", "doc"), ("c", "Field", None)], "id string, type string, doc_comment string")
    one, two = (insights.rule_insights(entities.orderBy(F.rand(s)), "p").collect() for s in (1, 2))
    assert [r.id for r in one] == [r.id for r in two] and [r.entity_id for r in one] == ["a"]


def test_merge_and_pages(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "id string, at long, v string")
    assert {(r.id, r.v) for r in merge.latest(log, ["id"], ["at"]).collect()} == {("a", None), ("b", "y")}
    projects = spark.createDataFrame([("a", 1, None), ("b", 2, 3)], "id string, created_at long, deleted_at long")
    assert [r.id for r in facts.live_projects(projects).collect()] == ["a"]
    assert [r.x for r in spark.sql("select '{\"archived\": true}' as c union all select 'bad'").select(facts.archived(F.col("c")).alias("x")).collect()] == [True, False]
    assert spark.range(1).select(facts.language(F.lit('{"language": ""}')).alias("x")).first().x == "java"


def test_document(spark):
    sections = spark.createDataFrame([("1", "One", "text"), ("2", "Two", "more")], "section string, heading string, content string")
    failures = spark.createDataFrame([("2", "no entity: z")], "section string, failure string")
    text = documents.markdown("T", "r", sections, failures).first().content
    assert text.index("## One") < text.index("## Two") < text.index("- no entity: z")
    relations = spark.createDataFrame([("1", "CALLS", "a.b#x", None, "c"), ("2", "INHERITS", "p.Sub", "p.Top", None)], "id string, type string, source_id string, target_id string, external_target string")
    assert [r.line for r in documents.call_graph(relations, skipped=3).collect()][0] == "b --> c"
    entities = spark.createDataFrame([("p.Sub", "Class", "Sub", "p.Sub"), ("p.Top", "Class", "Top", "p.Top"), ("m", "Method", "go", "p.Sub.go")], "id string, type string, name string, qualified_name string")
    lines = [r.line for r in documents.class_diagram(entities, relations).orderBy("section", "place").collect()]
    assert lines == ["class Sub", "go()", "class Top", "Top <|-- Sub"]


def test_dense_macros_add_a_step(spark):
    new = spark.createDataFrame([(f"f{i}", "a" if i else "b") for i in range(40)], "path string, checksum string")
    old = spark.createDataFrame([(f"f{i}", "a") for i in range(40)], "path string, checksum string")
    uses = spark.createDataFrame([(f"f{i + 1}", f"f{i}") for i in range(39)], "user string, used string")
    for hits, want in ((3, 3), (4, 4)):  # of ten statements in each file
        macros = new.select("path", F.lit(hits).alias("uses"), F.lit(10).alias("statements"))
        assert diff.plan(old, new, uses, macros=macros).count() == want


def test_names_become_links(spark):
    sections = spark.createDataFrame([("1", "see `p.A` and `p.Z`, not p.A"), ("2", "")], "section string, content string")
    entities = spark.createDataFrame([("java:p.A", "p.A"), ("x", "p.Z"), ("y", "p.Z")], "id string, qualified_name string")
    got = {r.section: r.content for r in documents.linked(sections, entities).collect()}
    assert got == {"1": "see [`p.A`](#java:p.A) and `p.Z`, not p.A", "2": ""}


def test_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 0, 5)
    rows = [("p", "r", "stage_started", "parse", None, at), ("p", "r", "stage_started", "enrich", None, at), ("q", "r", "run_completed", "run", None, at + datetime.timedelta(hours=3))]
    schema = "project_id string, run_id string, type string, stage string, payload string, at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    got = []
    query = events.deliver(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda df, n: got.extend(df.collect()), str(tmp_path / "c1"), once=True)
    query.awaitTermination(60)
    assert len(got) == 3
    counted = events.windowed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = counted.writeStream.outputMode("append").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.project_id, r.type, r.n) for r in spark.table("counted").collect()} == {("p", "stage_started", 2)}
