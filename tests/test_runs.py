"""Runs write what changed, and end with the facts that a full run gives."""

from factmill.plans import runs
from factmill.sources.files import imported
from factmill.sources.store import Store


def _tree(changed=()):
    made = []
    for n in range(30):
        up = f" extends A{n - 1}" if n % 10 else ""
        body = f"void m{n}(int a) {{ }}" + (f" void more{n}() {{ m{n}(1); }}" if n in changed else "")
        made.append((f"p/A{n}.java", f"package p;\nclass A{n}{up} {{ {body} }}\n"))
    return made


def _facts(store):
    entities = {(r.id, r.file, r.start_line, r.end_col) for r in store.read("entities").collect()}
    return entities, {(r.id, r.target_id, r.external_target) for r in store.read("relations").collect()}, {(r.path, r.checksum) for r in store.read("files").collect()}


def test_a_run_of_one_file_writes_its_buckets(spark, tmp_path):
    project = runs.Project("p", ratio=0.9)
    store = Store(spark, str(tmp_path / "a"))
    runs.run(spark, store, project, imported(spark, _tree()), ("parse",))
    first = store._tables()
    tree = [x for x in _tree({9}) if x[0] != "p/A29.java"]
    result = runs.run(spark, store, project, imported(spark, tree), ("parse",))
    assert {r.path: r.reason for r in result.plan.collect()} == {"p/A9.java": "changed", "p/A29.java": "deleted"}
    for name in ("entities", "relations", "files"):
        assert 0 < len(set(store._tables()[name].paths) - set(first[name].paths)) <= 2, name
        assert len(set(first[name].paths) - set(store._tables()[name].paths)) <= 2, name
    whole = Store(spark, str(tmp_path / "b"))
    runs.run(spark, whole, project, imported(spark, tree), ("parse",))
    assert _facts(store) == _facts(whole)


def test_stages_are_not_run_again_on_what_they_have_seen(spark, tmp_path):
    store, project = Store(spark, str(tmp_path)), runs.Project("p", ratio=0.9)
    tree = _tree()[:4]
    first = runs.run(spark, store, project, imported(spark, tree))
    assert first.cached == () and ("insight_pending", "enrich") in first.events
    again = runs.run(spark, store, project, imported(spark, tree))
    assert again.cached == ("enrich", "generate") and sorted(map(tuple, again.document.collect())) == sorted(map(tuple, first.document.collect()))
    assert ("insight_pending", "enrich") not in again.events
    documents = lambda: {n for n in store.names() if n.startswith("generate-")}
    made = lambda version, **more: runs.generated(store, runs.Project("p", **more), "v", version)[1]
    one = documents()
    assert len(one) == 1 and not made(1)  # a review
    assert len(documents()) == 1 and documents() != one  # the older one is dropped
    assert made(1) and not made(1, language="c") and made(1)
    changed = runs.run(spark, store, project, imported(spark, _tree({3})[:4]), insight_version=1)
    assert changed.cached == () and changed.document.filter("content like '%more3%'").count() > 0


def test_digests_do_not_depend_on_order(spark):
    from factmill.plans.stage_cache import digest

    rows = [(n % 7, None if n % 3 else f"t{n}", [n, n]) for n in range(50)]
    df = spark.createDataFrame(rows, "a long, b string, c array<long>")
    assert digest(df) == digest(df.repartition(5).select("c", "a", "b"))
    assert len({digest(df), digest(df.limit(49)), digest(df.unionByName(df.limit(1))), digest(df.withColumn("a", df.a + 1)), digest(df.limit(0))}) == 5
