import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from factmill.operators import enrich
from factmill.plans.workspace import RUNS, Workspace
from factmill.sources import ddl
from factmill.sources.files import imported
from tests.test_sources import FILES


def test_a_project_from_import_to_review(spark, tmp_path):
    ticks = itertools.count()
    work = Workspace(spark, str(tmp_path), clock=lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=next(ticks)))
    project = work.create_project("shop", language="java", permissive=True)
    work.configure(project, ratio=0.5)
    files = imported(spark, FILES)
    first = work.run(project, files, request="once")
    assert work.run(project, files, request="once") == first and work.runs(project).first().status == "succeeded"
    assert [r.type for r in work.events(first).collect()][-1] == "run_completed"
    later = [(f"r{n}", project, f"other{n}", "succeeded", work.clock(), work.clock(), work.clock()) for n in range(60)]
    work._append("runs", RUNS, later)  # an old request is known however many came after it
    assert work.run(project, files, request="once") == first
    assert {r.name for r in work.entities(project, "Class", "BOO").collect()} == {"Book"}
    assert work.relations(project, kind="THROWS", external="illegal").count() == 1
    assert work.graph(project, "java:shop.Book", 1)[0].count() > 5
    assert work.file_content(project, "shop/Sale.java", 2, 99).startswith("public interface")
    with pytest.raises(KeyError):
        work.file_content(project, "../secret")
    assert "classDiagram" in work.diagram(project) and any("-->" in x for x in work.diagram(project, "call"))
    text = "\n".join(r.value for r in spark.read.text(work.generate(project)).collect())
    assert text.index(" types, ") < text.index("| type | name | doc |") < text.index("## API") < text.index("| field | type |")
    pending = work.insights(project, "pending")
    one = pending.orderBy("id").first().id
    work.review(project, one, "approve", "me")
    assert work.insights(project, "approved").first().id == one and work.version(project) == 1
    work.review(project, one, "reject", "me")
    assert work.insights(project, "approved").isEmpty() and [r.action for r in work.audits(project, one).collect()] == ["approve", "reject"]
    with pytest.raises(ValueError, match="no such action"):
        work.review(project, one, "praise", "me")
    work.archive(project)
    with pytest.raises(ValueError, match="archived"):
        work.run(project, files)
    work.delete(project)
    assert work.projects().isEmpty()
    work.purge(project)
    assert work.facts(project).versions() == []


def _ask(prompt, config):
    if "Broken" in prompt:
        raise OSError("down")
    return '```json\n{"note": "' + prompt.split(" ")[1] + '", "confidence": 70}\n```'


def test_enrichment(spark):
    rows = [("a", "Class", "p.A", None, ["public"], None, "c1"), ("b", "Method", "p.Broken", "()V", None, "doc", "c2"), ("c", "Field", "p.f", None, None, None, "c3")]
    entities = spark.createDataFrame(rows, "id string, type string, qualified_name string, signature string, modifiers array<string>, doc_comment string, checksum string")
    live = spark.createDataFrame([("a", "arch_role", "v1", "approved")], "entity_id string, kind string, prompt_version string, status string")
    none = spark.createDataFrame([], "cache_key string")
    config = enrich.ModelConfig(tries=2, failures=50, base_delay=0)
    asked = enrich.wanted(entities, live, none, config)
    assert {(r.entity_id, r.kind) for r in asked.collect()} == {("a", "summary"), ("a", "tech_debt"), ("b", "summary"), ("b", "tech_debt")}
    made = enrich.insights_of(enrich.call(asked, _ask, config, lambda s: None))
    got = {(r.entity_id, r.kind): r for r in made.collect()}
    assert got["a", "summary"].confidence == pytest.approx(0.7) and got["a", "summary"].evidence == ["a"] and not got["a", "summary"].degraded
    assert got["b", "summary"].degraded and got["b", "summary"].confidence == pytest.approx(0.6)
    assert enrich.summary(made).first()["generated"] == 2
    assert enrich.wanted(entities, live, asked.select("cache_key"), config).isEmpty()
    assert enrich.call(asked, None, config).filter("not degraded").isEmpty()
    assert enrich.wanted(entities, live, none, enrich.ModelConfig(budget=500)).select("entity_id").distinct().count() == 1


def _prompts(spark, n, parts=7):
    rows = [(f"k{i:03d}", f"p{i}", 10, i) for i in range(n)]
    return spark.createDataFrame(rows, "cache_key string, prompt string, tokens long, rank int").repartition(parts)


def _service(tmp_path, fails):
    """Writes a file for each call; fails as told by the prompt and how often it was asked."""
    import os
    import uuid

    def ask(prompt, config):
        n = sum(x.startswith(f"{prompt}-") for x in os.listdir(tmp_path))
        open(f"{tmp_path}/{prompt}-{uuid.uuid4().hex}", "w").close()
        if fails(prompt, n):
            raise OSError("down")
        return f"answer to {prompt}"

    return ask


def test_a_service_that_is_down_costs_as_many_calls_as_may_fail(spark, tmp_path):
    import os

    for concurrency in (1, 8):
        home = tmp_path / str(concurrency)
        home.mkdir()
        config = enrich.ModelConfig(failures=5, tries=3, base_delay=0, concurrency=concurrency)
        made, meter = enrich.call_waves(_prompts(spark, 40), _service(home, lambda p, n: True), config)
        assert len(os.listdir(home)) == 5 == meter.calls and meter.stopped == "breaker"
        assert made.filter("degraded").count() == 40


def test_waves_retry_and_count(spark, tmp_path):
    slept = []
    config = enrich.ModelConfig(failures=5, tries=3, base_delay=1, concurrency=4, wave=16)
    made, meter = enrich.call_waves(_prompts(spark, 30), _service(tmp_path, lambda p, n: (p == "p3" and n < 2) or p == "p9"), config, sleep=slept.append)
    got = {r.prompt: r.answer for r in made.collect()}
    assert len(got) == 30 and [p for p, a in got.items() if a is None] == ["p9"] and got["p3"] == "answer to p3"
    assert meter.calls == 30 + 2 + 2 and meter.stopped is None and slept[:2] == [1, 2] and meter.run_tokens == 340


def test_both_budgets_hold_over_all_tasks(spark, tmp_path):
    ask = _service(tmp_path, lambda p, n: False)
    made, meter = enrich.call_waves(_prompts(spark, 30), ask, enrich.ModelConfig(run_budget=125, wave=4))
    assert meter.calls == 12 and meter.stopped == "budget" and {r.prompt for r in made.filter("not degraded").collect()} == {f"p{i}" for i in range(12)}
    made, meter = enrich.call_waves(_prompts(spark, 30), ask, enrich.ModelConfig(run_budget=200, budget=1000), spent_today=950)
    assert (meter.calls, meter.day_tokens) == (5, 1000)
    assert enrich.call_waves(_prompts(spark, 0), ask, enrich.ModelConfig())[0].count() == 0


def test_scripts(spark):
    script = "-- a comment; with a mark\nCREATE TEMP VIEW ddl_one AS SELECT 1 AS x;\n\nCREATE TEMP VIEW ddl_two AS SELECT x + 1 AS y FROM ddl_one;"
    assert ddl.run(spark, script) == 2 and spark.table("ddl_two").select(F.max("y")).first()[0] == 2
