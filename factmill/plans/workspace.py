"""The entry points of the engine over one store: projects, runs, facts, graph, insights, documents and files."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, facts, graph, insights, merge
from ..operators.resolve import virtual_calls
from ..sources.cpp import CppConfig
from ..sources.store import Store
from . import runs

PROJECTS = "id string, name string, config string, created_at timestamp, deleted_at timestamp, at timestamp"
RUNS = "id string, project_id string, request string, status string, started_at timestamp, finished_at timestamp, at timestamp"
AUDITS = "event_id string, project_id string, insight_id string, action string, actor string, content string, at timestamp"
EVENTS = "run_id string, project_id string, number int, type string, stage string"


#: Versions of the small tables that stay for those who read them.
KEEP = 16


class Workspace:
    """Projects under ``root``: small tables as logs whose last row of a key stands, and a store of facts for each."""

    def __init__(self, spark: SparkSession, root: str, clock=lambda: datetime.datetime.now(datetime.UTC).replace(tzinfo=None)):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.store = Store(spark, f"{self.root}/workspace", keep=KEEP)

    def _append(self, name: str, schema: str, rows: list[tuple]) -> None:
        self.store.append(**{name: self.spark.createDataFrame(rows, schema).coalesce(1)})

    def facts(self, project: str) -> Store:
        return Store(self.spark, f"{self.root}/projects/{project}")

    # --- projects ---

    def _projects(self) -> DataFrame:
        return merge.latest(self.store.read("projects", PROJECTS), ["id"], ["at"])

    def _project(self, project: str):
        row = self._projects().filter((F.col("id") == project) & F.col("deleted_at").isNull()).first()
        if row is None:
            raise KeyError(project)
        return row

    def create_project(self, name: str, **config) -> str:
        now, ident = self.clock(), uuid.uuid4().hex[:12]
        self._append("projects", PROJECTS, [(ident, name, json.dumps(config), now, None, now)])
        return ident

    def projects(self) -> DataFrame:
        return facts.live_projects(self._projects())

    def configure(self, project: str, **config) -> None:
        """Change parts of the configuration; the others, the language among them, stay."""
        row = self._project(project)
        self._append("projects", PROJECTS, [(row.id, row.name, json.dumps(json.loads(row.config) | config), row.created_at, None, self.clock())])

    def archive(self, project: str) -> None:
        self.configure(project, archived=True)

    def delete(self, project: str) -> None:
        """Mark as deleted; its audit trail goes, and its facts stay until ``purge``."""
        row, now = self._project(project), self.clock()
        self._append("projects", PROJECTS, [(row.id, row.name, row.config, row.created_at, now, now)])
        self.store.commit(audits=self.store.read("audits", AUDITS).filter(F.col("project_id") != project))

    def purge(self, project: str) -> None:
        """Drop the facts and documents of a deleted project for good."""
        if not self.projects().filter(F.col("id") == project).isEmpty():
            raise ValueError(f"{project} is not deleted")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/projects/{project}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    # --- runs ---

    def run(self, project: str, files: DataFrame, stages: tuple[str, ...] = runs.STAGES, forced: bool = False, request: str | None = None) -> str:
        """One run; a ``request`` that has run before gives its id and runs nothing."""
        row, now = self._project(project), self.clock()
        config = json.loads(row.config)
        request = request or uuid.uuid4().hex
        before = self.store.read("runs", RUNS).filter((F.col("project_id") == project) & (F.col("request") == request)).first()
        if before is not None:
            return before.id
        ident = uuid.uuid4().hex[:12]
        settings = runs.Project(project, config.get("language") or "java", CppConfig(**config.get("cpp", {})), config.get("ratio", 0.2), config.get("permissive", False), bool(config.get("archived")))
        try:
            result = runs.run(self.spark, self.facts(project), settings, files, stages, forced, self.version(project))
            events, failed = result.events, any(t == "stage_error" for t, _ in result.events)
        except Exception:
            self._append("runs", RUNS, [(ident, project, request, "failed", now, self.clock(), self.clock())])
            raise
        self._append("runs", RUNS, [(ident, project, request, "failed" if failed else "succeeded", now, self.clock(), self.clock())])
        self._append("events", EVENTS, [(ident, project, n, t, s) for n, (t, s) in enumerate(events)])
        return ident

    def runs(self, project: str, limit: int = 50) -> DataFrame:
        return facts.list_runs(merge.latest(self.store.read("runs", RUNS), ["id"], ["at"]).filter(F.col("project_id") == project), limit)

    def events(self, run: str) -> DataFrame:
        return self.store.read("events", EVENTS).filter(F.col("run_id") == run).orderBy("number")

    # --- facts and graph ---

    def entities(self, project: str, kind: str | None = None, text: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        rows = self.facts(project).read("entities").withColumn("updated_at", F.lit(None).cast("timestamp"))
        return facts.search_entities(rows, kind, text, limit, offset).drop("updated_at")

    def relations(self, project: str, source: str | None = None, kind: str | None = None, external: str | None = None) -> DataFrame:
        """Relations that pass the filters, with ``virtual`` of calls."""
        held = self.facts(project)
        return facts.query_relations(virtual_calls(held.read("relations"), held.read("entities")), source, kind, external)

    def graph(self, project: str, start: str | None = None, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        held = self.facts(project)
        return graph.subgraph(held.read("entities"), held.read("relations"), start, depth)

    def file_content(self, project: str, path: str, first: int = 1, last: int = 1 << 30) -> str:
        """Lines ``first`` to ``last``, both kept within the file. Paths are those on record, so none leads outside."""
        rows = self.facts(project).read("files").filter(F.col("path") == path)
        lines = F.split("content", "\n")
        low = F.greatest(F.lit(1), F.least(F.lit(first), F.size(lines)))
        high = F.greatest(low, F.least(F.lit(last), F.size(lines)))
        row = rows.select(F.array_join(F.slice(lines, low, high - low + 1), "\n").alias("text")).first()
        if row is None:
            raise KeyError(path)
        return row.text

    def diagram(self, project: str, kind: str = "class") -> list[str]:
        held = self.facts(project)
        if kind == "call":
            return ["flowchart LR", *(r.line for r in documents.call_graph(held.read("relations")).orderBy("number").collect())]  # at most 200 lines
        rows = documents.class_diagram(held.read("entities"), held.read("relations")).orderBy("section", "place", "line")
        return ["classDiagram", *(r.line for r in rows.collect())]

    def generate(self, project: str) -> str:
        """The document of the last version; written as text under the project's exports, whose path this returns.

        The lines are in order over the files of that folder, in the order of their names.
        """
        held, ident = self.facts(project), uuid.uuid4().hex[:12]
        version = held.versions()[-1]
        path = f"{self.root}/projects/{project}/exports/{ident}"
        config = json.loads(self._project(project).config)
        report, _ = runs.generated(held, runs.Project(project, config.get("language") or "java"), version, self.version(project))
        report.orderBy("section", "place", "id").select("content").write.text(path)
        return path

    # --- insights ---

    def insights(self, project: str, status: str | None = None, kind: str | None = None, entity: str | None = None) -> DataFrame:
        """Insights with the status that the trail gives them; those that it does not name keep their own."""
        rows = self.facts(project).read("insights")
        trail = self.store.read("audits", AUDITS).filter(F.col("project_id") == project)
        state = insights.review_state(trail).select(F.col("insight_id").alias("id"), F.col("status").alias("__status"))
        rows = rows.join(state, "id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")
        return facts.list_insights(rows, status, kind, entity)

    def review(self, project: str, insight: str, action: str, actor: str, content: str | None = None) -> None:
        if action not in ("approve", "modify", "reject", "auto_approve", "supersede", "create", "degrade"):
            raise ValueError(f"no such action: {action}")
        if self.facts(project).read("insights").filter(F.col("id") == insight).isEmpty():
            raise KeyError(insight)
        self._append("audits", AUDITS, [(uuid.uuid4().hex, project, insight, action, actor, content, self.clock())])

    def audits(self, project: str, insight: str | None = None) -> DataFrame:
        return facts.list_audits(self.store.read("audits", AUDITS).filter(F.col("project_id") == project), insight)

    def version(self, project: str) -> int:
        row = insights.versions(self.audits(project)).first()
        return row.insight_version if row else 0
