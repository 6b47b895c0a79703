"""Insights: rules, staleness, candidates for enrichment, and the review state machine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.insights import priority

# What each review action makes of an insight.
STATUS_AFTER = {"approve": "approved", "auto_approve": "approved", "modify": "approved", "reject": "rejected", "supersede": "superseded"}
CANDIDATE_TYPES = ("Class", "Method", "Interface")
TOP_K, TOP_K_BUDGET = 80, 200


def missing_doc(entities: DataFrame) -> Column:
    return F.col("type").isin("Method", "Class") & (F.coalesce(F.trim("doc_comment"), F.lit("")) == "")


RULES: dict[str, Callable[[DataFrame], Column]] = {"missing-doc": missing_doc}


def rule_insights(entities: DataFrame, project: str, rules: dict[str, Callable] = RULES) -> DataFrame:
    """(id, entity_id, rule, kind, status): an insight for each entity and rule that holds; ids are stable hashes."""
    out = None
    for name, rule in rules.items():
        found = entities.filter(rule(entities)).select(
            F.concat(F.lit("rule-"), F.substring(F.sha2(F.concat_ws("|", F.lit(project), "id", F.lit(name)), 256), 1, 16)).alias("id"),
            F.col("id").alias("entity_id"), F.lit(name).alias("rule"), F.lit("tech_debt").alias("kind"), F.lit("pending").alias("status"),
        )
        out = found if out is None else out.unionByName(found)
    return out


def stale(insights: DataFrame, entities: DataFrame) -> DataFrame:
    """Insights (entity, code_checksum, status) to supersede: the entity is gone or its checksum is another."""
    held = entities.select(F.col("id").alias("entity"), F.col("checksum").alias("__now"), F.lit(True).alias("__known"))
    joined = insights.filter(F.col("status") != "superseded").join(held, "entity", "left")
    return joined.filter(F.col("__known").isNull() | ~F.col("__now").eqNullSafe(F.col("code_checksum"))).select(*insights.columns)


def candidates(entities: DataFrame, budget: int | None = None, top: int | None = None, per_call: int = 500) -> DataFrame:
    """The entities to enrich, best first: (id, score, rank, within_budget).

    ``modifiers`` is an array column. A budget in tokens lets calls pass while their running sum stays within it.
    """
    top = top or (TOP_K_BUDGET if budget else TOP_K)
    scored = entities.filter(F.col("type").isin(*CANDIDATE_TYPES)).select("id", priority(F.col("type"), F.col("doc_comment"), F.col("signature"), F.col("modifiers")).alias("score"))
    best = scored.orderBy(F.desc("score"), "id").limit(top)  # a top-k report
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    ranked = best.withColumn("rank", rank)
    return ranked.withColumn("within_budget", F.lit(True) if not budget else F.col("rank") * per_call <= budget)


def ungenerated(wanted: DataFrame, insights: DataFrame) -> DataFrame:
    """``wanted`` (entity_id, kind, prompt_version) without those that a live insight already serves."""
    live = insights.filter(~F.col("status").isin("superseded", "rejected")).select("entity_id", "kind", "prompt_version")
    return wanted.join(live, ["entity_id", "kind", "prompt_version"], "left_anti")


def uncached(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted`` (cache_key) without what the cache holds."""
    return wanted.join(cache.select("cache_key"), "cache_key", "left_anti")


def review_state(audits: DataFrame, order: tuple[str, ...] = ("at", "event_id")) -> DataFrame:
    """(insight_id, status, version, approved): the fold of an append-only trail; without a decision pending.

    Every action raises the version. Maxima by order combine before the shuffle.
    """
    status = F.create_map(*(F.lit(x) for pair in STATUS_AFTER.items() for x in pair))
    decided = F.when(F.col("action").isin(*STATUS_AFTER), F.struct(*order, status[F.col("action")].alias("status")))
    held = audits.groupBy("insight_id").agg(F.max(decided).alias("last"), F.count(F.lit(1)).alias("version"))
    found = F.coalesce(F.col("last.status"), F.lit("pending"))
    return held.select("insight_id", found.alias("status"), "version", (found == "approved").alias("approved"))


def illegal_transitions(audits: DataFrame, order: tuple[str, ...] = ("at", "event_id")) -> DataFrame:
    """Decisions on an insight that a decision has closed (rejected or superseded) before."""
    status = F.create_map(*(F.lit(x) for pair in STATUS_AFTER.items() for x in pair))
    rows = audits.withColumn("after", status[F.col("action")]).filter(F.col("after").isNotNull())
    before = F.lag("after").over(Window.partitionBy("insight_id").orderBy(*order))
    return rows.withColumn("before", before).filter(F.col("before").isin("rejected", "superseded") & (F.col("after") != "superseded"))


def restore_approved(insights: DataFrame, approvals: DataFrame) -> DataFrame:
    """``insights`` after a rebuild: approved if an approval is on record; approved without one becomes superseded."""
    held = approvals.select(F.col("insight_id").alias("id"), F.lit(True).alias("__ok")).distinct()
    status = F.when(F.col("__ok"), "approved").when(F.col("status") == "approved", "superseded").otherwise(F.col("status"))
    return insights.join(held, "id", "left").withColumn("status", status).select(*insights.columns)


def versions(audits: DataFrame) -> DataFrame:
    """(project_id, insight_version, graph_mtime): derived from the trail, so there is no counter to keep."""
    return audits.groupBy("project_id").agg(F.count(F.lit(1)).alias("insight_version"), F.max("at").alias("graph_mtime"))


def enrichment_order(entities: DataFrame, fan_out: DataFrame, heat: DataFrame) -> DataFrame:
    """(id, weight): priority by type weight, fan-out and change heat. ``fan_out``: (id, n); ``heat``: (id, changes)."""
    joined = entities.join(fan_out, "id", "left").join(heat, "id", "left")
    weight = F.col("weight") * (1 + F.coalesce("n", F.lit(0))) * (1 + F.coalesce("changes", F.lit(0)))
    return joined.select("id", weight.cast("long").alias("weight"))
