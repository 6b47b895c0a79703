"""Enrichment of entities by a language model that the caller plugs in; the default answers nothing and needs no network."""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.insights import cache_key, cleaned, confidence, evidence, structured, token_estimate
from ..sources.tables import cut
from .insights import candidates, uncached, ungenerated

# Which kinds of insight each type of entity gets.
KINDS = {"Class": ("summary", "tech_debt", "arch_role"), "Interface": ("summary", "tech_debt", "arch_role"), "Method": ("summary", "tech_debt")}
PROMPTS = {
    "summary": "Summarise ${name} in one JSON object with the fields summary and evidence.\n${code}",
    "tech_debt": "List what is wrong with ${name} as JSON with the fields issues and summary.\n${code}",
    "arch_role": "Name the role of ${name} as JSON with the fields role, upstream and downstream.\n${code}",
    "business_rule": "List the rules that ${name} holds as JSON with the fields rules and evidence.\n${code}",
}


@dataclass(frozen=True)
class ModelConfig:
    """Limits of the calls: budgets in tokens of a day and of a run (0: none), tries, failures in a row after which no
    more calls are made, calls at once, and calls of a wave at most."""

    model: str = "none"
    prompt_version: str = "v1"
    budget: int = 0
    tries: int = 3
    base_delay: float = 0.3
    failures: int = 5
    run_budget: int = 0
    concurrency: int = 4
    wave: int = 64


@dataclass(frozen=True)
class Meter:
    """What a run's calls have come to: failures in a row, tokens, calls, and why they ended early, if they did."""

    failed: int = 0
    run_tokens: int = 0
    day_tokens: int = 0
    calls: int = 0
    stopped: str | None = None


def wanted(entities: DataFrame, insights: DataFrame, cache: DataFrame, config: ModelConfig) -> DataFrame:
    """(entity_id, kind, prompt, cache_key, tokens): the calls to make, best entities first within the budget."""
    best = candidates(entities, config.budget or None).filter("within_budget").select("id", "rank")
    kinds = F.create_map(*(x for k, v in KINDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = entities.join(best, "id").select("*", F.explode(kinds[F.col("type")]).alias("kind"))
    code = F.concat_ws(" ", F.array_join(F.coalesce("modifiers", F.array().cast("array<string>")), " "), F.col("type"), F.col("qualified_name"), F.col("signature"), F.col("doc_comment"))
    prompt = F.create_map(*(F.lit(x) for pair in PROMPTS.items() for x in pair))[F.col("kind")]
    prompt = F.replace(F.replace(prompt, F.lit("${name}"), F.col("qualified_name")), F.lit("${code}"), code)
    made = rows.select(F.col("id").alias("entity_id"), "qualified_name", "kind", F.lit(config.prompt_version).alias("prompt_version"), prompt.alias("prompt"), "checksum", "rank")
    made = made.withColumn("cache_key", cache_key(F.col("entity_id"), F.concat_ws("/", "checksum", "kind"), F.lit(config.prompt_version), F.lit(config.model)))
    return uncached(ungenerated(made, insights), cache).withColumn("tokens", token_estimate(F.col("prompt")))


def call(rows: DataFrame, ask: Callable[[str, ModelConfig], str] | None, config: ModelConfig, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``rows`` with ``answer`` (null without one) and ``degraded``; see ``call_waves``."""
    return call_waves(rows, ask, config, sleep=sleep)[0]


def _asked(ask: Callable[[str, ModelConfig], str], config: ModelConfig):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for prompt in batch["prompt"]:
                try:
                    answers.append(ask(prompt, config))
                except Exception:  # any failure of the service counts alike
                    answers.append(None)
            yield batch[["__at"]].assign(answer=pd.Series(answers, dtype=object, index=batch.index))

    return run


def call_waves(
    rows: DataFrame, ask: Callable[[str, ModelConfig], str] | None, config: ModelConfig, spent_today: int = 0, meter: Meter | None = None, sleep: Callable[[float], None] = time.sleep
) -> tuple[DataFrame, Meter]:
    """``rows`` (cache_key, prompt, tokens, rank) with ``answer`` and ``degraded``, and the meter of the run.

    Calls are made in waves by rank, at most ``concurrency`` at once. A wave is one attempt each; what fails is tried
    again in the next one, after a delay that doubles. After a wave its failures in a row and its tokens are folded in
    order of rank into the meter, which the next wave starts from; so the breaker and both budgets are those of the run,
    however many tasks there are. The first wave has no more calls than may fail in a row, and waves double while none
    fails: a service that is down costs ``failures`` calls. An attempt is made only if its tokens fit into what is left
    of both budgets. Rows that get no answer are degraded. No more than a wave's outcomes reach the driver at once.
    """
    meter = meter or Meter(day_tokens=spent_today)
    # places in order, by ranges: nothing gathers the rows in one task
    cost = F.coalesce("tokens", token_estimate(F.col("prompt"))).alias("__cost")
    listed = cut(rows.repartitionByRange("rank", "cache_key").sortWithinPartitions("rank", "cache_key").withColumn("__part", F.spark_partition_id()).withColumn("__cost", cost))
    sizes = {r[0]: r[1] for r in listed.groupBy("__part").count().collect()}
    begins, n = {}, 0
    for part in sorted(sizes):
        begins[part] = n
        n += sizes[part]
    begin = F.create_map(*(F.lit(x) for pair in (begins or {0: 0}).items() for x in pair))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("rank", "cache_key"))
    listed = cut(listed.withColumn("__at", (inside - 1 + begin[F.col("__part")]).cast("long")).drop("__part"))
    spark, answered, again, at, size = rows.sparkSession, None, {}, 0, config.failures - meter.failed
    while ask is not None and meter.stopped is None and (at < n or again):
        room = max(1, min(size, config.wave))
        tries = dict(sorted(again.items())[:room])
        fresh = range(at, min(n, at + room - len(tries)))
        wanted_ = spark.createDataFrame([(x,) for x in [*tries, *fresh]], "__at long")
        mine = listed.join(F.broadcast(wanted_), "__at").select("__at", "prompt", "__cost")  # at most a wave
        costs = {r[0]: r[1] for r in mine.select("__at", "__cost").collect()}
        left = [b - used for b, used in ((config.run_budget, meter.run_tokens), (config.budget, meter.day_tokens)) if b]
        taken, sum_ = [], 0
        for x in [*tries, *fresh]:
            if any(sum_ + costs[x] > b for b in left):
                meter = dataclasses.replace(meter, stopped="budget")
                break
            sum_ += costs[x]
            taken.append(x)
        if not taken:
            break
        if tries:
            sleep(min(config.base_delay * 2 ** (max(tries.values()) - 1), 15))
        made = mine.filter(F.col("__at").isin(taken)).repartition(min(config.concurrency, len(taken))).mapInPandas(_asked(ask, config), "__at long, answer string")
        made = cut(made)
        good = {r[0]: r[1] for r in made.select("__at", F.col("answer").isNotNull()).collect()}
        failed = meter.failed
        for x in taken:
            failed = 0 if good[x] else failed + 1
            if good[x]:
                again.pop(x, None)
            elif again.get(x, 0) + 1 < config.tries:
                again[x] = again.get(x, 0) + 1
            else:
                again.pop(x, None)
            if failed >= config.failures:
                meter = dataclasses.replace(meter, stopped="breaker")
        at = max(at, 1 + max((x for x in taken if x in fresh), default=at - 1))
        size = size * 2 if all(good.values()) else config.failures - failed
        meter = dataclasses.replace(meter, failed=failed, run_tokens=meter.run_tokens + sum_, day_tokens=meter.day_tokens + sum_, calls=meter.calls + len(taken))
        made = made.filter("answer is not null")
        answered = made if answered is None else answered.unionByName(made)
    answered = answered if answered is not None else spark.createDataFrame([], "__at long, answer string")
    found = listed.join(answered, "__at", "left").withColumn("degraded", F.col("answer").isNull())
    return found.select(*rows.columns, "answer", "degraded"), meter


def insights_of(answers: DataFrame) -> DataFrame:
    """Pending insights of the answers: fields filled by kind, confidence and evidence read."""
    content = structured(F.col("answer"), F.col("kind"), F.col("entity_id"), F.col("qualified_name"))
    return answers.select(
        F.concat(F.lit("llm-"), F.substring("cache_key", 1, 16)).alias("id"), "entity_id", "kind", F.to_json(content).alias("content"), confidence(cleaned(F.col("answer"))).alias("confidence"),
        evidence(cleaned(F.col("answer")), F.col("entity_id")).alias("evidence"), "prompt_version", F.lit("pending").alias("status"), "degraded", "cache_key",
    )


def summary(made: DataFrame) -> DataFrame:
    """(generated, degraded): counts of an enrichment."""
    return made.agg(F.count_if(~F.col("degraded")).alias("generated"), F.count_if(F.col("degraded")).alias("degraded"))
