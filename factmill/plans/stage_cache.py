"""Results of stages, addressed by what they were made from.

The key of a result is a hash of the stage, of the content of its input tables, of its configuration and of the
project's insight version. Before a stage runs its key is looked up in the log of the store; a hit names the table that
holds the result, and the stage is passed over. A review raises the insight version, so older results of the stages
that depend on it are found no more, and are dropped when the next one is put.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.insights import input_hash
from ..sources.store import Store

LOG = "stage_cache"
ENTRY = "key string, stage string, version string, held string, insight_version long, at timestamp"


def digest(df: DataFrame) -> str:
    """A hash of the rows of a table that does not depend on their order or on how they are stored."""
    columns = sorted(df.columns)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    one, two = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    sums = (F.sum((x.cast("decimal(38,0)"))) for x in (one, two))
    found = df.select(*columns).agg(F.count(F.lit(1)).alias("n"), *(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
    return f"{','.join(columns)}:{found.n}:{found.s0}:{found.s1}"


class StageCache:
    """The results in a store, by key. Two stages with one key are one result."""

    def __init__(self, store: Store):
        self.store = store

    def key(self, stage: str, inputs: dict[str, DataFrame], config: dict, insight_version: int = 0) -> str:
        content = "|".join(f"{name}={digest(df)}" for name, df in sorted(inputs.items()))
        row = self.store.spark.range(1).select(input_hash(F.lit(f"{stage}|{content}"), F.lit(insight_version), F.lit(json.dumps(config, sort_keys=True))))
        return row.first()[0]

    def find(self, key: str) -> str | None:
        """The name of the table that holds the result, if it is there."""
        row = self.store.read(LOG, ENTRY).filter(F.col("key") == key).orderBy(F.desc("at")).first()
        return row.held if row is not None and row.held in self.store.names() else None

    def put(self, key: str, stage: str, insight_version: int, result: DataFrame | None = None, held: str | None = None) -> str:
        """Keep a result: a table of its own, or one that is ``held`` already. Results of lower versions are dropped."""
        store = self.store
        old = [r.held for r in store.read(LOG, ENTRY).filter((F.col("stage") == stage) & (F.col("insight_version") < insight_version)).select("held").distinct().collect()]
        gone = {x for x in old if x.startswith(f"{stage}-")}
        held = held or f"{stage}-{key[:16]}"
        if result is not None:
            store.commit(**{held: result})
        entry = (key, stage, (store.versions() or [None])[-1], held, insight_version, datetime.datetime.now(datetime.UTC).replace(tzinfo=None))
        store.append(**{LOG: store.spark.createDataFrame([entry], ENTRY).coalesce(1)})
        store.drop(*(gone - {held}))
        return held
