"""Delivery of run events to subscribers: each gets every event of its project once, in order, across restarts.

A subscriber's place in a run is state: the number that comes next, and events that came before it. Events are joined
with the registry (subscriber, project_id) of the time when the stream was started, and kept by subscriber and run, so
no project or run is one key. What is delivered carries (subscriber, run_id, number); a batch is written under its own
number and replaces what an earlier attempt at it has left, so a restart delivers nothing twice and loses nothing.
``replay`` reads from the table of events what a subscriber has not had, for those that join late.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELIVERED = "subscriber string, run_id string, number int, project_id string, type string, stage string"


def project_of(url: Column) -> Column:
    """The project that a subscriber asks for: the last segment of the path of its URL; null if there is none."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    return F.nullif(F.regexp_extract(F.regexp_replace(path, r"^[a-zA-Z]+://[^/]*", ""), r"([^/]+)/*$", 1), F.lit(""))


def registry(sessions: DataFrame) -> DataFrame:
    """(subscriber, project_id) of sessions (subscriber, url); a session without a project has no row, a repeated one one."""
    return sessions.select("subscriber", project_of(F.col("url")).alias("project_id")).filter("project_id is not null").distinct()


class InOrder(StatefulProcessor):
    """Events of one subscriber and run in the order of their numbers, from 0 on, each once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "number int")
        self.early = handle.getMapState("early", "number int", "event string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.next.get()[0] if self.next.exists() else 0
        out = []
        for batch in rows:
            for row in batch.itertuples(index=False):
                if row.number >= now and not self.early.containsKey((row.number,)):
                    self.early.updateValue((row.number,), (json.dumps([row.project_id, row.type, row.stage]),))
        while self.early.containsKey((now,)):
            out.append((*key, now, *json.loads(self.early.getValue((now,))[0])))
            self.early.removeKey((now,))
            now += 1
        self.next.update((now,))
        yield pd.DataFrame(out, columns=["subscriber", "run_id", "number", "project_id", "type", "stage"])

    def close(self) -> None:
        pass


def in_order(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """The stream ``events`` (project_id, run_id, number, type, stage) for each of ``subscribers`` (subscriber, project_id)."""
    session = events.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.join(subscribers, "project_id").select("subscriber", "run_id", "number", "project_id", "type", "stage")
    return rows.groupBy("subscriber", "run_id").transformWithStateInPandas(InOrder(), DELIVERED, "Append", "None")


def deliver_in_order(events: DataFrame, subscribers: DataFrame, path: str, checkpoint: str, sent=None, once: bool = False) -> StreamingQuery:
    """Write what ``in_order`` gives under ``path``, a folder for each batch; ``sent`` (rows, number) is told afterwards."""

    def write(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={n}")
        if sent is not None:
            sent(rows, n)

    writer = in_order(events, subscribers).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replay(events: DataFrame, subscribers: DataFrame, delivered: DataFrame) -> DataFrame:
    """What ``subscribers`` have not had of a table of ``events``: those from the number on that comes next for each."""
    had = delivered.groupBy("subscriber", "run_id").agg(F.max("number").alias("had"))
    rows = events.join(subscribers, "project_id").join(had, ["subscriber", "run_id"], "left").filter(F.col("number") > F.coalesce("had", F.lit(-1)))
    return rows.select("subscriber", "run_id", "number", "project_id", "type", "stage").distinct()
