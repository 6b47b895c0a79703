"""Stage events as a stream: counts by window, and delivery to the subscribers of a project."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def counts(events: DataFrame, unit: str = "hour", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """(window, kind, n) of a table of events."""
    return events.groupBy(F.date_trunc(unit, time).cast("timestamp_ntz").alias("window"), kind).agg(F.count(F.lit(1)).alias("n"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "at", kind: str = "type") -> DataFrame:
    """The same of a stream: events more than ``late`` behind the newest are left out, so that the state is bounded."""
    found = events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "project_id", kind).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("window.start").alias("window"), "project_id", kind, "n")


def deliver(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hand every micro-batch to ``send`` (rows, number), sorted by project and time; at least once."""
    writer = events.writeStream.foreachBatch(lambda rows, n: send(rows.sortWithinPartitions("project_id", "at"), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_events(run: str, project: str, stages: list[tuple[str, str]], at) -> list[tuple]:
    """Rows of the model's events for the stages of a run: (type, stage) in order."""
    return [(project, run, kind, stage, None, at) for kind, stage in stages]
