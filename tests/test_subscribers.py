"""Delivery to subscribers across restarts, and the URL of a session."""

import pytest
from pyspark.sql import functions as F

from factmill.streaming import subscribers

EVENT = "project_id string, run_id string, number int, type string, stage string"


def test_projects_of_urls(spark):
    want = {"ws://h/api/v1/ws/projects/p1": "p1", "/ws/projects/p2/": "p2", "ws://h/p3?token=a/b": "p3", "ws://h/p4#x/y": "p4", "ws://h/": None, "": None, "ws://h": None, "p5": "p5"}
    rows = spark.createDataFrame([(u,) for u in want], "url string").select("url", subscribers.project_of(F.col("url")).alias("p"))
    assert {r.url: r.p for r in rows.collect()} == want
    sessions = spark.createDataFrame([("s", "/a/p1"), ("s", "/b/p1/"), ("t", "/"), ("u", None)], "subscriber string, url string")
    assert [tuple(r) for r in subscribers.registry(sessions).collect()] == [("s", "p1")]


def test_a_killed_stream_delivers_nothing_twice(spark, tmp_path):
    """Events come late, repeated and out of order, and the stream dies after it has written a batch."""
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    given = [("p1", "r1", 0, "a", "x"), ("p1", "r1", 2, "c", "x"), ("p2", "r2", 0, "a", "y"), ("p3", "r9", 0, "a", "z")]
    registry = spark.createDataFrame([("s", "p1"), ("t", "p1"), ("t", "p2")], "subscriber string, project_id string")
    stream = lambda: spark.readStream.schema(EVENT).parquet(source)
    put = lambda rows: spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)

    def run(sent=None):
        subscribers.deliver_in_order(stream(), registry, path, checkpoint, sent, once=True).awaitTermination()

    def held():
        return sorted(map(tuple, spark.read.parquet(path).select("subscriber", "run_id", "number", "type").collect()))

    def dies(rows, n):
        raise RuntimeError("killed")

    put(given + given[:1])
    with pytest.raises(Exception, match="killed"):
        run(dies)  # the batch is written, but not on record as done
    run()
    first = [("s", "r1", 0, "a"), ("t", "r1", 0, "a"), ("t", "r2", 0, "a")]
    assert held() == first  # number 2 waits for number 1
    put([("p1", "r1", 1, "b", "x"), ("p1", "r1", 0, "a", "x"), ("p1", "r1", 2, "c", "x")])
    run()
    run()
    both = sorted(first + [(s, "r1", n, t) for s in "st" for n, t in ((1, "b"), (2, "c"))])
    assert held() == both
    table = spark.read.parquet(source).unionByName(spark.createDataFrame([("p1", "r1", 3, "d", "x")], EVENT))
    late = spark.createDataFrame([("s", "p1"), ("new", "p2")], "subscriber string, project_id string")
    left = subscribers.replay(table, late, spark.read.parquet(path))
    assert sorted((r.subscriber, r.run_id, r.number) for r in left.collect()) == [("new", "r2", 0), ("s", "r1", 3)]
