"""Connected components of a table of links, by least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b: long): label is the least node that can be reached.

    Each round takes the least label of all neighbours, then the label of that label, so a path of n links is done in
    about log n rounds. Labels stay in tables; the driver sees one number a round.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        found = stored(least.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")), "labels")
        if not found.filter("old <> label").count():
            return found.select("node", "label")
        labels = found.select("node", "label")
