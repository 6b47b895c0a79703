"""Joins of places with the source intervals that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.locations import contains

EXECUTABLE = ("Function", "Method", "Constructor", "Destructor")


def evidence_inside(evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """``evidence`` (ref, line, col) with a verdict: missing entity, outside its interval, or inside."""
    held = entities.select(F.col("id").alias("ref"), "start_line", "start_col", "end_line", "end_col", F.lit(True).alias("__known"))
    inside = contains(*(F.col(c) for c in ("start_line", "start_col", "end_line", "end_col", "line", "col")))
    verdict = F.when(F.col("__known").isNull(), "missing").when(inside, "inside").otherwise("outside")
    return evidence.join(held, "ref", "left").select(*evidence.columns, verdict.alias("verdict"))


def innermost(places: DataFrame, spans: DataFrame) -> DataFrame:
    """``places`` (place, file, line) with ``owner``: the smallest span (id, file, start_line, end_line, type) around.

    Executable spans come first; ties by start, then id; none gives null. Each span is cut to the fewest blocks whose
    sizes and places are powers of two and multiples of them, at most two of a size, and a block keeps only its best
    span. A line is in one block of each size, so it is held against as many rows as there are sizes, however many spans
    lie over one another.
    """
    shifted = lambda x, k: F.call_function("shiftright", x, k)
    start, end = F.col("start_line").cast("long"), F.col("end_line").cast("long")
    held = spans.filter(start < end)
    last = F.length(F.bin(end - start)) - 1  # the largest size that fits

    def pieces(k):
        low, high = shifted(start + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), shifted(end, k)
        at = lambda test, block: F.when((low < high) & (test % 2 != 0), F.struct(k.alias("level"), block.alias("block")))
        return F.array(at(low, low), at(high, high - 1))

    score = F.col("end_line") - F.col("start_line") - F.when(F.col("type").isin(*EXECUTABLE), 100000).otherwise(0)
    blocks = held.select("file", F.explode(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), last), pieces)))).alias("b"), F.struct(score.alias("score"), "start_line", "id").alias("span"))
    blocks = blocks.groupBy("file", "b.level", "b.block").agg(F.min("span").alias("span"))
    sizes = held.agg(F.max(last).alias("last"))
    asked = places.filter("line is not null").select("file", "line").distinct().join(F.broadcast(sizes), F.lit(True))  # one row
    asked = asked.select("file", "line", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("level")).withColumn("block", shifted(F.col("line").cast("long"), F.col("level")))
    lines = asked.join(blocks, ["file", "level", "block"]).groupBy("file", "line").agg(F.min("span").alias("span"))
    best = places.join(lines, ["file", "line"]).groupBy("place").agg(F.min("span").alias("b")).select("place", F.col("b.id").alias("owner"))
    return places.join(best, "place", "left")


def members_by_prefix(types: DataFrame, members: DataFrame) -> DataFrame:
    """(owner, member): members whose qualified name starts with that of a type and a dot.

    Every prefix of a member's name is looked up, an equi-join, instead of testing all pairs.
    """
    parts = F.split("qualified_name", r"\.")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    rows = members.filter(F.contains("qualified_name", F.lit("."))).select(F.col("id").alias("member"), F.col("qualified_name").alias("member_name"), F.explode(cuts).alias("owner_name"))
    return rows.join(types.select(F.col("id").alias("owner"), F.col("qualified_name").alias("owner_name")), "owner_name")


def nearest_by_position(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id): for each old relation the new one of the same source, type and target nearest in lines.

    Between places before and after, only the closest on either side can be nearest, so the rows of a key are merged in
    order and looked at with two running values instead of pairs.
    """
    key = ["source_id", "type", "target_id"]
    rows = old.select(*key, "line", F.lit(0).alias("side"), "id").unionByName(new.select(*key, "line", F.lit(1).alias("side"), "id"))
    near = F.when(F.col("side") == 1, F.struct("line", "id"))
    back = F.last(near, True).over(Window.partitionBy(*key).orderBy("line", F.desc("side"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(near, True).over(Window.partitionBy(*key).orderBy("line", F.desc("side"), F.desc("id")).rowsBetween(0, Window.unboundedFollowing))
    found = rows.withColumn("a", back).withColumn("b", ahead).filter("side = 0")
    nearer = F.when(F.col("b").isNull() | ((F.col("line") - F.col("a.line")) <= (F.col("b.line") - F.col("line"))), F.col("a.id")).otherwise(F.col("b.id"))
    return found.select(F.col("id").alias("old_id"), nearer.alias("new_id"))
