"""Copies of one text that lie around the threshold: few of all pairs are links, and no bucket holds them all."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factmill.llm import near_dedup
from factmill.llm.common import stored


def altered(n, seed=5, words=200, changed=4):
    """``n`` copies of a text of ``words`` words, each with ``changed`` of them replaced."""
    r = random.Random(seed)
    text = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        copy = list(text)
        for at in r.sample(range(words), changed):
            copy[at] = f"x{r.randrange(10**9)}"
        out.append((i, " ".join(copy)))
    return out


def brute_force(rows, k, percent):
    """The least id that each row reaches, and the number of links."""
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (t.split() for _, t in rows)]
    number = {g: i for i, g in enumerate(set().union(*sets))}
    held = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        held[i, [number[g] for g in s]] = 1
    both, sizes = held @ held.T, held.sum(axis=1)
    linked = 100 * both >= percent * (sizes[:, None] + sizes - both)
    label = np.arange(len(rows))
    while True:
        least = np.where(linked, label[None, :], len(rows)).min(axis=1)
        if (least == label).all():
            return label.tolist(), int(linked.sum() - len(rows)) // 2
        label = least


@pytest.mark.parametrize("group", [8, near_dedup.GROUP])
def test_rounds_over_lists_lose_no_link(spark, monkeypatch, group):
    monkeypatch.setattr(near_dedup, "GROUP", group)
    rows = altered(300)
    want, links = brute_force(rows, 4, 80)
    assert links > 30 and len(set(want)) > 10
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == want


def rounds(spark, rows, most=near_dedup.GROUP, k=4, percent=80):
    """The components that the rounds over lists alone find, each row a component before, and the pairs they make."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = docs.select("text").repartition(8).mapInArrow(lambda b: near_dedup._sets(b, k), "node long, shingles array<long>, parity array<long>")
    sets = stored(sets, "sets")
    apart = sets.select(F.lit(0).alias("key"), "node", F.col("node").alias("label"))
    none = apart.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    mergers, made = near_dedup._rare_rounds(apart, sets, percent, none, most)
    for merged in mergers:
        apart = near_dedup._relabelled(apart, merged)
    return apart.select("label").distinct().count(), sum(m.count() for m in made)


def test_pairs_grow_with_rows_where_most_are_linked(spark):
    small, large = altered(300, changed=2), altered(600, changed=2)
    (some, few), (more, many) = (rounds(spark, x, 8) for x in (small, large))
    assert some == len(set(brute_force(small, 4, 80)[0])) and more == len(set(brute_force(large, 4, 80)[0]))
    assert many <= 3 * few  # twice the rows have four times the links
