"""MinHash near-dedup with tensored banding.

A document's set is that of its distinct shingles of words. Banding with L tables of K minhashes each would take K * L
hash functions. Here two smaller collections of short bands are hashed, ``left`` bands of two minhashes and ``right``
bands of one, and each table's key is a pair of one band of either, so left * right tables of three minhashes cost
2 * left + right hash functions: about a square root of the work. With the default 12 and 8, two sets of similarity 0.8
share no key with probability 8e-6 at most, and more alike ones less.

Steps, all as tables:

1. Documents with one set are one node; only a node for each distinct set goes on, so copies are never paired.
2. Bands that a single node has are of no use: a bit map of bounded size tells which are shared, and keys are made of
   shared bands alone. This loses no pair.
3. In every bucket of a key all nodes are compared with its most central one, and the pairs are verified on the full
   sets. The links found give components, so a large group of near copies costs a pair for each copy, not for each two.
4. Buckets that hold several components get rounds of further centres, drawn by hash. A round compares a centre with the
   nodes of other components, and components that it links are contracted. A bucket stays in as long as a round halves
   the number of its components, so it takes a logarithm of its size in rounds and a pair a node in each.
   Buckets draw their centres independently, so a dense group is tied together in a round or two.
5. Among nodes that are still apart from others of their bucket, all pairs that may be links are found by their rarest
   shingles (an exact filter), and verified too. Nodes for which no list of a shingle holds a partner of fitting size
   leave before any pair is made. Long lists are held in groups that grow from round to round, and what is linked is
   contracted in between, so that pairs within a component are not made. There is no cap anywhere.

Documents without words (or with a null text) are linked with nothing. Rows with one doc_id are joined by their sets
alone; a null doc_id names a component only if all its rows have one. Shingles are held to be equal, and sets too, if
their 64-bit hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, BitMap, bit_map, carried, constants, flat, grams, hashes, mix, pieces, signed, spans, stored
from .components import components

LEFT, RIGHT = 12, 8
PARITY = 1024
GROUP, GROWTH = 64, 4


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of k words, or of all its words if they are fewer."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, NOT_SPACE)
    words = hashes(data, starts, ends)
    shingles = grams(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(shingles[a : b - k + 1]) if b - a >= k else grams(words[a:b], b - a) if b > a else words[:0]


def minhashes(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The least image of the set under each multiplier, as 32 bits."""
    least = np.full(len(multipliers), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(values), 4096):
        part = (values[at : at + 4096, None] ^ multipliers[::-1]) * multipliers
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0), out=least)
    return mix(least).astype(np.uint32)


def parity(values: np.ndarray) -> np.ndarray:
    """Whether an odd number of values falls on each of PARITY bits, as 64-bit words.

    Two sets differ in at least as many values as their parities differ in bits.
    """
    odd = np.bincount((values >> np.uint64(32)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch], k: int, n: int) -> Iterator[pa.RecordBatch]:
    multipliers = constants(31, n)
    for batch in pieces(batches):
        sizes, nodes, prints = [], [], []
        for values in shingle_sets(batch.column("text"), k):
            sizes.append(len(values))
            nodes.append(xxhash.xxh3_64_intdigest(values.tobytes()) if len(values) else None)
            prints.append(minhashes(values, multipliers).tobytes() if len(values) else None)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").cast(pa.int64()),
            "text_hash": batch.column("text_hash"),
            "node": pa.array(nodes, pa.uint64()).view(pa.int64()),
            "n_shingles": pa.array(sizes, pa.int64()),
            "prints": pa.array(prints, pa.binary()),
        })


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = list(shingle_sets(batch.column("text"), k))
        nodes = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64)
        values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(signed(np.concatenate([*sets, np.empty(0, np.uint64)]))))
        bits = np.stack([parity(x) for x in sets])
        parities = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, PARITY // 64), pa.int32()), pa.array(bits.reshape(-1)))
        yield pa.RecordBatch.from_pydict({"node": pa.array(signed(nodes)), "shingles": values, "parity": parities})


def _bands(batch: pa.RecordBatch, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    prints = np.frombuffer(b"".join(batch.column("prints").to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
    pairs = (prints[:, 0 : 2 * left : 2] << np.uint64(32)) | prints[:, 1 : 2 * left : 2]
    return mix(pairs ^ constants(32, left)), mix(prints[:, 2 * left :] ^ constants(33, right))


def _shared_candidates(batches: Iterator[pa.RecordBatch], left: int, right: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"band": pa.array(signed(np.concatenate(_bands(batch, left, right), axis=1).reshape(-1)))})


def _keys(batches: Iterator[pa.RecordBatch], left: int, right: int, shared: BitMap) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = _bands(batch, left, right)
        row, i, j = np.nonzero(shared.holds(a)[:, :, None] & shared.holds(b)[:, None, :])
        key = mix(a[row, i] * constants(34, 1)[0] + b[row, j])
        yield pa.RecordBatch.from_pydict({"key": pa.array(signed(key)), "node": batch.column("node").take(pa.array(row))})


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    found = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).cast("long").alias("sum"))
    return found.filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def _near_enough(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and parities do not rule out: an exact filter that reads no set."""
    for s in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(s), F.size("shingles").alias(f"size_{s}"), F.col("parity").alias(f"parity_{s}")), s)
    return pairs.filter(_may_link(percent)).drop("size_a", "size_b", "parity_a", "parity_b")


def _may_link(percent: int) -> F.Column:
    """Whether size_a, size_b, parity_a and parity_b allow a link."""
    both = F.col("size_a") + F.col("size_b")
    differ = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY // 64)), F.lit(0))
    return (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")) & ((100 + percent) * (both - differ) >= 2 * percent * both)


def _mixed(labelled: DataFrame) -> DataFrame:
    """The rows (key, node, label) of the buckets that hold several components."""
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    return labelled.join(mixed, "key")


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` with the labels that ``merged`` (node: an old label, label) gives to their old ones."""
    merged = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return rows.join(merged, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")


def _centre_rounds(apart: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """What is apart (key, node, label) after rounds of further centres, and the mergers of labels of each round."""
    mergers, active, number = [], apart, 0
    while not active.isEmpty():
        number += 1
        centre = F.max(F.struct(F.xxhash64("key", "node", F.lit(number)).alias("draw"), "node", "label")).alias("c")
        centres = active.groupBy("key").agg(centre).select("key", F.col("c.node").alias("c"), F.col("c.label").alias("other"))
        pairs = active.join(centres, "key").filter("label <> other")
        pairs = pairs.select(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b")).distinct()
        links = stored(_verified(_near_enough(pairs, sets, percent), sets, percent), "verified")
        links = _merged(links, active.select("node", "label").distinct())
        if links.isEmpty():
            break
        merged = components(links)
        mergers.append(merged)
        before = active.select("key", "node", F.col("label").alias("was"))
        after = stored(_relabelled(active, merged).join(before, ["key", "node"]), "apart")
        fewer = after.groupBy("key").agg(F.countDistinct("was").alias("was"), F.countDistinct("label").alias("now"))
        fewer = fewer.filter("now > 1 and 2 * now <= was").select("key")
        active = stored(after.drop("was").join(fewer, "key"), "apart")
    for merged in mergers:
        apart = _relabelled(apart, merged)
    return (stored(_mixed(apart), "apart") if mergers else apart), mergers


def _merged(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of components that ``links`` joins; ``labels`` (node, label) names the component of each node."""
    for s in "ab":
        links = links.join(labels.select(F.col("node").alias(s), F.col("label").alias(f"l{s}")), s)
    return stored(links.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "merged")


def _with_partners(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (shingle, node, label, size, left) whose list has several components and a partner of fitting size.

    With ``left`` of its shingles from this one on, a node can be linked to one of (100 + percent) * left / percent - size
    shingles at most. So a row whose node is larger than what any of its list can be linked to makes no pair. ``big`` is
    the component with the most nodes in the list, and ``outside`` the number of nodes outside of it.
    """
    most = F.max(F.floor((100 + percent) * F.col("left") / percent) - F.col("size")).alias("most")
    lists = rows.groupBy("shingle", "label").agg(most, F.count(F.lit(1)).alias("n"))
    big = F.max(F.struct("n", "label")).alias("big")
    lists = lists.groupBy("shingle").agg(F.max("most").alias("most"), big, F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"))
    lists = lists.filter("labels > 1").select("shingle", "most", F.col("big.label").alias("big"), (F.col("n") - F.col("big.n")).alias("outside"))
    return rows.drop("big", "outside").join(stored(lists, "lists"), "shingle").filter("size <= most").drop("most")


def _rare_rows(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each node that is apart: (shingle, node, label, size, left, parity, big, outside).

    In any order that holds for all shingles, from the first one on that both have there must be as many left in either
    set as both must have in common. A shingle of one node alone joins nothing, so nodes with enough of their own drop
    out, as do those without a fitting partner.
    """
    label = apart.select("node", "label").distinct()
    rows = sets.join(label, "node").select("node", "label", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    rows = rows.join(often, "shingle")
    held = F.count(F.lit(1)).over(Window.partitionBy("node"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))
    rows = rows.withColumn("own", F.col("size") - held).withColumn("left", F.col("size") - F.col("own") - rank + 1).drop("own", "often")
    rows = stored(_with_partners(rows.filter(100 * F.col("left") >= percent * F.col("size")), percent), "rare")
    return stored(_with_partners(rows, percent).join(sets.select("node", "parity"), "node"), "rare")


def _with_reach(rows: DataFrame) -> DataFrame:
    """``rows`` with ``reach``: the most that are outside in any list of any node of the list."""
    far = rows.groupBy("node").agg(F.max("outside").alias("far"))
    reach = rows.select("shingle", "node").join(far, "node").groupBy("shingle").agg(F.max("far").alias("reach"))
    return rows.join(stored(reach, "lists"), "shingle")


def _rare_pairs(rows: DataFrame, most: int, percent: int) -> DataFrame:
    """Pairs of nodes of different components in one group of a list, but those whose parities show too many differences.

    A list is cut into the least power of two of groups in which about ``most`` nodes at most are outside its largest
    component, or as many as a longer list of one of its nodes needs. Nodes go by a hash of their own and of the round. So
    the lists that two nodes share are cut alike, and have both in one group or none does: a round sees a share of all
    pairs, not a share of the places of every pair. And as each round groups anew, the components that one round ties
    together within its groups are tied to each other by the next.
    """
    groups = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("reach") / F.lit(most))))).cast("long")
    rows = rows.withColumn("group", F.pmod(F.xxhash64("node", F.lit(most)), groups))
    # of two components one is not the list's largest: a group costs its nodes outside that one, times all of them
    columns = ("node", "label", "size", "left", "parity")
    one, two = (x.select("shingle", "group", *(F.col(c).alias(f"{c}_{s}") for c in columns)) for s, x in (("a", rows.filter("label <> big")), ("b", rows)))
    may = F.col("label_a") != F.col("label_b")
    for s in "ab":  # if this shingle is the first that both have, enough must be left from it on
        may &= (100 + percent) * F.col(f"left_{s}") >= percent * (F.col("size_a") + F.col("size_b"))
    return one.join(two, ["shingle", "group"]).filter(may & _may_link(percent)).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _rare_rounds(apart: DataFrame, sets: DataFrame, percent: int, known: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The mergers of labels, and the pairs verified, of each round over the lists of rare shingles.

    ``known`` are pairs that need no verifying again. A list that is not cut is done with after its round. The others
    come again with GROWTH times as many nodes in a group, after what was linked is contracted. So all pairs that may be
    links are made in the end, but for those within one component: where links are many, most nodes are joined by a
    share of them, and the lists end early.
    """
    mergers, made = [], []
    rows = _with_reach(_rare_rows(apart, sets, percent))
    while not rows.isEmpty():
        pairs = stored(_rare_pairs(rows, most, percent).join(known, ["a", "b"], "left_anti"), "pairs")
        made.append(pairs)
        known = known.unionByName(pairs)
        links = _merged(_verified(pairs, sets, percent), rows.select("node", "label").distinct())
        rows = rows.filter(F.col("reach") > most).drop("reach")
        if not links.isEmpty():
            mergers.append(components(links))
            rows = _relabelled(rows, mergers[-1])
        rows = _with_reach(stored(_with_partners(stored(rows, "rare"), percent), "rare"))
        most *= GROWTH
    return mergers, made


def _labelled(docs: DataFrame, k: int, percent: int, left: int = LEFT, right: int = RIGHT) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and (node, doc_id, label): the component of every node, with a doc_id that has it."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    n = 2 * left + right
    signatures = stored(docs.mapInArrow(lambda b: _signatures(b, k, n), "doc_id long, text_hash long, node long, n_shingles long, prints binary"), "signatures")
    held = signatures.filter("n_shingles > 0")
    nodes = held.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("prints").alias("prints"))
    nodes = stored(nodes, "nodes")

    bands = nodes.select("prints").mapInArrow(lambda b: _shared_candidates(b, left, right), "band long")
    shared = stored(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band"), "shared-bands")
    filter_ = bit_map(shared, shared.count())
    keys = nodes.select("node", "prints").mapInArrow(lambda b: _keys(b, left, right, filter_.value), "key long, node long")
    keys = stored(keys, "keys")

    # in each bucket its most central node, the one with the most company in all its buckets, is held against the others
    crowd = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keys = stored(keys.join(crowd, "key"), "keys")
    company = keys.groupBy("node").agg(F.sum("n").alias("company"))
    keys = stored(keys.drop("n").join(company, "node"), "keys")
    wanted = keys.select("node").distinct().join(nodes, "node").select(F.col("doc_id").alias("__id")).distinct()
    sets = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    sets = sets.select("text").mapInArrow(lambda b: _sets(b, k), "node long, shingles array<long>, parity array<long>")
    sets = stored(sets.dropDuplicates(["node"]).filter(F.size("shingles") > 0), "sets")

    centres = keys.groupBy("key").agg(F.max(F.struct("company", "node")).alias("c")).select("key", F.col("c.node").alias("a"))
    pairs = keys.join(centres, "key").filter("node <> a").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    pairs = stored(pairs, "pairs")
    links = stored(_verified(pairs, sets, percent), "verified")
    labels = components(links)

    # what is still apart within a bucket
    labelled = keys.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    apart = stored(_mixed(labelled), "apart")
    if not apart.isEmpty():
        apart, mergers = _centre_rounds(apart, sets, percent)
        if not apart.isEmpty():
            mergers += _rare_rounds(apart, sets, percent, pairs, GROUP)[0]
        if mergers:
            labels = nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
            for merged in mergers:
                labels = _relabelled(labels, merged)
            labels = stored(labels, "labels")

    return signatures, nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))


def near_components(docs: DataFrame, k: int = 4, percent: int = 80, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; links join sets with 100 * both >= ``percent`` * either."""
    signatures, named = _labelled(docs, k, percent, left, right)
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "label").select("node", "component_id")
    found = signatures.select("doc_id", "node", "n_shingles").join(named, "node", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_dedup(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; the least doc_id of a component is kept."""
    return near_components(docs, k, percent).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that with the least doc_id (null last), then the least text hash.

    Rows are told apart by doc_id and the hash of their text. Repeated rows of one doc_id and one text are one document,
    which stays or goes as a whole; rows with a null doc_id are documents of their own, so of equal ones a single row
    stays. Rows without words are linked with nothing and stay.
    """
    docs, back = carried(docs, "doc_id", "text")
    signatures, named = _labelled(docs, k, percent)
    rows = signatures.filter("n_shingles > 0").select("doc_id", "text_hash", "node")
    rows = rows.groupBy("doc_id", "text_hash", "node").agg(F.count(F.lit(1)).alias("n")).join(named.select("node", "label"), "node")
    rows = stored(rows.select("label", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").alias("row"), "n"), "near-rows")
    least = rows.groupBy("label").agg(F.min("row").alias("least"))
    # what goes whole; and null ids of which one row must be picked among equal ones
    gone = rows.join(least, "label").filter((F.col("row") != F.col("least")) | (F.col("row.none") & (F.col("n") > 1)))
    gone = stored(gone.select(F.col("row.doc_id").alias("__id"), F.col("row.text_hash").alias("__hash"), (F.col("row") == F.col("least")).alias("__one")), "near-gone")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    kept = docs.join(gone, same, "left_anti")
    picked = gone.filter("__one")
    if not picked.isEmpty():
        one = docs.filter("doc_id is null").join(picked.select("__hash"), F.xxhash64("text") == F.col("__hash")).dropDuplicates(["__hash"])
        kept = kept.unionByName(one.select(*docs.columns))
    return kept.select(*back)


SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(w[p : p + k - 1], ' ') AS g
    FROM (SELECT r, doc_id, w, least(4, len(w)) AS k, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
l AS (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r JOIN n x ON x.r = a.r JOIN n y ON y.r = b.r
    GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
c AS (SELECT r AS root, r FROM d UNION SELECT c.root, l.b FROM c JOIN l ON c.r = l.a),
m AS (SELECT c.root AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.r GROUP BY c.root)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (r) JOIN m USING (r)
"""
