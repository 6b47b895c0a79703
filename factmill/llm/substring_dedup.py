"""Substring dedup with suffix automata over shards of the passages that repeat.

A window is ``window`` consecutive words of one document. A word goes if some window over it also starts earlier: in a
document of smaller doc_id, or before in the same one. Automata of a whole corpus can be broadcast to no one, so they
are built over shards that hold what may match and nothing else, and the passages come to them:

1. Every window has an anchor: the least hash among its runs of ``anchor`` words, the first of equals. Equal windows
   have equal anchors at equal places, and neighbouring windows mostly share theirs. Anchors are counted over all
   documents, and those found twice or more are put into a bit map of bounded size, which is broadcast.
2. The documents are streamed again. For each anchor that may repeat, the words of its windows, a passage, go to the
   shard of the anchor's hash. A shard takes its passages in order of document and place: it streams each through the
   suffix automaton of the earlier ones, whose matching statistics tell which windows have been before, and then adds
   the passage to the automaton. A passage equal to an earlier one is not added again.
3. An anchor with more than ``HOT`` places is no shard by itself. Its passages are first held against equal ones, in
   the same document before any shuffle, then by a combining minimum of their places. The windows of those that are
   left are dealt singly, by their own hashes, in the same way.
4. The windows found are gathered by document, and their words removed.

False positives of the bit map cost work and change nothing. Anchors are 64-bit hashes of words; windows of one anchor
are the same if 40 more bits of each word are the same.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A null text has none. Rows that agree in doc_id and text are one document
and get the same result; of rows that agree in doc_id alone one is the earlier. A null doc_id comes last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, BitMap, bit_map, constants, flat, grams, hashes, mix, pieces, signed, spans, stored

WINDOW, ANCHOR = 20, 10
HOT = 2000
_TOKEN = 5  # bytes
_ANCHOR = constants(62, 1)[0]


# --- automata --------------------------------------------------------------------------------------------------------


class SuffixAutomaton:
    """Of a growing list of sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0

    def add(self, sequence) -> None:
        for symbol in (*sequence, None if len(self.next) == 1 else -len(self.next)):  # an end of its own
            self._extend(symbol)

    def _extend(self, symbol) -> None:
        following, link, length = self.next, self.link, self.length
        new = len(following)
        following.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        at = self.last
        while at >= 0 and symbol not in following[at]:
            following[at][symbol] = new
            at = link[at]
        if at >= 0:
            found = following[at][symbol]
            if length[found] == length[at] + 1:
                link[new] = found
            else:
                copy = len(following)
                following.append(dict(following[found]))
                length.append(length[at] + 1)
                link.append(link[found])
                while at >= 0 and following[at].get(symbol) == found:
                    following[at][symbol] = copy
                    at = link[at]
                link[found] = link[new] = copy
        self.last = new

    def matching_statistics(self, sequence) -> list[int]:
        """For each place the length of the longest match that ends there."""
        following, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for symbol in sequence:
            while state and symbol not in following[state]:
                state = link[state]
                size = length[state]
            if symbol in following[state]:
                state = following[state][symbol]
                size += 1
            out.append(size)
        return out


# --- anchors ---------------------------------------------------------------------------------------------------------


class Passages:
    """The windows of a slice of documents, in runs with one anchor."""

    def __init__(self, column: pa.Array, window: int, anchor: int):
        data, offsets = flat(column)
        starts, ends, self.first = spans(data, offsets, NOT_SPACE)
        self.words, self.window = hashes(data, starts, ends), window
        sizes = np.diff(self.first)
        n = np.maximum(0, sizes - window + 1)
        doc = np.repeat(np.arange(len(sizes)), n)
        at = self.first[:-1][doc] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)  # where windows start
        gram = grams(self.words, anchor)
        least, place = gram[at], at.copy()
        for step in range(1, window - anchor + 1):
            other = gram[at + step]
            less = other < least
            least[less] = other[less]
            place[less] = at[less] + step
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        # minima crowd near 0, and both the bit map and the shards go by the first bits, so they are mixed again
        self.anchor, self.begin, self.doc = mix(least[head] ^ _ANCHOR), at[head], doc[head]
        self.count = np.diff(np.append(head, len(at)))  # windows of the run


def _anchors(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        values, times = np.unique(Passages(batch.column("text"), window, anchor).anchor, return_counts=True)
        yield pa.RecordBatch.from_pydict({"anchor": pa.array(signed(values)), "n": pa.array(times.astype(np.int64))})


def _passages(batches: Iterator[pa.RecordBatch], window: int, anchor: int, repeated: BitMap, hot: BitMap) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = Passages(batch.column("text"), window, anchor)
        runs = np.flatnonzero(repeated.holds(found.anchor) & ~hot.holds(found.anchor))
        data = np.ascontiguousarray(found.words).view(np.uint8).reshape(-1, 8)[:, :_TOKEN].tobytes()
        begin, end = found.begin[runs], found.begin[runs] + found.count[runs] + window - 1
        doc = pa.array(found.doc[runs])
        yield pa.RecordBatch.from_pydict({
            "anchor": pa.array(signed(found.anchor[runs])),
            "doc_id": batch.column("doc_id").cast(pa.int64()).take(doc),
            "mark": batch.column("mark").take(doc),
            "start": pa.array((begin - found.first[found.doc[runs]]).astype(np.int32)),
            "words": pa.array([data[a * _TOKEN : b * _TOKEN] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()),
        })


def _hot_runs(batches: Iterator[pa.RecordBatch], window: int, anchor: int, hot: BitMap) -> Iterator[pa.RecordBatch]:
    """Runs of windows with a hot anchor: a hash of the run's words, and of each window. ``again``: its document had it."""
    c = constants(61, 3)
    for batch in pieces(batches):
        found = Passages(batch.column("text"), window, anchor)
        runs = np.flatnonzero(hot.holds(found.anchor))
        n, begin, doc = found.count[runs], found.begin[runs], found.doc[runs]
        whole = grams(found.words, window)
        ends = np.cumsum(n)
        at = np.repeat(begin - (ends - n), n) + np.arange(int(n.sum()))
        run = mix(whole[begin] * c[0] + whole[begin + n - 1] * c[1] + n.astype(np.uint64) * c[2])
        order = np.lexsort((begin, run, doc))
        again = np.zeros(len(run), bool)
        again[order[1:]] = (run[order[1:]] == run[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        yield pa.RecordBatch.from_pydict({
            "run": pa.array(signed(run)),
            "doc_id": batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)),
            "mark": batch.column("mark").take(pa.array(doc)),
            "start": pa.array((begin - found.first[doc]).astype(np.int32)),
            "windows": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(signed(whole[at]))),
            "again": pa.array(again),
        })


def _shards(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, document and place: the intervals of words whose windows have been before."""
    current = previous = automaton = None
    seen: set[bytes] = set()
    waiting: bytes | None = None  # the first passage, until a second one needs the automaton
    tokens = lambda x: [x[i : i + _TOKEN] for i in range(0, len(x), _TOKEN)]
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("anchor", "doc_id", "mark", "start", "words")]
        for anchor, doc, mark, start, words in zip(*columns, strict=True):
            if anchor != current:
                current, automaton, waiting = anchor, None, None
                seen.clear()
            elif (doc, mark, start) == previous:  # a repeated row
                continue
            previous = (doc, mark, start)
            size = len(words) // _TOKEN
            if words in seen:
                out.append((doc, mark, start, start + size))
                continue
            seen.add(words)
            if waiting is None:
                waiting = words
                continue
            if automaton is None:
                automaton = SuffixAutomaton()
                automaton.add(tokens(waiting))
            sequence = tokens(words)
            begin = end = None
            for at, length in enumerate(automaton.matching_statistics(sequence)):
                if length >= window:
                    if begin is None or at - window + 1 > end:
                        if begin is not None:
                            out.append((doc, mark, start + begin, start + end))
                        begin = at - window + 1
                    end = at + 1
            if begin is not None:
                out.append((doc, mark, start + begin, start + end))
            automaton.add(sequence)
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "mark", "start", "stop"])


# --- the operator ----------------------------------------------------------------------------------------------------


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot_places: int = HOT) -> DataFrame:
    """(doc_id, mark, start, stop): intervals of words under windows that also start earlier; they may overlap.

    ``docs``: doc_id, text and mark, a hash of the text.
    """
    counts = docs.select("text").mapInArrow(lambda b: _anchors(b, window, anchor), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    counts = stored(counts.filter("n > 1"), "anchors")
    repeated = bit_map(counts.select("anchor"), counts.count())
    often = counts.filter(F.col("n") > hot_places).select("anchor")
    n_hot = often.count()
    hot = bit_map(often, n_hot)

    parts = docs.select("doc_id", "mark", "text").mapInArrow(lambda b: _passages(b, window, anchor, repeated.value, hot.value), "anchor long, doc_id long, mark long, start int, words binary")
    order = [F.col("anchor"), F.col("doc_id").asc_nulls_last(), F.col("mark"), F.col("start")]
    found = parts.repartition("anchor").sortWithinPartitions(*order).mapInArrow(lambda b: _shards(b, window), "doc_id long, mark long, start int, stop int")

    return found.unionByName(_hot_repeats(docs, window, anchor, hot)) if n_hot else found


def _hot_repeats(docs: DataFrame, window: int, anchor: int, hot) -> DataFrame:
    """The same for the windows of hot anchors: whole runs first, then the windows of what runs are left."""
    runs = docs.select("doc_id", "mark", "text").mapInArrow(lambda b: _hot_runs(b, window, anchor, hot.value), "run long, doc_id long, mark long, start int, windows array<long>, again boolean")
    runs = stored(runs, "hot-runs")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "start")
    fresh = runs.filter("not again")
    least = fresh.groupBy("run").agg(F.min(place).alias("least"))
    held = stored(fresh.join(least, "run").select("doc_id", "mark", "start", "windows", (~place.eqNullSafe(F.col("least"))).alias("again")), "hot-runs")
    later = runs.filter("again").drop("run").unionByName(held.filter("again").select("doc_id", "mark", "start", "windows", "again"))
    later = later.select("doc_id", "mark", "start", (F.col("start") + F.size("windows") + window - 1).alias("stop"))
    single = held.filter("not again").select("doc_id", "mark", F.posexplode("windows").alias("i", "hash"), F.col("start").alias("begin"))
    single = single.select("hash", "doc_id", "mark", (F.col("begin") + F.col("i")).alias("start"))
    first = single.groupBy("hash").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash", "least")
    again = single.join(first, "hash").filter(~place.eqNullSafe(F.col("least")))
    return later.unionByName(again.select("doc_id", "mark", "start", (F.col("start") + window).alias("stop")))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offsets = flat(batch.column("text"))
        whole = data.tobytes()
        total, gone, texts = [], [], []
        for a, b, cut in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("__cut").to_pylist(), strict=True):
            words = whole[a:b].split()
            total.append(len(words))
            if cut:
                change = np.zeros(len(words) + 1, np.int32)
                np.add.at(change, [x["start"] for x in cut], 1)
                np.add.at(change, [x["stop"] for x in cut], -1)
                words = [w for w, c in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not c]
            gone.append(total[-1] - len(words))
            texts.append(b" ".join(words))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").cast(pa.int64()),
            "n_words": pa.array(total, pa.int64()),
            "n_removed": pa.array(gone, pa.int64()),
            "kept": pa.array(texts, pa.binary()),
        })


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot_places: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` is the words that stay, joined by one space, as UTF-8."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    cuts = repeats(docs, window, anchor, hot_places).groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_list(F.struct("start", "stop")).alias("__cut"))
    found = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left").select("doc_id", "text", "__cut")
    return found.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept binary")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    return stored(dedup_substrings(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "substrings")


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, p, array_to_string(w[p : p + 19], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
o AS (SELECT r, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM p),
g AS (SELECT DISTINCT r, unnest(range(p, p + 20)) AS i FROM o WHERE n > 1),
x AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT x.r, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL) AS kept
    FROM x LEFT JOIN g ON g.r = x.r AND g.i = x.i GROUP BY x.r)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
