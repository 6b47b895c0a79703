"""Benchmark decontamination with suffix arrays over shards of the training documents.

Each task turns its documents, a bounded shard at a time, into a sparse suffix array: the places whose first words start
some benchmark suffix, sorted by the words that follow. All benchmark suffixes are then binary-searched in it, word by
word, which gives the range of places that agree in a whole window, and so the verbatim matches and their locations.
Nothing is shuffled. The benchmark is sent to the tasks in blocks of bounded size, one at a time; with several blocks the
documents are read once for each, and what the blocks find is joined. A block takes items until it holds ``BLOCK_WORDS``
words; longer items are cut into parts that share nine words, so no window is lost, and their matches end at the cuts.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased; two words are one if their 64-bit hashes
agree. A null or empty text has no words and matches nothing. Items without words are left out; items with a null
item_id mark words but are not named. Rows with one doc_id are searched each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, carried, constants, flat, grams, hashes, mix, pieces, spans, stored

SHARD_BYTES = 4 << 20
#: Words of the benchmark that are sent to the tasks at once, at most. A word takes up to 80 bytes in all arrays of a
#: block, so a broadcast is of 42 MB at most.
BLOCK_WORDS = 1 << 19
#: Benchmark text of a partition that the driver reads at once, about.
PART_BYTES = 16 << 20


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each text's first word."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, ALNUM)
    return hashes(data, starts, ends), first


class Suffixes:
    """The windows of a block of benchmark items: distinct, with the items and places that each stands for.

    ``words`` are the hashes of all words of the items, one item after the other; ``sizes`` tells how many each has and
    ``shift`` how many of its words lie before (an item may come in parts). Windows are not spelled out: ``start`` is
    where a distinct one stands first in ``words``. Two windows are one if their 64-bit hashes agree. The places of a
    window (``slot``) are in the order of the words that follow, so a text's longest match from a place is found by
    bisection, however many items share the window. Windows of the same items are of one class, whose items are listed once.
    """

    def __init__(self, ids: list, words: np.ndarray, sizes: np.ndarray, shift: np.ndarray, window: int):
        first = np.cumsum(sizes) - sizes
        span = np.minimum(sizes, window)
        counts = np.where(sizes > 0, sizes - span + 1, 0)
        item = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        place = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = first[item] + place
        key = np.empty(len(at), np.uint64)
        for n in np.unique(span[span > 0]).tolist():
            own = span[item] == n
            key[own] = mix(grams(words, n)[at[own]] ^ np.uint64(n))
        _, new, back = np.unique(key, return_index=True, return_inverse=True)
        back = back.reshape(-1)
        self.end = np.repeat(first + sizes, sizes)  # where the item of each word ends
        order = np.lexsort((_suffix_ranks(words, self.end)[at], back)) if len(at) else np.empty(0, np.int64)
        self.words, self.start, self.span = words, at[new].astype(np.int32), span[item[new]].astype(np.int32)
        self.item, self.place, self.slot = item[order], (place + shift[item])[order], at[order]
        self.first = np.searchsorted(back[order], np.arange(len(new) + 1)).astype(np.int32)
        self.sums = _sums(words)
        self.window, self.ids = window, ids
        self.ones = np.unique(words[self.start[self.span == 1]])
        self.twos = np.unique(grams(words, 2)[self.start[self.span > 1]])
        pairs = np.unique(back.astype(np.int64) * max(len(ids), 1) + item)
        mark = np.zeros(len(new), np.uint64)
        np.add.at(mark, pairs // max(len(ids), 1), mix((pairs % max(len(ids), 1)).astype(np.uint64) + np.uint64(1)))
        _, one, self.kind = np.unique(mark, return_index=True, return_inverse=True)
        self.kind = self.kind.reshape(-1)
        low, high = (np.searchsorted(pairs, (one + n) * max(len(ids), 1)) for n in (0, 1))
        self.kinds = [(pairs[x:y] % max(len(ids), 1)).astype(np.int32) for x, y in zip(low.tolist(), high.tolist(), strict=True)]

    def items_of(self, windows: np.ndarray) -> np.ndarray:
        """The items that hold any of these windows."""
        kinds = np.unique(self.kind[windows])
        return np.unique(np.concatenate([self.kinds[k] for k in kinds.tolist()])) if len(kinds) else np.empty(0, np.int32)

    def __len__(self) -> int:
        return len(self.start)

    def leads(self, words: np.ndarray) -> np.ndarray:
        """Places at which some suffix may start."""
        found = _among(words, self.ones)
        if len(words) > 1:
            found[:-1] |= _among(grams(words, 2), self.twos)
        return np.flatnonzero(found)


def _suffix_ranks(words: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The rank of each place among all by the words from there to its item's end; an end comes before any word."""
    rank = np.unique(words, return_inverse=True)[1].reshape(-1) + 1
    step, longest = 1, int((end - np.arange(len(end))).max(initial=0))
    while step < longest:
        then = np.zeros(len(rank), np.int64)
        far = np.flatnonzero(np.arange(len(rank)) + step < end)
        then[far] = rank[far + step]
        rank = np.unique(rank * (len(rank) + 2) + then, return_inverse=True)[1].reshape(-1) + 1
        step *= 2
    return rank


_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """The powers of an odd base up to the n-th."""
    global _powers
    if len(_powers) <= n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16), constants(31, 1)[0])]))
    return _powers


def _sums(words: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum(words * _power(len(words))[: len(words)])])


def _agree(words: np.ndarray, sums: np.ndarray, end: np.ndarray, at: np.ndarray, suffixes: Suffixes, slot: np.ndarray) -> np.ndarray:
    """How many words agree from places ``at`` of a text (which ends at ``end``) and ``slot`` of the items on, by hashes."""
    most = np.minimum(end - at, suffixes.end[slot] - slot)
    low, high, power = np.minimum(1, most), most, _power(max(len(words), len(suffixes.words)))
    while (live := low < high).any():
        middle = (low + high + 1) >> 1
        same = (sums[at + middle] - sums[at]) * power[slot] == (suffixes.sums[slot + middle] - suffixes.sums[slot]) * power[at]
        low, high = np.where(live & same, middle, low), np.where(live & ~same, middle - 1, high)
    return low


def _longest(words: np.ndarray, first: np.ndarray, which: np.ndarray, at: np.ndarray, doc: np.ndarray, suffixes: Suffixes) -> np.ndarray:
    """For each hit the words of the longest verbatim match with an item from there on.

    A bisection among the places of the window, which are in order, so a hit costs the logarithm of their number.
    """
    out = suffixes.span[which].astype(np.int64)
    full = np.flatnonzero(suffixes.span[which] == suffixes.window)
    sums, ends = _sums(words), first[doc + 1]
    for i in range(0, len(full), 1 << 17):
        some = full[i : i + (1 << 17)]
        p, end, best = at[some], ends[some], out[some]
        low, high = suffixes.first[which[some]].astype(np.int64), suffixes.first[which[some] + 1].astype(np.int64)
        while (live := np.flatnonzero(low < high)).size:
            middle = (low[live] + high[live]) >> 1
            slot = suffixes.slot[middle]
            n = _agree(words, sums, end[live], p[live], suffixes, slot)
            best[live] = np.maximum(best[live], n)
            over, out_of = slot + n >= suffixes.end[slot], p[live] + n >= end[live]
            after = suffixes.words[np.where(over, slot, slot + n)] < words[np.where(out_of, p[live], p[live] + n)]
            right = over | (~out_of & after)  # an item that has ended comes first
            low[live], high[live] = np.where(right, middle + 1, low[live]), np.where(right, high[live], middle)
        out[some] = best
    return out


def _among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(x), bool)
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


def _bisect(column: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    low, high = low.copy(), high.copy()
    while (live := low < high).any():
        middle = (low + high) >> 1
        seen = column[np.where(live, middle, 0)]
        on = live & ((seen <= value) if right else (seen < value))
        low, high = np.where(on, middle + 1, low), np.where(live & ~on, middle, high)
    return low


class SuffixArray:
    """The suffixes of a shard that may start a match, in the order of their words."""

    def __init__(self, words: np.ndarray, first: np.ndarray, suffixes: Suffixes):
        at = suffixes.leads(words)
        left = first[np.searchsorted(first, at, "right")] - at  # words up to the end of the document
        table = np.zeros((suffixes.window, len(at)), np.uint64)
        for k in range(suffixes.window):
            held = left > k
            table[k, held] = words[at[held] + k]
        order = np.lexsort(table[::-1])
        self.at, self.table = at[order], table[:, order]

    def search(self, suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a window of the benchmark and a place of the shard that has it, verbatim."""
        n = len(suffixes)
        if not n or not len(self.at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        live, low, high = np.arange(n), np.zeros(n, np.int64), np.full(n, len(self.at))
        done = []
        for k in range(suffixes.window):
            value = suffixes.words[suffixes.start[live] + k]
            low, high = _bisect(self.table[k], low, high, value, False), _bisect(self.table[k], low, high, value, True)
            ended = suffixes.span[live] == k + 1
            found = low < high
            done.append((live[ended & found], low[ended & found], high[ended & found]))
            live, low, high = live[found & ~ended], low[found & ~ended], high[found & ~ended]
        which, low, high = map(np.concatenate, zip(*done, strict=True))
        sizes = high - low
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(which, sizes), self.at[np.repeat(low, sizes) + place]


def _searched(batches: Iterator[pa.RecordBatch], suffixes: Suffixes):
    for batch in pieces(batches, most=SHARD_BYTES):
        words, first = words_of(batch.column("text"))
        which, at = SuffixArray(words, first, suffixes).search(suffixes)
        yield batch, words, first, which, at, np.searchsorted(first, at, "right") - 1


#: Rows that one step of a listing of matches spreads, about.
STEP_ROWS = 1 << 20


def _runs(first: np.ndarray, which: np.ndarray, at: np.ndarray, doc: np.ndarray, suffixes: Suffixes) -> Iterator[tuple[np.ndarray, ...]]:
    """Longest verbatim matches (document, item, places in either, words): windows that follow one another in both.

    A range of items at a time, so that what is spread at once is bounded by STEP_ROWS or the matches of one item.
    """
    total = int((suffixes.first[which + 1] - suffixes.first[which]).sum())
    steps = min(max(1, -(-total // STEP_ROWS)), max(len(suffixes.ids), 1))
    for low, high in zip(*(np.linspace(0, len(suffixes.ids), steps + 1).astype(int)[x] for x in (slice(None, -1), slice(1, None))), strict=True):
        mine = np.flatnonzero((suffixes.item >= low) & (suffixes.item < high))
        begin = np.searchsorted(mine, suffixes.first)
        sizes = begin[which + 1] - begin[which]
        slot = mine[np.repeat(begin[which], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        if len(slot):
            yield _joined(suffixes.item[slot], suffixes.place[slot], np.repeat(at, sizes), np.repeat(doc, sizes), np.repeat(suffixes.span[which], sizes), first)


def _joined(item, place, at, doc, span, first) -> tuple[np.ndarray, ...]:
    order = np.lexsort((at, at - place, item, doc))
    item, place, at, doc, span = (x[order] for x in (item, place, at, doc, span))
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - place[1:] != at[:-1] - place[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at))[: len(head)] - 1
    return doc[head], item[head], at[head] - first[doc[head]], place[head], at[tail] - at[head] + span[head]


def _scan(batches: Iterator[pa.RecordBatch], suffixes: Suffixes, rest: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For each document its words, the intervals that windows cover, the items that they are from and its longest match."""
    for batch, words, first, which, at, doc in _searched(batches, suffixes):
        n = batch.num_rows
        starts, ends, named = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
        longest: list[tuple] = [(0, None)] * n
        if len(at):
            change = np.zeros(first[-1] + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + suffixes.span[which], -1)
            covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
            inner = first[1:-1]
            step = covered[1:] != covered[:-1]
            step[inner[covered[inner] & covered[inner + 1]]] = True  # an interval ends with its document
            begin = np.flatnonzero(step & covered[1:])
            stop = np.flatnonzero(step & covered[:-1])
            for a, b, d in zip(begin.tolist(), stop.tolist(), (np.searchsorted(first, begin, "right") - 1).tolist(), strict=True):
                starts[d].append(a - int(first[d]))
                ends[d].append(b - int(first[d]))
            size = _longest(words, first, which, at, doc, suffixes)
            order = np.lexsort((at, -size, doc))  # the longest of each document, of these the first
            doc, at, size, which = doc[order], at[order], size[order], which[order]
            head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            for d, own, most, a, b in zip(doc[head].tolist(), at[head].tolist(), size[head].tolist(), head.tolist(), [*head[1:].tolist(), len(doc)], strict=True):
                longest[d] = most, own - int(first[d])
                named[d] = sorted({str(suffixes.ids[i]) for i in suffixes.items_of(which[a:b]).tolist() if suffixes.ids[i] is not None})
        columns = [batch.column(f.name) for f in rest] + [
            pa.array(np.diff(first)),
            pa.array(starts, pa.list_(pa.int64())),
            pa.array(ends, pa.list_(pa.int64())),
            pa.array(named, pa.list_(pa.string())),
            pa.array([x[0] for x in longest], pa.int64()),
            pa.array([x[1] for x in longest], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, [*rest.names, *_FOUND])


def _matches(batches: Iterator[pa.RecordBatch], suffixes: Suffixes) -> Iterator[pa.RecordBatch]:
    for batch, _, first, which, at, doc in _searched(batches, suffixes):
        for d, item, own, place, size in _runs(first, which, at, doc, suffixes):
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.int64()).take(pa.array(d)),
                "item_id": pa.array([suffixes.ids[i] for i in item.tolist()], pa.string()),
                "doc_word": pa.array(own.astype(np.int64)),
                "item_word": pa.array(place.astype(np.int64)),
                "n_words": pa.array(size.astype(np.int64)),
            })


def _blocks(benchmark: DataFrame, window: int, most: int) -> Iterator:
    """Broadcast suffixes of the benchmark, at most ``most`` words each; the driver holds a block and a partition's items.

    Items that agree in id and text are one.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    items = items.distinct().coalesce(1 + size // PART_BYTES)
    ids, parts, sizes, shift, room = [], [], [], [], most

    def block():
        made = Suffixes(list(ids), np.concatenate([*parts, np.empty(0, np.uint64)]), np.array(sizes, np.int64), np.array(shift, np.int64), window)
        for x in (ids, parts, sizes, shift):
            x.clear()
        return benchmark.sparkSession.sparkContext.broadcast(made)

    for row in items.toLocalIterator():
        words, _ = words_of(pa.array([row.text], pa.string()))
        begin = 0
        while begin < len(words):
            if room < min(window, len(words) - begin):
                yield block()
                room = most
            part = words[begin : begin + room]
            ids.append(row.item_id)
            parts.append(part)
            sizes.append(len(part))
            shift.append(begin)
            room -= len(part)
            if begin + len(part) == len(words):
                break
            begin += len(part) - window + 1
    yield block()


_FOUND = {"__words": "bigint", "__starts": "array<bigint>", "__ends": "array<bigint>", "__items": "array<string>", "__longest": "bigint", "__at": "bigint"}


def search(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (columns named by ``carried``) with what its texts have of the benchmark.

    ``__words``; ``__starts`` and ``__ends`` (intervals of hit words) and ``__items`` (their item_ids), of which any may
    repeat; ``__longest`` (words of the longest verbatim match, 0 if there is none) and ``__at`` (the first word of the
    first such match).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.select("*", *(F.lit(None).cast(t).alias(c) for c, t in _FOUND.items())).schema
    rest = to_arrow_schema(docs.schema)

    def scan(df, suffixes):
        return df.mapInArrow(lambda b: _scan(b, suffixes.value, rest), schema)

    blocks = _blocks(benchmark, window, block_words)
    found = scan(docs, next(blocks))
    # beyond one block: what the others find joins the rows by doc_id and a hash of the text
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    best = F.struct(F.col("__longest").alias("n"), (-F.col("__at")).alias("at"))
    others = []
    for block in blocks:
        hits = scan(docs, block).filter(F.size("__starts") > 0)
        others.append(stored(hits.select(F.col("doc_id").alias("__id"), mark.alias("__mark"), "__starts", "__ends", "__items", best.alias("__best")), "hits"))
        block.destroy()
    if not others:
        return found
    union = others[0]
    for x in others[1:]:
        union = union.unionByName(x)
    union = union.distinct().groupBy("__id", "__mark").agg(*(F.flatten(F.collect_list(c)).alias(f"{c}_more") for c in ("__starts", "__ends", "__items")), F.max("__best").alias("__more"))
    joined = found.withColumn("__own", mark).join(union, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__mark")), "left")
    merged = (F.concat(c, F.coalesce(f"{c}_more", F.array().cast(_FOUND[c]))).alias(c) for c in ("__starts", "__ends", "__items"))
    best = F.greatest(F.when(F.col("__longest") > 0, best), F.col("__more"))
    return joined.select(*docs.columns, "__words", *merged, F.coalesce(best["n"], F.lit(0)).alias("__longest"), (-best["at"]).alias("__at"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): every longest verbatim match of a window or more, where it is.

    Rows that agree in doc_id stand each by itself; item_id is a string. Parts of items that were cut (see above) share
    windows with none, so a match that crosses a cut comes as two, which overlap.
    """
    found = None
    for block in _blocks(benchmark, window, block_words):
        part = docs.select("doc_id", "text").mapInArrow(lambda b, s=block: _matches(b, s.value), "doc_id long, item_id string, doc_word long, item_word long, n_words long")
        found = part if found is None else found.unionByName(part)
    return found


def hit_words() -> F.Column:
    """Words under the union of the intervals."""
    spans_ = F.array_sort(F.arrays_zip("__starts", "__ends"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(acc, x):
        a, b = x["__starts"], x["__ends"]
        return F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), b - F.greatest(a, acc["end"]))).alias("n"), F.greatest(acc["end"], b).alias("end"))

    return F.aggregate(spans_, start, add, lambda acc: acc["n"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a verbatim benchmark window, with the columns of ``docs``."""
    inner, back = carried(docs, "doc_id", "text")
    return search(inner, benchmark, window).filter(F.size("__starts") == 0).select(*back)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at) of every document.

    ``longest``: words of the longest verbatim match with an item (0 if there is none); ``longest_at``: words before the
    first such match (-1 if there is none). Words of an item of more than BLOCK_WORDS words count by its parts.
    """
    found = search(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), window)
    items = F.array_sort(F.array_distinct("__items"))
    n = hit_words()
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        n.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n > 0).alias("contaminated"),
        F.col("__longest").alias("longest"),
        F.coalesce("__at", F.lit(-1).cast("long")).alias("longest_at"),
    )


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT i, item_id, n, p AS ip, array_to_string(w[p : p + n - 1], ' ') AS s
    FROM (SELECT i, item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
p AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
h AS (SELECT r, p, n, i, item_id, ip FROM p JOIN q USING (n, s)),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items,
    sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM h GROUP BY r),
m AS (SELECT r, min(p) - 1 AS longest_at, count(*) + any_value(n) - 1 AS longest
    FROM (SELECT r, i, p, n, ip, p - row_number() OVER (PARTITION BY r, i, p - ip ORDER BY p) AS run FROM h) GROUP BY r, i, p - ip, run),
b AS (SELECT r, longest, longest_at FROM m QUALIFY row_number() OVER (PARTITION BY r ORDER BY longest DESC, longest_at) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
    coalesce(longest, 0) AS longest, coalesce(longest_at, -1) AS longest_at
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r) LEFT JOIN b USING (r)
"""
