"""Line dedup with a sharded minimal perfect hash.

The distinct line hashes of the corpus are dealt to shards of bounded size. Each shard gets a minimal perfect hash
(levels of bit arrays; the rank of a key's bit is its index) over its hashes, with an array of fingerprints and an array
of counts at those indexes. Documents do not join lines with lines: each distinct line hash of a document is sent to its
shard, which looks its count up in the arrays. Hot lines are counted before any shuffle, and the look-ups of a shard are
cut into slices of bounded size, each with a copy of the shard's arrays, so no task's work grows with the count of a
line.

A document is a row. Rows that agree in doc_id and text count as several documents and get the same result. A null text
is one empty line. Two different lines are held to be one if their 64-bit hashes agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SPACE, carried, flat, mix, pieces, stored

SHARD_KEYS = 1 << 18
SLICE_PROBES = 1 << 18


# --- the minimal perfect hash ----------------------------------------------------------------------------------------


class PerfectHash:
    """Levels of bit arrays. A key sits on the first level on which no other key of that level shares its bit."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks = []
        total = 0
        for bits in levels:
            sums = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(sums - bits + total)
            total += int(sums[-1]) if len(sums) else 0
        self.total = total

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0, most: int = 24) -> PerfectHash:
        """``keys``: distinct 64-bit hashes. Those without a place after ``most`` levels are kept as a sorted list."""
        levels, left = [], keys
        while len(left) and len(levels) < most:
            size = max(64, int(gamma * len(left)))
            at = cls.place(left, len(levels), size)
            counts = np.bincount(at, minlength=size)
            levels.append(counts == 1)
            left = left[counts[at] > 1]
        return cls(levels, np.sort(left))

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; any number, or -1, for a key that was not built in."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = self.place(keys[open_], level, len(bits))
            found = bits[at]
            out[open_[found]] = self.ranks[level][at[found]]
            open_ = open_[~found]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_]
            out[open_[found]] = self.total + at[found]
        return out

    def dumps(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return b"".join([sizes.tobytes(), *(np.packbits(x).tobytes() for x in self.levels), self.rest.tobytes()])

    @classmethod
    def loads(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        at, levels = 8 * (n + 1), []
        for size in sizes:
            held = (int(size) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, held, at), count=int(size)).astype(bool))
            at += held
        return cls(levels, np.frombuffer(data, np.uint64, offset=at))


class LineIndex:
    """A shard: fingerprints of 16 bits and counts, saturated at 2^32 - 1, behind a perfect hash."""

    def __init__(self, perfect: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.perfect, self.prints, self.counts = perfect, prints, counts

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> LineIndex:
        perfect = PerfectHash.build(keys)
        at = perfect.index(keys)
        prints, held = np.empty(len(keys), np.uint16), np.empty(len(keys), np.uint32)
        prints[at] = cls.fingerprint(keys)
        held[at] = np.minimum(counts, 0xFFFFFFFF)
        return cls(perfect, prints, held)

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(0xFFFF)).astype(np.uint16)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """The counts; 0 where the fingerprint shows that the key is a stranger. All lines of the corpus are in."""
        if not len(self.counts):
            return np.zeros(len(keys), np.uint32)
        at = self.perfect.index(keys)
        safe = np.maximum(at, 0)
        return np.where((at >= 0) & (self.prints[safe] == self.fingerprint(keys)), self.counts[safe], np.uint32(0))


# --- lines -----------------------------------------------------------------------------------------------------------


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip(SPACE).lower() for x in text.split(b"\n")]  # bytes.lower() changes A-Z alone


def _long_enough(key: bytes, least: int) -> bool:
    """Whether the key has ``least`` code points; every byte but those that continue a character starts one."""
    return len(key) >= least and (least < 2 or sum(x & 0xC0 != 0x80 for x in key) >= least)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    data, offsets = flat(batch.column("text"))
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _doc_lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        ids, marks, out = [], [], []
        for key, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), _texts(batch), strict=True):
            found = {xxhash.xxh3_64_intdigest(x) for x in line_keys(text) if _long_enough(x, least)}
            ids += [key] * len(found)
            marks += [mark] * len(found)
            out += found
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()),
            "mark": pa.array(marks, pa.int64()),
            "line": pa.array(np.array(out, np.uint64).view(np.int64)),
        })


def _drop(batches: Iterator[pa.RecordBatch], least: int, schema: pa.Schema, rest: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        total, dropped, kept = [], [], []
        for text, hot in zip(_texts(batch), batch.column("__hot").to_pylist(), strict=True):
            lines = text.split(b"\n")
            total.append(len(lines))
            if hot:
                hot = set(hot)
                lines = [x for x in lines if not _long_enough(k := x.strip(SPACE).lower(), least) or _signed(k) not in hot]
            dropped.append(total[-1] - len(lines))
            kept.append(b"\n".join(lines))
        out = {c: batch.column(c) for c in rest} | {
            "__lines": pa.array(total, pa.int64()),
            "__dropped": pa.array(dropped, pa.int64()),
            "__kept": pa.array(kept, pa.binary()).cast(pa.string()),
        }
        yield pa.RecordBatch.from_pydict({f.name: out[f.name] for f in schema}, schema)


def _signed(key: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(key)
    return x - (1 << 64) if x >> 63 else x


# --- the operator ----------------------------------------------------------------------------------------------------


def line_index(lines: DataFrame) -> DataFrame:
    """(shard, n, probes, perfect, prints, counts) for a table with one row (line) per document and distinct line."""
    counts = stored(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")), "line-counts")
    shards = max(1, -(-counts.count() // SHARD_KEYS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["line"].to_numpy().view(np.uint64)
        index = LineIndex.build(keys, pdf["n"].to_numpy())
        row = (int(pdf["shard"].iloc[0]), len(keys), int(pdf["n"].sum()), index.perfect.dumps(), index.prints.tobytes(), index.counts.tobytes())
        return pd.DataFrame([row], columns=["shard", "n", "probes", "perfect", "prints", "counts"])

    dealt = counts.select(F.pmod(F.shiftrightunsigned("line", 20), F.lit(shards)).cast("int").alias("shard"), "line", "n")
    index = dealt.groupBy("shard").applyInPandas(build, "shard int, n long, probes long, perfect binary, prints binary, counts binary")
    return stored(index, "line-index").withColumn("shards", F.lit(shards))


def hot_lines(lines: DataFrame, index: DataFrame, least_docs: int) -> DataFrame:
    """(doc_id, mark, line) of those lines whose count, as the shard's arrays have it, is at least ``least_docs``."""
    shards = index.select("shards").first()
    n = shards.shards if shards else 1
    # a shard with many look-ups is cut by document, so that a hot line's are too; only its own arrays are copied for that
    cuts = index.select("shard", F.ceil(F.col("probes") / SLICE_PROBES).cast("int").alias("cuts"))
    probes = lines.withColumn("shard", F.pmod(F.shiftrightunsigned("line", 20), F.lit(n)).cast("int"))
    probes = probes.join(cuts.filter("cuts > 1"), "shard", "left")
    probes = probes.select("shard", F.pmod(F.xxhash64("doc_id", "mark"), F.coalesce("cuts", F.lit(1))).cast("int").alias("cut"), "doc_id", "mark", "line")
    copies = index.join(cuts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.greatest("cuts", F.lit(1)) - 1)).alias("cut"), "perfect", "prints", "counts")

    def look_up(probes: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(probes) or not len(shard):
            return probes[["doc_id", "mark", "line"]].iloc[:0]
        held = shard.iloc[0]
        arrays = LineIndex(PerfectHash.loads(held["perfect"]), np.frombuffer(held["prints"], np.uint16), np.frombuffer(held["counts"], np.uint32))
        return probes.loc[arrays.count(probes["line"].to_numpy().view(np.uint64)) >= least_docs, ["doc_id", "mark", "line"]]

    return probes.groupBy("shard", "cut").cogroup(copies.groupBy("shard", "cut")).applyInPandas(look_up, "doc_id long, mark long, line long")


def _dropped(docs: DataFrame, least_docs: int, least: int) -> DataFrame:
    """``docs`` (doc_id, text and columns named by ``carried``) with __lines, __dropped and __kept, the text that stays."""
    lines = docs.select("doc_id", "text", _mark().alias("mark")).mapInArrow(lambda b: _doc_lines(b, least), "doc_id long, mark long, line long")
    lines = stored(lines, "lines")
    index = line_index(lines)
    hot = hot_lines(lines, index, least_docs)
    hot = hot.distinct().groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_list("line").alias("__hot"))
    found = docs.withColumn("__own", _mark()).join(hot, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__mark")), "left")
    found = found.select(*[docs[c] for c in docs.columns], "__hot")
    schema = docs.select("*", F.lit(0).cast("long").alias("__lines"), F.lit(0).cast("long").alias("__dropped"), F.lit("").alias("__kept")).schema
    arrow, rest = to_arrow_schema(schema), docs.columns
    return found.mapInArrow(lambda b: _drop(b, least, arrow, rest), schema)


def dedup_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """Drop lines whose key is in at least ``least_docs`` documents.

    All columns of ``docs`` (doc_id, of an integer type, and text among them) come back, with the text that stays; a null
    text stays null. Keys shorter than ``least_chars`` stay everywhere. An empty table gives an empty table.
    """
    inner, back = carried(docs, "doc_id", "text")
    text = F.when(F.col("text").isNotNull(), F.col("__kept"))
    return _dropped(inner, least_docs, least_chars).withColumn("text", text).select(*back)


def _mark() -> F.Column:
    """Tells apart the texts of rows with one doc_id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def line_dedup(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    kept = _dropped(docs.select("doc_id", "text"), least_docs, least_chars)
    return kept.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE h.key IS NOT NULL) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot h ON k.key = h.key GROUP BY r, doc_id
"""
