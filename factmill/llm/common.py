"""Pieces that the corpus operators share: stored tables, Arrow batches and vectorised word hashes.

Words are found on UTF-8 bytes. Every character class used here is closed under bytes above 0x7F, so byte classes and
code-point classes agree. Hashes are 64 bits wide and do not depend on the process, so a task that is run again gives
the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python task works on.
CHUNK_BYTES = 1 << 20

#: Rows that travel to Python at once, at most: they hold whole texts, and the buffers of both sides grow with them.
BATCH_ROWS = 2000

SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode, where the session names none, a folder of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not context.isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factmill-"))
    return context.getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that survives lost executors.

    While it is written, at most BATCH_ROWS rows go to Python at once; the session's own limit holds again afterwards.
    """
    spark = df.sparkSession
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(limit)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not 0 < int(own) <= BATCH_ROWS:
        spark.conf.set(limit, str(BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(limit, own)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def carried(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[F.Column]]:
    """``docs`` with all columns but the ``needed`` ones renamed by place, and the columns that undo it.

    So the names that an operator works with never clash with those of its input.
    """
    names = [c.lower() if c.lower() in needed else f"__in{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# --- Arrow batches ---------------------------------------------------------------------------------------------------


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text each; a longer text is a slice by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


# --- words -----------------------------------------------------------------------------------------------------------


def byte_class(outside: bytes) -> np.ndarray:
    """Which of the 256 bytes belong to words, given those that do not."""
    inside = np.ones(256, bool)
    inside[list(outside)] = False
    return inside


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = byte_class(SPACE)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased
ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more entry at the end)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = inside[data]
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    after[edges] = False
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, offsets)


def _generator(seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(seed))


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return _generator(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = constants(11, 256)
_BASE = constants(12, 1)[0]
_powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(255, _BASE)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over a random table of bytes, then mixed."""
    global _powers
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    longest = int((ends - starts).max())
    if longest >= len(_powers):
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * longest, _BASE)]))
    first = 0
    while first < len(starts):  # a bounded number of bytes at a time, however long the text
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK_BYTES, "right")))
        s, e = starts[first:last], ends[first:last]
        sizes = e - s
        at = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
        terms = _BYTES[data[place + np.repeat(s, sizes)]] * _powers[place]
        out[first:last] = mix(np.add.reduceat(terms, at) + sizes.astype(np.uint64))
        first = last
    return out


def grams(words: np.ndarray, k: int, seed: int = 21) -> np.ndarray:
    """A hash of the k words from each place on; there are len(words) - k + 1 places."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    c = constants(seed, k)
    out = words[:n] * c[0]
    for j in range(1, k):
        out += words[j : j + n] * c[j]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# --- a bit map of bounded size ---------------------------------------------------------------------------------------

#: No bit map is larger, so that its broadcast has a proven bound (64 MB). Beyond it false positives grow, not the map.
MOST_BITS = 1 << 29


class BitMap:
    """Tells of a 64-bit hash that it is not among those put in; of others it says that they may be."""

    def __init__(self, bits: int, data: np.ndarray):
        self.shift, self.data = np.uint64(64 - bits.bit_length() + 1), data

    def holds(self, x: np.ndarray) -> np.ndarray:
        at = x >> self.shift
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_map(values: DataFrame, n: int, most: int = MOST_BITS):
    """A broadcast BitMap of the one column of ``values``, 64-bit hashes, of which there are ``n``.

    Sixteen bits a value, between 2^16 and ``most`` bits. Each task fills its own range of the map, so what reaches the
    driver is the map itself and never larger than ``most / 8`` bytes.
    """
    spark = values.sparkSession
    bits = 1 << max(16, min(most.bit_length() - 1, (16 * max(n, 1)).bit_length()))
    parts = min(64, bits >> 13)
    name = values.columns[0]
    level = bits.bit_length() - 1
    own = bits // parts // 8

    def fill(batches):
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - level)
            owner = (at >> np.uint64(3)).astype(np.int64) // own
            for part in np.unique(owner):
                mine = at[owner == part]
                if part not in maps:
                    maps[part] = np.zeros(own, np.uint8)
                np.bitwise_or.at(maps[part], (mine >> np.uint64(3)).astype(np.int64) - part * own, np.uint8(1) << (mine & np.uint64(7)).astype(np.uint8))
        if maps:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(maps), pa.int32()), "bits": pa.array([m.tobytes() for m in maps.values()], pa.binary())})

    place = F.shiftrightunsigned(F.col(name), 64 - (parts.bit_length() - 1)) if parts > 1 else F.lit(0)
    rows = values.repartition(min(parts, 16), place).mapInArrow(fill, "part int, bits binary").collect()
    data = np.zeros(bits // 8, np.uint8)
    for row in rows:
        data[row.part * own : (row.part + 1) * own] |= np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(BitMap(bits, data))
