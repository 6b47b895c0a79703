"""Hierarchical packing into context windows of several lengths.

Each document becomes its token ids and an end id. Whole windows of the longest tier are cut off first; the tail that is
left goes to the shortest tier that holds it. Every tier is packed, the longest first: a window starts with a tail of its
tier, and the gap behind it is filled with the largest tails of shorter tiers that fit, and at last with a cut piece, so
that windows are full. What remains when no shorter tail is left is cut to powers of two, which need no padding. Windows
of one tier are dealt to step groups that all hold the same number of tokens.

A task packs the documents of its partition, a bounded number of tokens at a time, and shuffles nothing. A task that is
run again makes the same windows, as its input is the same. A null or empty text is the end id alone. Rows with one
doc_id are packed each by itself; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import pieces
from .tokens import default_path, encoder

TIERS = (128, 256, 512, 1024)
STEP_TOKENS = 1 << 16
BUFFER_TOKENS = 1 << 22

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class Pool:
    """Tails by length; ties by arrival."""

    def __init__(self):
        self.sizes: list[int] = []
        self.by_size: dict[int, list] = defaultdict(list)
        self.total = 0

    def add(self, piece) -> None:
        size = len(piece[2])
        if not self.by_size[size]:
            insort(self.sizes, size)
        self.by_size[size].append(piece)
        self.total += size

    def take(self, most: int, least: int = 0):
        """The largest piece of at most ``most`` ids and more than ``least``, or None."""
        at = bisect_right(self.sizes, most) - 1
        if at < 0 or self.sizes[at] <= least:
            return None
        size = self.sizes[at]
        piece = self.by_size[size].pop()
        if not self.by_size[size]:
            self.sizes.pop(at)
        self.total -= size
        return piece


def windows(pool: Pool, tiers: tuple[int, ...]) -> Iterator[list]:
    """Empty the pool: lists of pieces, each list a full window of some tier or, at the end, of a power of two."""
    for above, tier in zip((0, *tiers[:-1])[::-1], tiers[::-1], strict=True):
        while (piece := pool.take(tier, above)) is not None:
            window, gap = [piece], tier - len(piece[2])
            while gap and pool.total:
                fill = pool.take(min(gap, above)) or pool.take(tier)
                if len(fill[2]) > gap:
                    doc, start, ids, n = fill
                    pool.add((doc, start + gap, ids[gap:], n))
                    fill = (doc, start, ids[:gap], n)
                window.append(fill)
                gap -= len(fill[2])
            if not gap:
                yield window
                continue
            # the pool is empty and the window is not full: cut it to powers of two
            left = tier - gap
            size = 1 << (left.bit_length() - 1)
            part, room = [], size
            for doc, start, ids, n in window:
                while len(ids):
                    cut = ids[:room]
                    part.append((doc, start, cut, n))
                    start, ids, room, left = start + len(cut), ids[len(cut) :], room - len(cut), left - len(cut)
                    if not room:
                        yield part
                        part, room = [], 1 << (left.bit_length() - 1) if left else 0


def _pack(batches: Iterator[pa.RecordBatch], path: str, tiers: tuple[int, ...], end_id: int, step_tokens: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, longest = encoder(path), tiers[-1]
    base = TaskContext.get().partitionId() << 32
    made: dict[int, int] = defaultdict(int)
    groups: dict[tuple[int, int], int] = {}
    rows: list[tuple] = []
    count = 0

    def emit(window: list) -> None:
        nonlocal count
        tier = sum(len(p[2]) for p in window)
        group = groups.setdefault((tier, made[tier] * tier // step_tokens), len(groups))
        made[tier] += 1
        offset = 0
        for doc, start, ids, n in window:
            data = ids.astype("<u4").tobytes()
            rows.append((doc, start, len(ids), zlib.crc32(data), n, base + count, offset, tier, base + group, *([data] if with_ids else [])))
            offset += len(ids)
        count += 1

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * (9 + with_ids)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        out = {n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=False)}
        if with_ids:
            out["ids"] = pa.array(columns[9], pa.binary())
        rows.clear()
        return pa.RecordBatch.from_pydict(out)

    pool = Pool()
    for batch in pieces(batches):
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = np.append(encode(text or ""), np.uint32(end_id))
            whole = len(ids) // longest * longest
            for start in range(0, whole, longest):
                emit([(doc, start, ids[start : start + longest], len(ids))])
            if whole < len(ids):
                pool.add((doc, whole, ids[whole:], len(ids)))
        if pool.total >= BUFFER_TOKENS:
            for window in windows(pool, tiers):
                emit(window)
        if len(rows) >= 1 << 14:
            yield flush()
    for window in windows(pool, tiers):
        emit(window)
    yield flush()


def pack(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = 0, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in windows of at most ``tiers[-1]`` ids.

    ``tiers`` rise and are powers of two. Columns: doc_id, start (the document's ids before the piece), length,
    ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset (in the sequence), tier (its
    length), step_group, and with ``with_ids`` the ids as little-endian bytes.
    """
    path = path or default_path()
    schema = SCHEMA + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(lambda b: _pack(b, path, tiers, end_id, step_tokens, with_ids), schema)
