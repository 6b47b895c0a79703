"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. The encoder maps each token to its span of the text: running sums of the bytes that
ids stand for, where the file is byte-level, else its own offsets. Spans and sections are then joined as intervals, by
binary search. A token that crosses a boundary is allocated by a rule:

- ``largest``: to the section that holds most of its bytes, the earlier of equals (the default);
- ``first``: to the section of its first byte; ``last``: to that of its last byte.

Each token goes to one section, so the sections of a document add up to its tokens.

A null text and an empty one are one empty section without tokens. Rows with one doc_id stand each by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat, pieces
from .tokens import default_path, encoder

SCHEMA = "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"


def lines(data: np.ndarray) -> np.ndarray:
    """Byte starts of the lines of a text; a line holds the \\n that ends it."""
    starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(data) else starts


_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True


def sentences(data: np.ndarray) -> np.ndarray:
    """Byte starts of sentences: the text's start, after a \\n, and after a stop and a space. Spaces end a sentence."""
    new = np.zeros(len(data) + 1, bool)
    new[0] = True
    new[1:] |= data == 10
    new[2:] |= (data[1:] == 32) & _STOPS[data[:-1]]
    starts = np.flatnonzero(new)
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(data) else starts


def attribute(begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, total: int, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, given its first byte and its end, and which tokens cross a boundary.

    ``starts``: the first byte of each section, from 0 on; ``total``: bytes of the text. A token without bytes is in the
    section of its place.
    """
    low = np.searchsorted(starts, begins, "right") - 1
    high = np.searchsorted(starts, np.maximum(begins, ends - 1), "right") - 1
    crossing = high > low
    if rule == "first":
        return low, crossing
    if rule == "last":
        return high, crossing
    own = low.copy()
    bounds = np.append(starts, total)
    at = np.flatnonzero(crossing)
    best = bounds[low[at] + 1] - begins[at]
    for step in range(1, int((high[at] - low[at]).max()) + 1 if len(at) else 0):
        section = np.minimum(low[at] + step, high[at])
        share = np.minimum(bounds[section + 1], ends[at]) - np.maximum(bounds[section], begins[at])
        more = share > best
        own[at[more]], best[more] = section[more], share[more]
    return own, crossing


def _count(batches: Iterator[pa.RecordBatch], path: str, sections: Callable, rule: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for batch in pieces(batches):
        data, offsets = flat(batch.column("text"))
        texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
        out: list[list] = [[] for _ in range(7)]
        for row, (doc, text) in enumerate(zip(ids, texts, strict=True)):
            own = data[offsets[row] : offsets[row + 1]]
            starts = sections(own)
            n = len(starts)
            tokens, begins, ends = encode.spans(text or "")
            section, crossing = attribute(begins, ends, starts, len(own), rule)
            chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            bounds = chars[np.append(starts, len(own))]
            for to, values in zip(out, (np.full(n, row), np.arange(n), bounds[:-1], bounds[1:], np.bincount(section, minlength=n), np.bincount(section[crossing], minlength=n), np.full(n, len(tokens))), strict=True):
                to.append(values)
        columns = [np.concatenate(x).astype(np.int64) for x in out]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(columns[0])), *map(pa.array, columns[1:])], names)


def section_tokens(docs: DataFrame, path: str | None = None, sections: Callable[[np.ndarray], np.ndarray] = sentences, rule: str = "largest") -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens, n_crossing, doc_tokens) of every section of every document.

    ``sections`` gives the byte starts of a text's sections, the first 0; they cover the text. ``n_crossing``: tokens
    allocated to the section that reach into another.
    """
    if rule not in ("largest", "first", "last"):
        raise ValueError(f"no such rule: {rule}")
    path = path or default_path()
    return docs.select("doc_id", "text").mapInArrow(lambda b: _count(b, path, sections, rule), SCHEMA)
