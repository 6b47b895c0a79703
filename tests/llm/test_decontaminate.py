"""Longest matches against brute force, and the work and memory of prompts that many items share."""

import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from factmill.llm import decontaminate
from factmill.llm.decontaminate import Suffixes, words_of


def _suffixes(items, window):
    words, first = words_of(pa.array([t for _, t in items], pa.string()))
    return Suffixes([i for i, _ in items], words, np.diff(first), np.zeros(len(items), np.int64), window)


def _scan(texts, items, window=10):
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    found = pa.Table.from_batches(decontaminate._scan(iter([batch]), _suffixes(items, window), batch.schema))
    return found.select(["__items", "__longest", "__at"]).to_pylist()


def _brute(text, items, window):
    w, named, best = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text or ""), set(), (0, 0)
    for ident, t in items:
        v = (t or "").split()
        for p in range(len(w)):
            for q in range(len(v) if v else 0):
                n = 0
                while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                    n += 1
                if n >= min(window, len(v)) and (q == 0 or len(v) > window or n >= window):
                    named.add(ident)
                    best = max(best, (n, -p))
    return sorted(x for x in named if x is not None), best[0], -best[1] if best[0] else None


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("window", [3, 10])
def test_longest_by_brute_force(seed, window):
    r = random.Random(seed)
    some = lambda n, k: " ".join(r.choice("abcd"[:k]) for _ in range(n))
    prompt = some(2 * window, 4)
    items = [(f"i{n}", f"{prompt} {some(r.randint(0, 9), 3)}") for n in range(12)] + [("self", some(40, 2)), ("self2", some(40, 1)), ("short", some(window - 1, 4)), (None, some(20, 4)), ("empty", "")]
    texts = [f"{some(5, 4)} {prompt} {some(7, 3)} {prompt}", some(120, 2), prompt, None, "", "a " * 60, f"{prompt} {prompt}", some(window - 1, 4)]
    for got, t in zip(_scan(texts, items, window), texts, strict=True):
        assert (got["__items"], got["__longest"], got["__at"]) == _brute(t, items, window), t


def _cost(repeats, n_items):
    prompt = " ".join(f"p{i}" for i in range(30))
    items = [(f"i{n}", f"{prompt} own{n} tail{n % 7} end{n}") for n in range(n_items)]
    text = " ".join(f"{prompt} own{n % n_items} tail{n % 7}" for n in range(repeats))
    held = _suffixes(items, 10)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": pa.array([text])})
    tracemalloc.start()
    begin = time.process_time()
    row = pa.Table.from_batches(decontaminate._scan(iter([batch]), held, batch.schema)).to_pylist()[0]
    took, peak = time.process_time() - begin, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(row["__items"]) == n_items and row["__longest"] == 32
    return took, peak


def test_a_shared_prompt_costs_no_product():
    _cost(100, 100)
    (time1, peak1), (time2, peak2) = _cost(1000, 2000), _cost(2000, 4000)
    assert peak2 < 100e6 and peak2 < 2.6 * peak1
    assert time2 < 4 * time1 + 1


def test_listings_are_spread_in_steps(monkeypatch):
    prompt = " ".join(f"p{i}" for i in range(12))
    items = [(f"i{n}", f"{prompt} own{n}") for n in range(50)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": pa.array([f"{prompt} own3 {prompt}", prompt])})
    listed = lambda: sorted(map(tuple, (x.values() for x in pa.Table.from_batches(decontaminate._matches(iter([batch]), _suffixes(items, 10))).to_pylist())))
    whole = listed()
    assert len(whole) == 150 and (1, "i3", 0, 0, 13) in whole and (2, "i9", 0, 0, 12) in whole
    monkeypatch.setattr(decontaminate, "STEP_ROWS", 40)
    assert listed() == whole
