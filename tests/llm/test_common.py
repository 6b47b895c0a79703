import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from factmill.llm import common as c

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9 \t\n\x0b\x0c\r.é漢", max_size=40)), min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    for inside, pattern, lower in ((c.NOT_SPACE, "[^\x20\x09-\x0d]+", False), (c.ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", True)):
        data, offsets = c.flat(pa.array(texts, pa.string()))
        data = c.LOWER[data] if lower else data
        starts, ends, first = c.spans(data, offsets, inside)
        whole = data.tobytes()
        found = [whole[a:b].decode() for a, b in zip(starts, ends, strict=True)]
        plain = [(t or "").translate({i: i + 32 for i in range(65, 91)} if lower else {}) for t in texts]
        want = [re.findall(pattern, t) for t in plain]
        assert found == sum(want, [])
        assert np.diff(first).tolist() == [len(w) for w in want]
        hashes = c.hashes(data, starts, ends)
        assert all((hashes[i] == hashes[j]) == (found[i] == found[j]) for i in range(len(found)) for j in range(i))


def test_hash_does_not_depend_on_place_or_chunk(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500))
    data, offsets = c.flat(pa.array([text]))
    starts, ends, _ = c.spans(data, offsets, c.NOT_SPACE)
    whole = c.hashes(data, starts, ends)
    monkeypatch.setattr(c, "CHUNK_BYTES", 11)
    assert (c.hashes(data, starts, ends) == whole).all()
    assert all(whole[i] == whole[i % 37] for i in range(500))


def test_pieces_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["x" * n for n in (0, 5, 900, 3, 0, 7)] + [None])})
    parts = list(c.pieces([batch, batch.slice(0, 0)], most=10))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()
    assert list(c.pieces([], most=10)) == []


def test_bit_map_has_no_false_negatives(spark):
    values = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 5000)
    df = spark.createDataFrame([(int(x),) for x in values[:2500]], "h long")
    for most in (c.MOST_BITS, 1 << 16):
        held = c.bit_map(df, 2500, most).value
        assert held.holds(values[:2500].view(np.uint64)).all()
        assert held.holds(values[2500:].view(np.uint64)).mean() < 0.2
    assert not c.bit_map(df.limit(0), 0).value.holds(values.view(np.uint64)).any()


def test_stored_tables_go_to_the_shared_folder(spark):
    df = c.stored(spark.range(5), "x")
    assert df.inputFiles()[0].split("/x-")[0].endswith(c.shared_dir(spark).removeprefix("file:").lstrip("/").split("/")[-1])
