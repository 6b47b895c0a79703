"""Fill-in-middle against a plain rebuild of each document."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from factmill.llm.fill_in_middle import digests, fill_in_middle, restored
from tests.llm.helpers import odd_table, table

MARKED = ["a\n<P>b\n", "x<M>", "<S>", "<P", "<\n<\n<S", "P>\nS>\nM>"]
ESCAPES = ["\x01", "\x02", "\x02d\x02e\n\x01\x01\n\x02\x01e", "d\x01e\x02\nd\n\x02", "\n", "\n\n\n", "a\r\nb\rc\n", "😀\né\n漢字"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(i, text, seed=7, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    key = sha(f"{seed}:{'' if i is None else i}")
    h = [int(key[8 * j : 8 * j + 8], 16) for j in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not t or any(x in t for x in marks) or h[2] % 100 >= rate:
        return i, len(units), "plain", None, None, sha(t), sha(t)
    a, b, c = marks
    form, out = ("spm", b + s + a + p + c + m) if h[3] % 100 < spm else ("psm", a + p + b + s + c + m)
    return i, len(units), form, len(p), len(m), sha(out), sha(t)


COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_odd_texts(spark):
    made = [(1000 + i, t) for i, t in enumerate(MARKED + ESCAPES + ["line\n" * 5000, "no end " * 3000])] + [(None, "a\nb\n"), (None, None)]
    docs = odd_table(spark).unionByName(table(spark, made * 2))
    held = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in digests(docs).collect()), key=repr)
    assert got == sorted((expected(*x) for x in held), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("rate,spm", [(0, 50), (60, 0), (60, 100)])
def test_rates_seeds_and_marks(spark, rate, spm):
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    docs = odd_table(spark)
    out = fill_in_middle(docs, seed=11, rate=rate, spm_rate=spm, marks=marks)
    back = out.select("doc_id", "n", "form", F.length("prefix"), F.length("middle"), F.sha2("output", 256), F.sha2(restored(F.col("output"), F.col("form"), marks), 256))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted((expected(r.doc_id, r.text, 11, rate, spm, marks) for r in docs.collect()), key=repr)


def test_own_columns_stay_and_clashing_ones_give_way(spark):
    docs = spark.createDataFrame([("x1", "a\nb\nc\n", 5, "keep")], "doc_id string, text string, N long, __key string")
    out = fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "__key", "n", "form", "prefix", "middle", "suffix", "output"]
    row = out.first()
    assert (row["__key"], row.n, row.prefix + row.middle + row.suffix) == ("keep", 3, "a\nb\nc\n")
    assert row.form == expected("x1", "a\nb\nc\n")[2]


def test_marks_must_be_told_apart(spark):
    for marks in (("<P>", "<P>", "<M>"), ("<", "<S>", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(odd_table(spark), marks=marks)


def test_no_shuffle_and_no_python(spark, capsys):
    digests(odd_table(spark)).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
