"""Each stage of the pipeline against brute force, on what the stage before it kept."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from factmill.llm import quality_rules
from tests.llm.helpers import odd_table
from tests.llm.test_exact import LOWER, _alnum, _keys, _shingles


@pytest.fixture(scope="module", params=["supplied", "odd"])
def place(request, spark, sf, tmp_path_factory):
    if request.param == "supplied":
        return sf
    d = str(tmp_path_factory.mktemp("odd"))
    odd_table(spark).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, place, tmp_path):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    columns, held = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, place).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        old, new = ([(r.doc_id, r.text) for r in x.collect()] if "text" in x.columns else [(r.doc_id, None) for r in x.collect()] for x in (before, docs))
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            kept = {r.doc_id for r in quality_rules.quality_rules(before).filter("kept").collect()}
            assert Counter(i for i, _ in new) == Counter(i for i, _ in old if i in kept)
            assert not any(len(re.findall("[^\x20\x09-\x0d]+", t or "")) < 20 for _, t in new)
        elif name == "lines":
            hot = {k for k, n in Counter(k for _, t in old for k in set(_keys(t)) if k).items() if n >= 10}
            want = [(i, None if t is None else "\n".join(x for x, k in zip(t.split("\n"), _keys(t), strict=True) if k not in hot)) for i, t in old]
            assert Counter(new) == Counter(want)
            if "n_chars" in columns:
                assert all(r.n_chars == len(r.text or "") for r in docs.collect())
        elif name == "near":
            sets = {i: _shingles(t, 5) for i, t in old}
            label = {i: i for i in sets}
            for i in sets:
                for j in sets:
                    both = len(sets[i] & sets[j])
                    if i > j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        a, b = label[i], label[j]
                        label = {k: min(a, b) if x in (a, b) else x for k, x in label.items()}
            assert Counter(i for i, _ in new) == Counter(i for i, _ in old if label[i] == i)
        elif name == "benchmark":
            items = [_alnum(r.text) for r in spark.read.parquet(f"{place}/benchmark.parquet").collect()]
            windows = {tuple(w[p : p + 10]) for w in items if w for p in range(len(w) - min(10, len(w)) + 1)}
            bad = {i for i, t in old for w in [_alnum(t)] for n in {len(x) for x in windows} if any(tuple(w[p : p + n]) in windows for p in range(len(w) - n + 1))}
            assert Counter(new) == Counter(x for x in old if x[0] not in bad)
            held = docs
        else:
            assert {i for i, _ in new} == {i for i, _ in old}
    assert held is not None
    ran = corpus_pipeline.run(spark, place)
    assert ran.columns == docs.columns and ran.agg({"length": "sum"}).first()[0] == docs.agg({"length": "sum"}).first()[0]
    assert LOWER[65] == 97
