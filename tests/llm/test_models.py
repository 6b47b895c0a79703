"""Operators that learn or estimate: against numpy, and on rows that are held out."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factmill.llm import language_id, quality_rules, toxicity
from tests.llm.helpers import ODD, odd_table, table, texts


def _held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


# --- quality rules ---------------------------------------------------------------------------------------------------


def _base(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
    again = {p + k for p in range(len(w) - 7) if windows[tuple(w[p : p + 8])] > 1 for k in range(8)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), n < 20 or 100 * len(again) > 30 * n


def test_quality_statistics(spark):
    held = texts(6, vocabulary=5) + ["a b c d e f g h " * 9, "x " * 40, "#1 & <b>|</b>\n#1 & <b>|</b>"] + ODD
    got = quality_rules.quality_rules(table(spark, list(enumerate(held)))).collect()
    assert len(got) == len(held)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _base(held[r.doc_id])
        assert not (r.base_failed and r.kept)


def _corpus(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        made = [r.choice(words) for _ in range(r.randint(25, 200))]
        rows.append((i, " ".join(made[:12]) + "\n" + " ".join(made[12:]), "en" if i % 3 else "de", f"s{i % 2}"))
    return rows


def test_outliers_go_and_clean_rows_stay(spark):
    rows = _corpus(900, 3)
    junk = {i for i in range(0, 900, 7)}  # a seventh of the rows would spoil plain means
    rows = [(i, re.sub(r"(\S+)", r"\1%%%", t) if i in junk else t, lang, s) for i, t, lang, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    assert not any(got[i] for i in junk) and all(k for i, k in got.items() if i not in junk)
    assert quality_rules.quality_filter(docs).columns == docs.columns
    assert {r.doc_id for r in quality_rules.quality_filter(docs).collect()} == {i for i, k in got.items() if k}


def test_repeated_lines_and_words_reject_alone(spark):
    rows = _corpus(900, 7)
    menus, passages = set(range(0, 900, 18)), set(range(5, 900, 18))
    for i, (n, t, lang, s) in enumerate(rows):
        w = (t + " " + t[::-1]).split()[:50]
        if i in menus:  # short lines between unique ones: no window of 8 words is there twice
            rows[i] = n, "\n".join(f"{a} x{k}\nMore" for k, a in enumerate(w)), lang, s
        if i in passages:  # a quarter of the words, below the base rule
            made = [f"{a}{k}" for k, a in enumerate(w * 2)][:80]
            rows[i] = n, " ".join(made[:40] + made[:10] + made[40:] + made[:10]), lang, s
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i].base_failed for i in menus | passages)
    assert all(got[i].n_dup_lines and not got[i].n_repeat_words for i in menus)
    assert all(got[i].n_repeat_words and not got[i].n_dup_lines for i in passages)
    assert not any(got[i].kept for i in menus | passages)
    assert all(r.kept for i, r in got.items() if i not in menus | passages)


FLOOR = 0.01
HALF_SCALE = 0.75 / quality_rules.chi2_cdf(quality_rules.chi2_quantile(0.75, 4), 6)


def _vectors(spark, groups):
    rows = [(g, *map(float, v)) for g, x in groups.items() for v in x]
    return spark.createDataFrame(rows, "__group string, __x0 double, __x1 double, __x2 double, __x3 double")


def _covariance(x, scale=HALF_SCALE):
    return scale * np.cov(x.T, bias=True) + np.diag([FLOOR**2] * 4)


def _planted(seed, n, bad):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) + 3
    x[:bad] += 40
    return x


def test_least_determinants_are_those_of_all_subsets(spark):
    """Against every subset of nine of twelve rows: the minimum covariance determinant itself."""
    held = {f"g{seed}.{bad}": _planted(seed, 12, bad) for seed in range(5) for bad in (2, 3)}
    got = {r["__group"]: r for r in quality_rules.least_determinants(_vectors(spark, held), floors=(FLOOR,) * 4).collect()}
    for g, x in held.items():
        want = min(np.linalg.slogdet(_covariance(x[list(s)]))[1] for s in itertools.combinations(range(12), 9))
        if g.endswith(".3"):  # the nine rows that are not planted
            assert got[g]["__determinant"] == pytest.approx(want, abs=1e-6)
        else:  # one of ten may be left out: a local least is near the least, and has none of those planted
            assert want - 1e-6 <= got[g]["__determinant"] <= want + 2.5


def test_distances_are_those_of_numpy(spark):
    held = {"g": _planted(4, 1500, 200), "h": _planted(5, 700, 150)}
    df = _vectors(spark, held)
    factors = quality_rules.estimates(df, floors=(FLOOR,) * 4)
    got = df.join(factors, "__group").select("__group", "__x0", quality_rules._distance().alias("d")).collect()
    for g, x in held.items():
        # concentration from the clean rows, until it stands still
        inside = np.arange(len(x)) >= 200
        for _ in range(50):
            mean, cov = x[inside].mean(axis=0), _covariance(x[inside])
            distance = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            inside = distance <= np.sort(distance)[int(np.ceil(0.75 * len(x))) - 1]
        inside = distance <= quality_rules.chi2_quantile(0.975, 4)
        mean, cov = x[inside].mean(axis=0), _covariance(x[inside], 0.975 / quality_rules.chi2_cdf(quality_rules.chi2_quantile(0.975, 4), 6))
        distance = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        want = dict(zip(x[:, 0].tolist(), distance.tolist(), strict=True))
        assert all(r.d == pytest.approx(want[r["__x0"]], rel=0.25, abs=0.25) for r in got if r["__group"] == g)
        assert (distance[:150] > 1000).all() and np.median(distance[200:]) < 6


def test_chi_square():
    assert quality_rules.chi2_quantile(0.975, 4) == pytest.approx(11.1433, abs=1e-3)
    assert quality_rules.chi2_cdf(5.385, 6) == pytest.approx(0.5046, abs=1e-3)


def test_small_and_null_groups_are_pooled(spark):
    rows = [(i, t, None if i % 5 == 0 else lang, None if i % 7 == 0 else f"s{i % 300}") for i, t, lang, _ in _corpus(320, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_rules.quality_rules(docs)
    assert got.count() == 320 and got.filter("distance is null").isEmpty() and got.filter("kept").count() > 310
    assert quality_rules.quality_rules(odd_table(spark)).count() == odd_table(spark).count()


# --- toxicity --------------------------------------------------------------------------------------------------------


def _labelled(spark, n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("aeiourstlnmd") for _ in range(r.randint(2, 8))) for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        made, bad = [r.choice(words) for _ in range(r.randint(5, 300))], r.random() < 0.3
        if bad:
            for _ in range(max(1, len(made) // 40)):
                made[r.randrange(len(made))] = r.choice(["blockhead", "wretch", "vermin"] if not _held(i) else ["bl0ckhead", "wretches", "verminn"])
        rows.append((i, " ".join(made)))
        labels.append((i, 1, int(bad)))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_misspellings_are_found_on_held_out_rows(spark):
    docs, labels = _labelled(spark, 1500, 1)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in got if _held(i)]
    assert all(got[i].held_out == _held(i) and got[i].predicted == int(got[i].score >= 0.5) and 0 <= got[i].score <= 1 for i in got)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.93


def test_scores_do_not_depend_on_what_stands_beside():
    model = toxicity.Model.train(["you blockhead " + "a b c " * 5, "fine words here"] * 30, [1, 0] * 30)
    held = ["blockheads", None, "", "fine", "a " * 200 + "blockhead", "é"]
    whole = model.scores(pa.array(held, pa.string()))
    assert [model.scores(pa.array([t], pa.string()))[0] for t in held] == pytest.approx(whole.tolist())
    assert whole[0] > whole[3] and whole[4] > 0.5 and whole[1] == whole[2]


def test_labels_are_read_with_care(spark):
    docs = odd_table(spark)
    labels = spark.createDataFrame([(1, 1, None), (2, 1, 1), (2, 1, 0), (None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == docs.count()
    assert toxicity.toxicity(docs, labels.limit(0)).filter("score > 1e-9 or predicted = 1").isEmpty()
    assert toxicity.toxicity(docs.limit(0), labels).isEmpty()
    used, marks = toxicity.sample(docs, labels)
    assert set(marks) <= {1} and len(used) == len(marks)
    assert len(toxicity.sample(docs, labels, most=0)[0]) == 0


def test_long_texts_do_not_end_the_sample(spark):
    ids = [i for i in range(60) if not _held(i)]
    labels = spark.createDataFrame([(i, 1, 1) for i in ids], "doc_id long, quality int, toxic int")
    first = toxicity.sample(table(spark, [(i, f"t{i}") for i in ids]), labels, rows=1)[0][0]
    docs = table(spark, [(i, "x" * 5000 if f"t{i}" == first else f"short {i}") for i in ids])
    used, marks = toxicity.sample(docs, labels, most=4000)
    assert len(used) == len(marks) == len(ids) - 1 and max(map(len, used)) < 10
    rows = [(i, None if i % 5 == 0 else "é" * 3000 if i % 5 == 1 or i % 2 else f"short {i}", "ab"[i % 2]) for i in range(200)]
    used, langs = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=4000)
    assert langs.count("a") > 30 and set(langs) == {"a", "b"}  # b has long texts alone
    for lang in "ab":
        assert sum(len(t.encode()) for t, x in zip(used, langs, strict=True) if x == lang) <= 2000


def test_the_sample_of_languages_keeps_its_bounds(spark):
    """Many languages, one that holds a third of all rows, repeated ids, and texts larger than a share."""
    rows = [(i, f"text {i}", f"l{i % 400}") for i in range(4000) if not _held(i)] + [(i, f"hot {i}", "hot") for i in range(4000, 6000) if not _held(i)] * 2
    rows += [(7001 + i, "é" * 5000, "long") for i in range(9) if not _held(7001 + i)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    for most_rows in (50, 300, 1000):
        texts, langs = language_id.sample(docs, rows=most_rows, most=100_000)
        assert len(texts) <= most_rows and sum(len(t.encode()) for t in texts) <= 100_000
        assert len(set(langs)) == min(most_rows, 402)  # each language before a second row of any
        assert language_id.sample(docs.repartition(3), rows=most_rows, most=100_000) == (texts, langs)
    long = next(t for t, x in zip(texts, langs, strict=True) if x == "long")
    assert set(long) <= {"é", " "} and len(long.encode()) <= 100_000 // 402


def test_pieces_of_a_large_text_come_from_all_over_it(spark):
    i = next(i for i in range(9) if not _held(i))
    text = "".join(f"{n:04d} " for n in range(10000))
    found, _ = language_id.sample(spark.createDataFrame([(i, text, "a")], "doc_id long, text string, lang string"), most=4000)
    numbers = sorted(int(x) for x in found[0].split() if len(x) == 4)
    assert len(found[0]) <= 4000 and numbers[0] < 300 and numbers[-1] > 9000 and len(numbers) > 100


# --- languages -------------------------------------------------------------------------------------------------------

STEMS = {"xa": ["tion", "ing", "the", "oun", "ly"], "xb": ["keit", "sch", "ung", "ber", "pf"], "xc": ["cao", "nhi", "que", "oso", "lla"]}


def _speech(r, lang, n):
    return ["".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)]


def test_marginals_by_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        emission, start, moves = rng.normal(size=(n, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
        steps = np.full((language_id.CHAIN, 1), -1)
        steps[:n, 0] = np.arange(n)
        got, pairs = language_id.marginals(emission, steps, start, moves)
        total, want, seen = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(start[path[0]] + sum(emission[t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += p
            for t, y in enumerate(path):
                want[t, y] += p
            for a, b in zip(path, path[1:], strict=False):
                seen[a, b] += p
        assert np.allclose(got, want / total) and np.allclose(pairs, seen / total)


def test_languages_and_switches(spark):
    r = random.Random(2)
    rows = [(i, " ".join(_speech(r, lang, r.randint(3, 200))), lang if i % 11 else None, "s") for i, lang in enumerate(["xa", "xb", "xc"] * 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    field = language_id.fit(docs)
    got = {x.doc_id: x for x in language_id.language_id(docs, field).collect()}
    assert np.mean([got[i].lang_pred == ["xa", "xb", "xc"][i % 3] for i in got if _held(i)]) > 0.98
    assert all(0 <= x.score <= 1 and x.held_out == _held(x.doc_id) for x in got.values())
    mixed = " ".join(_speech(r, "xa", 25) + _speech(r, "xb", 30) + _speech(r, "xc", 20))
    runs = language_id.language_runs(table(spark, [(1, mixed)]), field).orderBy("first_word").collect()
    assert [x.lang for x in runs if x.n_words > 5] == ["xa", "xb", "xc"]
    assert abs(runs[0].n_words - 25) < 4 and sum(x.n_words for x in runs) == 75


def test_texts_without_letters_are_und(spark):
    docs = odd_table(spark)
    got = {x.doc_id: x for x in language_id.language_id(docs).collect()}
    for i, text in {x.doc_id: x.text for x in docs.collect()}.items():
        assert (got[i].lang_pred == "und") == (not re.search(r"[^\W\d_]", text or "")) and got[i].lang_pred in ("und", "en")
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {x.lang_pred for x in language_id.language_id(none).collect()} == {"und"}
    assert language_id.language_id(docs.limit(0)).isEmpty()
