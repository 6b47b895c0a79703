"""The divergence of sources against a plain count."""

import random
import re
from collections import Counter, defaultdict

from factmill.llm.divergence import divergence
from tests.llm.helpers import INNER, ODD, texts

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def expected(docs, least, top):
    groups, within, holds = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang, source].update(found)
        within[lang].update(found)
        holds[lang].update(set(found))
    p = {}
    for lang in within:
        kept = [t for t, n in holds[lang].items() if n >= least]
        for key, counts in [*(x for x in groups.items() if x[0][0] == lang), (lang, within[lang])]:
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            p[key] = {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, source in groups:
        mine, whole = p[lang, source], p[lang]
        pairs = [(o, sum(f(mine[t], p[lang, o][t]) for t in mine)) for g, o in groups if g == lang and o != source]
        own = [(t, f(mine[t], whole[t])) for t in mine if groups[lang, source][t] and mine[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", own)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, v, i + 1) for i, (item, v) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def rows(spark, made):
    inner = [c for c in INNER if c not in ("term", "n")] + ["term", "n", "p", "q", "deal", "kept", "all", "total"]
    schema = "lang string, source string, text string, " + ", ".join(f"`{c}` long" for c in inner)
    return spark.createDataFrame([(*x, *range(len(inner))) for x in made], schema)


def check(spark, made, least, top=10):
    got = sorted(map(tuple, divergence(rows(spark, made), least, top).select("lang", "source", "part", "item", "value", "rank").collect()))
    want = expected(made, least, top)
    assert got == want
    return want


def test_groups_nulls_and_odd_texts(spark):
    r = random.Random(4)
    made = [(r.choice(["en", "de", None, "En"]), r.choice(["a", "b", "", None, "é"]), t) for t in texts(5, 90, 40) + ODD * 3]
    made += [("xx", "a", "lone"), ("xx", "b", None), ("xx", "c", "word 9"), ("one", "only", "some words")]
    made += made[:9]  # repeated rows count again
    want = check(spark, made, 3)
    assert [x for x in want if x[0] == "xx"] and all(x[4] == 0 for x in want if x[0] == "xx")


def test_letters_above_ascii_keep_their_case_and_ties_go_by_bytes(spark):
    made = [("l", s, t) for s in "ab" for t in ["É é ÄB äb Zeta zeta", "𝔸 ｆ ab"] * (1 if s == "a" else 2)]
    assert {"É", "é", "Äb", "äb"} <= {x[3] for x in check(spark, made + [("l", "c", "zz")] * 2, 2, top=100)}


def test_only_ranks_within_the_limit(spark):
    made = [("l", s, " ".join(f"{s}w{chr(97 + i % 26)}{chr(97 + i // 26)}" * (1 + i % 3) for i in range(60))) for s in "abc" for _ in range(2)]
    assert max(x[5] for x in check(spark, made, 2, top=4) if x[2] == "term") == 4


def test_counts_beyond_64_bits_of_work(spark):
    from factmill.llm.divergence import _frequency

    big = spark.createDataFrame([(9 * 10**12, 10**13, 5 * 10**8)], "n long, total long, kept long").select(_frequency("n", "total", "kept"))
    assert big.first()[0] == 1 + 10**9 * (9 * 10**12 + 2) // (10**13 + 10**9)


def test_empty(spark):
    assert divergence(rows(spark, [("a", "b", "c")]).limit(0)).count() == 0
