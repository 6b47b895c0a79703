"""The URL filter against plain Python: rules by hand, models by dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from factmill.llm import url_filter
from factmill.llm.url_filter import RULES, allowed, judged, learn, logistic, verdicts

LOWER = {i: i + 32 for i in range(65, 91)}
ODD = [None, "", "plain", "://", "x://", "http://NET", "http://net/", "HTTP://A.Net/x?y#z", "http://anet/x", "http://net./x", "http://é.example.net/en/É?q",
       "http://example.net/en", "http://example.net/en/", "http://www.EXAMPLE.net/En/", "http://a.org/fr/x", "http://example.com/de/#/en/", "http://example.com?/de/",
       "a://b://example.net/en/", "http://org/fr/\n\x01", "http://example.net:80/en/", "//example.net/en/", "http://x/" + "long" * 20000]


def urls(seed, n=300):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7)))
    return [f"http{r.choice(['', 's'])}://{word()}.example.{r.choice(['net', 'com', 'org'])}/{r.choice(['en', 'de', 'fr'])}/{word()}{r.choice(['', '?q=1', '#x'])}" for _ in range(n)]


def placed(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def told(url, rules=RULES):
    host, path = placed(url)
    best = None
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best or (None, None)


def symbol(byte):
    c = chr(byte).lower() if 65 <= byte <= 90 else chr(byte)
    return "9" if c in "0123456789" and byte < 128 else c if c in "abcdefghijklmnopqrstuvwxyz/.-_?=&#%:" and byte < 128 else "low" if byte < 128 else "high"


def symbols(url):
    return [*["edge"] * 3, *map(symbol, url.encode()), "edge"]


def brute(held):
    """Score and chance of each URL."""
    counts = [[defaultdict(Counter) for _ in range(4)] for _ in range(2)]
    for u in held:
        rule, verdict = told(u)
        if verdict and zlib.crc32(u.encode()) % 5:
            s = symbols(u)
            for i in range(3, len(s)):
                for k in range(4):
                    counts[verdict == "block"][k][tuple(s[i - k : i])][s[i]] += 1

    def chance(kind, context, c):
        p = 1 / 40
        for k in range(4):
            seen = counts[kind][k].get(context[3 - k :])
            if seen:
                p = (seen[c] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    def score(u):
        s = symbols(u)
        return sum(math.log(chance(1, tuple(s[i - 3 : i]), s[i]) / chance(0, tuple(s[i - 3 : i]), s[i])) for i in range(3, len(s))) / (len(s) - 3)

    return {u: score(u) for u in set(held) if u}


def test_rules_and_scores(spark):
    made = urls(1) + urls(1)[:40] + [u for u in ODD if not u or len(u) < 1000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(made)], "page_id long, url string")
    got = {r.page_id: r for r in verdicts(pages).collect()}
    scores = brute(made)
    held = [(scores[u], told(u)[1] == "block") for u in made if u and told(u)[1] and zlib.crc32(u.encode()) % 5 == 0]
    assert {x[1] for x in held} == {True, False}
    bins = lambda kind: np.array([sum(min(max(math.floor(x * 256) + 4096, 0), 8191) == b for x, k in held if k is kind) for b in range(8192)], float)
    a, b = logistic((np.arange(8192) - 4096 + 0.5) / 256, bins(False), bins(True))
    assert a > 0
    for i, u in enumerate(made):
        rule, verdict = told(u)
        want = 0.5 if not u else 1 / (1 + math.exp(-(a * scores[u] + b)))
        assert (got[i].host, got[i].path, got[i].rule) == (*placed(u), rule)
        assert got[i].chance == pytest.approx(want, abs=1e-4)
        if verdict or abs(want - 0.5) > 1e-4 or not u:
            assert got[i].verdict == (verdict or ("block" if want > 0.5 else "allow"))


def test_held_out_urls_are_told_apart(spark):
    """URLs that only the models judge: their words are those of one side, their hosts fit no rule."""
    r = random.Random(3)
    word = lambda letters: "".join(r.choice(letters) for _ in range(8))
    made = [f"http://x.net/{word('casinowhz')}" for _ in range(400)] + [f"http://x.org/fr/{word('learntuv')}" for _ in range(400)]
    blind = [(f"http://q.example/{word('casinowhz')}", "block") for _ in range(60)] + [(f"http://q.example/{word('learntuv')}", "allow") for _ in range(60)]
    pages = spark.createDataFrame([(u,) for u in made + [u for u, _ in blind]], "url string")
    got = {x.url: x for x in judged(pages).collect()}
    assert sum(got[u].verdict == v for u, v in blind) >= 110
    assert all(got[u].rule is None for u, _ in blind)


def test_the_longest_url_and_whole_contexts(spark):
    code, begins = url_filter.grams(pa.array(["ab", None, "", "é/9"]))
    assert begins.tolist() == [0, 3, 4, 5] and len(code) == 10
    edge, high = url_filter.EDGE, url_filter.EDGE - 1
    assert code[0] == ((edge * 40 + edge) * 40 + edge) * 40 + 0 and code[2] == ((edge * 40 + 0) * 40 + 1) * 40 + edge
    assert code[6] == ((edge * 40 + edge) * 40 + high) * 40 + high
    chances = np.exp(url_filter.log_chances(np.random.default_rng(1).poisson(0.01, url_filter.CELLS))).reshape(-1, url_filter.SYMBOLS)
    assert np.allclose(chances.sum(axis=1), 1)
    long = "http://x.net/" + "ab" * 500_000
    pages = spark.createDataFrame([(long,), ("http://b.org/fr/",)] * 30 + [(u,) for u in urls(2, 60)], "url string")
    assert {r.verdict for r in judged(pages).collect() if len(r.url) > 1000} == {"block"}


def test_without_evidence_all_is_allowed(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.example/y"), (3, None)], "page_id long, url string")
    assert sorted((r.page_id, r.verdict, r.chance) for r in verdicts(pages).collect()) == [(1, "block", 0.5), (2, "allow", 0.5), (3, "allow", 0.5)]
    assert verdicts(pages.limit(0)).count() == 0
    assert judged(pages, []).filter("verdict = 'block' or rule is not null").count() == 0


def test_the_rules_that_decide(spark):
    rules = [("x.net/", "allow"), ("X.net/", "block"), ("a.x.net", "allow"), ("net/long/path", "block"), ("a.x.net/q", "block")]
    rows = ["h://x.net/", "h://a.x.net", "h://a.x.net/q", "h://a.x.net/long/path"]
    got = [(r.rule, r.verdict) for r in judged(spark.createDataFrame([(u,) for u in rows], "url string"), rules).collect()]
    assert got == [("X.net/", "block"), ("a.x.net", "allow"), ("a.x.net/q", "block"), ("net/long/path", "block")]
    assert judged(spark.createDataFrame([("h://ax.net/",)], "url string"), rules).first().rule is None
    for bad in ([("/x", "block")], [("a/", "maybe")], [("a/", "block")] * 1001):
        with pytest.raises(ValueError):
            url_filter.ordered(bad)


def test_allowed_rows_stay_as_they_are(spark):
    made = [(i, u, "h", "p", 2, 3.0) for i, u in enumerate(urls(5, 80) + ODD)]
    pages = spark.createDataFrame(made + made[:5], "page_id long, URL string, host string, __path string, chance long, __score double")
    got = allowed(pages)
    assert got.columns == pages.columns
    stay = judged(pages).filter("verdict = 'allow'").select("page_id").collect()
    assert sorted(r.page_id for r in got.collect()) == sorted(r.page_id for r in stay)
    assert got.filter("host <> 'h' or chance <> 2 or __path <> 'p'").count() == 0


def test_counts_do_not_depend_on_how_rows_are_dealt(spark):
    rows = spark.createDataFrame([(u, i % 3 == 0) for i, u in enumerate(urls(6))] + [(None, True), ("", False)], "url string, rejected boolean")
    one, many = learn(rows.coalesce(1)), learn(rows.repartition(7))
    assert np.array_equal(one.ratio, many.ratio) and (one.slope, one.place) == (many.slope, many.place)
