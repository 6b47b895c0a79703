"""The operators with exact contracts against brute force and SQL."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factmill.llm import decontaminate, line_dedup, near_dedup, packing, pii, queries, substring_dedup, token_counts, tokens
from tests.llm.helpers import ODD, odd_table, table, texts
from tests.oracle import connection, same

SPACE = "[^\x20\x09-\x0d]+"
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    assert same(queries.QUERIES[name](spark, sf), connection(sf), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_every_query_stands_empty_tables(spark, tmp_path, sf, name):
    for t in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def _keys(text):
    return [x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (text or "").split("\n")]


@pytest.mark.parametrize("least", [1, 3])
def test_line_dedup(spark, least):
    docs = odd_table(spark)
    held = [(r.doc_id, r.text) for r in docs.collect()]
    found = Counter(k for _, t in held for k in set(_keys(t)) if len(k) >= least)
    want = []
    for i, t in held:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, _keys(t), strict=True) if len(k) < least or found[k] < 3]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    assert rows(line_dedup.line_dedup(docs, 3, least), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20000, np.uint64))
    made = line_dedup.PerfectHash.loads(line_dedup.PerfectHash.build(keys).dumps())
    assert sorted(made.index(keys).tolist()) == list(range(len(keys)))
    few = line_dedup.PerfectHash.build(keys, most=1)  # what finds no place is kept as a list
    assert len(few.rest) and sorted(few.index(keys).tolist()) == list(range(len(keys)))
    index = line_dedup.LineIndex.build(keys, np.arange(len(keys)))
    assert index.count(keys).tolist() == list(range(len(keys)))
    assert line_dedup.LineIndex.build(keys[:0], keys[:0]).count(keys).sum() == 0


def test_hot_shards_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SLICE_PROBES", 7)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    test_line_dedup(spark, 1)


def _windows(held, size):
    first = {}
    for i, t in sorted(held, key=lambda x: x[0]):
        w = re.findall(SPACE, t or "")
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p : p + size]), (i, p))
    return first


@pytest.mark.parametrize(("hot", "seed"), [(2000, 1), (2, 1), (5, 2), (1, 3)])
def test_substring_dedup(spark, hot, seed):
    held = list(enumerate(texts(seed, vocabulary=4) + ["z " * 50, "a b " * 30] + ODD[:-3]))
    first = _windows(held, 20)
    want = []
    for i, t in held:
        w = re.findall(SPACE, t or "")
        gone = set()
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] != (i, p):
                gone |= set(range(p, p + 20))
        want.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    random.Random(seed).shuffle(held)
    found = substring_dedup.dedup_substrings(table(spark, held), hot_places=hot).withColumn("sha", F.sha2("kept", 256))
    assert rows(found, "doc_id", "n_words", "n_removed", "sha") == sorted(want, key=repr)


def test_substring_dedup_of_odd_rows(spark):
    docs = odd_table(spark).unionByName(table(spark, [(None, "n " * 30), (None, "n " * 30)]))
    got = substring_dedup.substring_dedup(docs)
    assert got.count() == docs.count()
    assert {r.n_removed for r in got.filter("doc_id is null").collect()} == {29}  # all but the first window's first word, in both rows


def test_suffix_automaton():
    r = random.Random(2)
    for _ in range(60):
        held = [[r.choice("ab") for _ in range(r.randint(1, 12))] for _ in range(3)]
        automaton = substring_dedup.SuffixAutomaton()
        for x in held:
            automaton.add(x)
        asked = [r.choice("abc") for _ in range(15)]
        inside = lambda part: any(x[i : i + len(part)] == part for x in held for i in range(len(x)))
        want = [max(n for n in range(e + 2) if n == 0 or inside(asked[e + 1 - n : e + 1])) for e in range(len(asked))]
        assert automaton.matching_statistics(asked) == want


def _alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("block", [1 << 19, 12])
def test_decontamination(spark, block):
    held = [(r.doc_id, r.text) for r in odd_table(spark).collect()]
    items = [(1, "w1 w2"), (2, None), (30, " ".join(held[5][1].split()[:25]) if held[5][1] else "q"), (4, "W3"), (5, "w1 w2"), (None, "w5 w6 w7"), (7, "é漢")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for n, t in items:
        w = _alnum(t)
        for p in range(len(w) - min(10, len(w)) + 1) if w else ():
            windows[tuple(w[p : p + 10])].add(n)
    want = []
    for i, t in held:
        w, hit, named = _alnum(t), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if (key := tuple(w[p : p + size])) in windows:
                    hit |= set(range(p, p + size))
                    named |= windows[key]
        named = sorted(str(n) for n in named if n is not None)
        want.append((i, len(w), len(hit), len(named), sha(",".join(named)), bool(hit)))
    docs = table(spark, held)
    found = decontaminate.search(docs.select("doc_id", "text"), benchmark, block_words=block)
    names = F.array_sort(F.array_distinct("__items"))
    found = found.select("doc_id", F.col("__words").alias("n"), decontaminate.hit_words().alias("hit"), F.size(names).alias("items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("sha"))
    assert rows(found.withColumn("bad", F.col("hit") > 0), "doc_id", "n", "hit", "items", "sha", "bad") == sorted(want, key=repr)
    assert docs.columns == decontaminate.decontaminated(docs, benchmark).columns
    assert decontaminate.decontaminated(docs, benchmark).count() == sum(not x[-1] for x in want)
    assert decontaminate.contamination(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0


def test_matches_are_longest(spark):
    words = [f"v{i}" for i in range(30)]
    docs = table(spark, [(1, "a b " + " ".join(words[3:28]) + " c"), (2, " ".join(words[:9]))])
    benchmark = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    assert rows(decontaminate.matches(docs, benchmark), "doc_id", "item_id", "doc_word", "item_word", "n_words") == [(1, "9", 2, 3, 25)]
    got = decontaminate.contamination(docs, benchmark)
    assert rows(got, "doc_id", "longest", "longest_at") == [(1, 25, 2), (2, 0, -1)]
    named = benchmark.select(F.concat(F.lit("item-"), "item_id").alias("item_id"), "text")  # ids may be strings
    assert rows(decontaminate.contamination(docs, named), "doc_id", "n_items", "items_sha256")[0] == (1, 1, sha("item-9"))


def _shingles(text, k):
    w = re.findall(SPACE, (text or "").translate(LOWER))
    return {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize(("k", "seed"), [(4, 1), (5, 2), (4, 3)])
def test_near_dedup(spark, k, seed):
    r = random.Random(seed)
    held = texts(seed)
    base = [f"b{i}" for i in range(60)]
    for edits in list(range(12)) * 5:  # a large group of near copies, some of them linked to a few others only
        w = list(base)
        for _ in range(edits):
            w[r.randrange(60)] = f"e{r.randint(0, 12)}"
        held.append(" ".join(w))
    held = list(enumerate(held + ODD))
    sets = [_shingles(t, k) for _, t in held]
    label = list(range(len(held)))
    for i in range(len(held)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    want = [(i, len(s), label[i], label[i] == i) for i, s in enumerate(sets)]
    r.shuffle(held)
    assert rows(near_dedup.near_dedup(table(spark, held), k), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)


def test_near_dedup_of_odd_rows(spark):
    docs = odd_table(spark).unionByName(table(spark, [(None, "n m o p"), (None, "n m o p"), (None, None)]))
    got = near_dedup.near_dedup(docs)
    assert got.count() == docs.count() and got.filter("kept is null").count() == 0
    assert near_dedup.deduplicated(docs).columns == docs.columns


def test_rows_are_deduplicated_each_by_itself(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    near = lambda t: t + " more"
    held = [(1, a), (None, near(a)), (None, b), (None, None), (None, None),  # a copy without an id takes no other
            (2, c), (3, near(c)), (3, d), (3, d),  # nor one with an id the other text of it; repeated rows are one
            *[(None, "n " + a[::-1])] * 3, (None, near("n " + a[::-1])),  # of copies without ids one row stays
            (4, "q " + b[::-1]), (4, "Q " + b[::-1])]  # and of texts with one id
    got = [(r.doc_id, r.text) for r in near_dedup.deduplicated(table(spark, held)).collect()]
    few = [x for x in got if x not in {(None, None)} and not (x[1] or "").startswith(("n ", "q ", "Q "))]
    assert sorted(few, key=repr) == sorted([(1, a), (None, b), (2, c), (3, d), (3, d)], key=repr)
    assert got.count((None, None)) == 2
    assert sum(1 for x in got if (x[1] or "").startswith("n ")) == 1 and sum(1 for x in got if x[0] == 4) == 1


SPECIAL = ["<|endoftext|>", "<|endoftext|> hi", "a  <|endoftext|><|endoftext|>  \n b.\n<|endoftext", "x.<|endoftext|> y"]


@pytest.fixture(scope="module")
def reference_encoder():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokens.default_path())
    return lambda text: made.encode(text or "", add_special_tokens=False)


def test_ids_are_those_of_tokenizers(reference_encoder):
    encode = tokens.encoder(tokens.default_path())
    for text in texts(4) + [t for t in ODD if t] + ["it's <|endoftext|> naïve 漢字　 \U0001f600 don't\r\n\t x", "z" * 5000, *SPECIAL]:
        made = encode(text)
        assert made.tolist() == reference_encoder(text).ids
        assert encode.sizes[made].sum() == len(text.encode())


def test_spans_of_files_that_are_not_byte_level():
    import public_tokenizers

    encode = tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = "Naïve  Words,\n漢字 <|endoftext|> END"
    ids, begins, ends = encode.spans(text)
    assert encode.sizes is None and len(ids) == len(begins) > 5
    parts = [text.encode()[a:b].decode(errors="replace") for a, b in zip(begins, ends, strict=True)]
    assert parts[-2:] == ["<|endoftext|>", "END"] and "," in parts and all(parts)


def test_token_counts_by_offsets(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, [(1, "One two.\n\nThree, four\n"), (2, None), (3, "é漢 ß. x")])
    found = token_counts.section_tokens(docs, path, token_counts.lines).collect()
    for i, text in ((1, "One two.\n\nThree, four\n"), (2, ""), (3, "é漢 ß. x")):
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.section)
        # white space is in no token of this file and lines cut none, so lines can be encoded one by one
        assert [r.n_tokens for r in own] == [len(tokens.encoder(path)(x)) for x in (text.splitlines(True) or [""])]


def test_tiers_and_gaps():
    pool, sizes = packing.Pool(), [700, 600, 300, 200, 130, 120, 100, 90, 60, 40, 8, 3]
    for i, n in enumerate(sizes):
        pool.add((i, 0, np.full(n, i, np.uint32), n))
    made = list(packing.windows(pool, (128, 256, 512, 1024)))
    assert Counter({i: n for i, n in enumerate(sizes)}) == sum((Counter({p[0]: len(p[2])}) for w in made for p in w), Counter())
    # the longest tier first, each window begun by a tail of its tier, gaps filled by the largest tails of shorter tiers
    # and at last by a cut of the next one
    assert [(p[0], len(p[2])) for p in made[0]] == [(0, 700), (2, 300), (10, 8), (11, 3), (1, 13)]
    assert [(p[0], p[1], len(p[2])) for p in made[1]][:3] == [(1, 13, 587), (3, 0, 200), (4, 0, 130)]
    assert [sum(len(p[2]) for p in w) for w in made[:2]] == [1024, 1024]
    assert all(n & (n - 1) == 0 for w in made for n in [sum(len(p[2]) for p in w)])


def test_packing(spark, reference_encoder):
    docs = odd_table(spark).unionByName(table(spark, list(enumerate(SPECIAL, 800)))).repartition(3)
    held = Counter((r.doc_id, r.text) for r in docs.collect())
    found = packing.pack(docs, with_ids=True).collect()
    sequences = defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append(r)
    pieces = Counter()
    for r in found:
        pieces[(r.doc_id, r.start, r.ids)] += 1
    for doc, text in held:
        ids = np.array([*reference_encoder(text).ids, 0], "<u4")
        own = {start: data for (i, start, data) in pieces if i == doc and ids.tobytes()[4 * start : 4 * start + len(data)] == data}
        at = 0
        while at < len(ids):  # pieces of this text follow one another
            assert at in own
            at += len(own[at]) // 4
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        size = sum(r.length for r in parts)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert size <= 1024 and size & (size - 1) == 0 and {r.tier for r in parts} == {size}
    assert sum(r.length for r in found) == sum(n * (len(reference_encoder(t).ids) + 1) for (_, t), n in held.items())


def test_step_groups_are_balanced(spark):
    docs = table(spark, [(i, "word " * (i % 700)) for i in range(400)]).coalesce(1)
    groups = packing.pack(docs, step_tokens=4096).groupBy("tier", "step_group").agg(F.sum("length").alias("n")).collect()
    for tier in {r.tier for r in groups}:
        assert sorted(r.n for r in groups if r.tier == tier)[1:] == [4096] * (sum(r.tier == tier for r in groups) - 1)


@pytest.mark.parametrize("rule", ["largest", "first", "last"])
@pytest.mark.parametrize("sections", [token_counts.sentences, token_counts.lines])
def test_token_counts(spark, reference_encoder, rule, sections):
    docs = odd_table(spark).unionByName(table(spark, [(900, "One. Two! Three?\n\n\nFour. é漢. End"), (901, "a.\n\n b.\n\n\n\n c"), *enumerate(SPECIAL, 910)]))
    got = defaultdict(list)
    for r in token_counts.section_tokens(docs, sections=sections, rule=rule).collect():
        got[r.doc_id].append(r)
    for i, text in {r.doc_id: r.text for r in docs.collect()}.items():
        data = (text or "").encode()
        starts = sections(np.frombuffer(data, np.uint8)).tolist()
        bounds = [*starts, len(data)]
        sizes = tokens.encoder(tokens.default_path()).sizes[reference_encoder(text).ids].tolist()
        want, at = Counter(), 0
        for n in sizes:
            shares = [max(0, min(bounds[k + 1], at + n) - max(bounds[k], at)) for k in range(len(starts))]
            hit = [k for k, s in enumerate(shares) if s]
            want[{"first": hit[0], "last": hit[-1], "largest": max(hit, key=lambda k: (shares[k], -k))}[rule]] += 1
            at += n
        own = sorted(got[i], key=lambda r: r.section)[:: max(1, len(got[i]) // len(starts))]
        assert [r.n_tokens for r in own] == [want[k] for k in range(len(starts))]
        assert [(r.char_start, r.char_end) for r in own] == [(len(data[:a].decode()), len(data[:b].decode())) for a, b in zip(bounds, bounds[1:], strict=False)]
        assert all(r.doc_tokens == len(sizes) for r in own)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def _valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def test_pii(spark):
    r = random.Random(5)
    held = ["".join(r.choice("a.@1-+ 0239.%()_b@é") for _ in range(r.randint(0, 200))) for _ in range(800)]
    held += ODD + ["1.2.3.4.5.6.7.8 0000000255.1.1.256 001.255.0.9 x@y.z_a@b.c.d@e.f", "4111 1111 1111 1111 and 378282246310005", "call +1 (650) 253-0000.", "a@b.c " * 1500, "9" * 20000, "a" * 50000 + "@", "+" * 3000]
    docs = table(spark, list(enumerate(held)))
    for row in pii.personal_data(docs).collect():
        text = held[row.doc_id] or ""
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) if len(text) < 15000 for m in re.finditer(p, text) if _valid(kind, m[0]))
        if len(text) < 15000:
            assert row.base_sha256 == sha(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans))
            assert [row[f"n_{k}"] for k in PATTERNS] == [sum(x[3] == k for x in spans) for k in PATTERNS]
            assert {f"{kind}:{a}:{b}" for a, _, b, kind in spans} <= set(row.spans.split(",")) | {""}


def test_pii_adds_checked_kinds(spark):
    docs = table(spark, [(1, "iban GB82 WEST 1234 5698 7654 32 or DE89370400440532013001"), (2, "my SSN: 123-45-6789"), (3, "part 123-45-6789"), (4, None), (5, "mail x@y.org now")])
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert got == {1: "iban:5:32", 2: "ssn:8:19", 3: "", 4: "", 5: "email:5:12"}
    assert rows(pii.masked(docs), "doc_id", "text")[4] == (5, "mail <email> now") and pii.masked(docs).columns == docs.columns


def test_no_python_in_native_plans(spark, sf):
    from factmill.llm import quality_rules

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (pii.personal_data(docs), quality_rules.quality_rules(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_subpackage_is_imported_by_nothing_else():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "factmill")):
        if "llm" not in folder.split(os.sep):
            for name in names:
                if name.endswith(".py"):
                    assert "llm import" not in open(os.path.join(folder, name)).read()
