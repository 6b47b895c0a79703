"""Small tables of texts with everything that operators must stand."""

import random

#: Names that operators work with.
INNER = ["__id", "__own", "__w", "__words", "__hot", "__kept", "__mark", "__hash", "__in0", "__x0", "__group", "node", "label"]
ODD = [None, "", " ", "\n\n", "a", "A  b", "x\ty\nz", "é漢 ß", "9 9 9", "word " * 3000, "\x0b\x0c"]


def texts(seed, n=40, vocabulary=30, longest=80):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "tea,", "X.Y"]
    out = []
    for _ in range(n):
        made = [r.choice(words) for _ in range(r.randint(0, longest))]
        out.append("".join(w + r.choice([" ", " ", " ", "\n", "  "]) for w in made))
    for i in range(n // 3):  # near and exact copies, shared passages
        a = out[r.randrange(n)].split(" ")
        if i % 3 == 1 and len(a) > 2:
            a[r.randrange(len(a))] = "changed"
        if i % 3 == 2:
            b = out[r.randrange(n)].split(" ")
            a = b[: len(b) // 2] + a
        out.append(" ".join(a))
    return out


def table(spark, rows, extra=True):
    """(doc_id, text) rows, repeated ones and null ids among them, with columns whose names clash with those of results."""
    made = [(i, t, "en", "s", 0, -1, "k", True, *range(len(INNER))) for i, t in rows]
    inner = ", ".join(f"{c} long" for c in INNER)
    return spark.createDataFrame(made, f"doc_id long, text string, lang string, source string, n_chars long, n_words long, kept_sha256 string, kept boolean, {inner}")


def odd_table(spark, seed=1):
    rows = list(enumerate(texts(seed) + ODD))
    random.Random(seed).shuffle(rows)
    return table(spark, rows + rows[:3])
