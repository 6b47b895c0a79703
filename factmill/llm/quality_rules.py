"""Quality rules: robust multivariate outliers by minimum covariance determinants.

Statistics of each whole text are turned into a vector (log of the mean word length, roots of the shares of symbols,
repeated lines and repeated words). For every language and source the minimum covariance determinant is searched as the
deterministic algorithm does: several robust first estimates (medians with median deviations, and with the correlations
of hyperbolic tangents and of spatial signs) are each taken through concentration steps, which estimate centre and
covariance from the half or more of the rows that lie nearest by Mahalanobis distance and never raise the determinant.
After ``first_steps`` the start with the least determinant is kept and goes on until its determinant falls no more (at
most ``steps`` in all). At last the estimate is made again from the rows inside a chi-square quantile. Rows whose
distance is beyond a far quantile are rejected.

All of it is DataFrame expressions and small aggregates over all rows: moments and quantile sketches are combined
before any shuffle, so a source with a third of the rows is no hot spot. Quantiles are ``percentile_approx`` with a
relative rank error of 1e-4. A covariance gets the squares of ``floors`` added on its diagonal (clean groups have
constant statistics, whose covariance would be singular). Groups of fewer than ``least_rows`` rows are pooled by
language, and what is then still smaller is pooled over all.

Defined cases: a null text has no words. Texts with fewer than 20 words or with more than 30 % of their words in
repeated windows fail the base rule whatever their distance, and take no part in the estimates. A null language or
source is a group of its own. Rows with one doc_id are judged each by itself. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, stored
from .native import let, words

WINDOW = 8
NAMES = ("length", "symbols", "lines", "repeats")
#: Least standard deviations of the vector's parts. Roots of shares end at 1, and at the root of 0.3 for repeats within
#: the base rule, so each floor must be small enough for its part to pass the cut alone: where clean rows are constant,
#: about a third of lines (0.33) or a sixth of words (0.16) do.
FLOORS = (0.1, 0.1, 0.1, 0.07)
LEAST_ROWS = 200
HALF = 0.75
STARTS = ("deviations", "tangents", "signs")
FIRST_STEPS = 2
STEPS = 20
#: A determinant that falls by less than this share has settled.
SETTLED = 1e-3
TAIL = 1e-6


# --- chi-square ------------------------------------------------------------------------------------------------------


def chi2_cdf(x: float, df: int) -> float:
    """The regularised lower gamma function, by its series."""
    if x <= 0:
        return 0.0
    a, z = df / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= z / k
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, df) < p else (low, middle)
    return high


# --- statistics of a text --------------------------------------------------------------------------------------------


def repeat_words(w: Column, k: int = WINDOW) -> Column:
    """How many words lie in windows of ``k`` words that are found twice or more in ``w``, an array column."""
    n = F.size(w)
    none = F.array().cast("array<bigint>")
    windows = F.when(n > k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(none)

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            found = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
            return F.sort_array(F.filter(found, lambda x: x.isNotNull()))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-k).cast("int").alias("last"))
        add = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(k), x - acc["last"])).alias("n"), x.alias("last"))
        return F.aggregate(let(pairs, places), start, add, lambda acc: acc["n"])

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (text, lang and source among the columns) with the statistics, their vector and the base rule."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = docs.columns
    found = docs.select(*kept, words(text).alias("__w"))
    found = found.select(
        *kept,
        F.size("__w").cast("long").alias("__n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("__word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("__n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("__lines"),
        repeat_words(F.col("__w")).alias("__n_repeat_words"),
    )
    n = F.col("__n_words")
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(b, F.lit(1).cast("long")))
    return found.select(
        *kept, "__n_words", "__word_chars", "__n_symbols", F.col("__lines.dup").alias("__n_dup_lines"), "__n_repeat_words",
        ((n < 20) | (100 * F.col("__n_repeat_words") > 30 * n)).alias("__base_failed"),
        F.log(F.greatest(F.col("__word_chars"), F.lit(1)) / F.greatest(n, F.lit(1))).alias("__x0"),
        share("__n_symbols", n).alias("__x1"),
        share("__lines.dup", F.col("__lines.n")).alias("__x2"),
        share("__n_repeat_words", n).alias("__x3"),
    )


# --- estimates -------------------------------------------------------------------------------------------------------

P = len(NAMES)
_X = [f"__x{i}" for i in range(P)]


def _grouped(rows: DataFrame, least_rows: int) -> DataFrame:
    """The rows with the group that their estimate is from."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    keyed = rows.withColumn("__key", F.concat(part("lang"), F.lit("\x1f"), part("source"))).withColumn("__lang", part("lang"))
    counts = keyed.filter("not __base_failed").groupBy("__key", "__lang").agg(F.count(F.lit(1)).alias("n"))
    pool = counts.withColumn("group", F.when(F.col("n") >= least_rows, F.col("__key")).otherwise(F.concat(F.lit("pool"), F.col("__lang"))))
    sizes = pool.groupBy("group").agg(F.sum("n").alias("all"))
    names = pool.join(sizes, "group").select("__key", F.when(F.col("all") >= least_rows, F.col("group")).otherwise(F.lit("rest")).alias("__group"))
    names = stored(names, "quality-groups")
    return keyed.drop("__lang").join(names, "__key", "left").withColumn("__group", F.coalesce("__group", F.lit("rest"))).drop("__key")


def _distance() -> Column:
    """The squared distance, given __m0.. (centre) and __wij (the inverse of the covariance's lower factor)."""
    total = F.lit(0.0)
    for i in range(P):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"__w{i}{j}") * (F.col(f"__x{j}") - F.col(f"__m{j}"))
        total = total + y * y
    return total


def _factored(moments: DataFrame, scale: float, floors: tuple[float, ...]) -> DataFrame:
    """Group, start, centre and the inverse of the lower Cholesky factor of scale * covariance + floors², with the log of
    the covariance's determinant, column by column."""
    cov = lambda i, j: F.col(f"__c{max(i, j)}{min(i, j)}") * scale + (floors[i] ** 2 if i == j else 0.0)
    out = moments
    for j in range(P):
        total = cov(j, j)
        for k in range(j):
            total = total - F.col(f"__l{j}{k}") * F.col(f"__l{j}{k}")
        out = out.withColumn(f"__l{j}{j}", F.sqrt(total))
        for i in range(j + 1, P):
            total = cov(i, j)
            for k in range(j):
                total = total - F.col(f"__l{i}{k}") * F.col(f"__l{j}{k}")
            out = out.withColumn(f"__l{i}{j}", total / F.col(f"__l{j}{j}"))
    for j in range(P):
        out = out.withColumn(f"__w{j}{j}", 1 / F.col(f"__l{j}{j}"))
        for i in range(j + 1, P):
            total = F.lit(0.0)
            for k in range(j, i):
                total = total - F.col(f"__l{i}{k}") * F.col(f"__w{k}{j}")
            out = out.withColumn(f"__w{i}{j}", total / F.col(f"__l{i}{i}"))
    determinant = sum((2 * F.log(f"__l{j}{j}") for j in range(P)), F.lit(0.0)).alias("__determinant")
    return stored(out.select(*_FACTOR, determinant), "quality-factors")


_FACTOR = ["__group", "__start", *(f"__m{i}" for i in range(P)), *(f"__w{i}{j}" for i in range(P) for j in range(i + 1))]


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("__group", "__start").agg(
        *(F.avg(x).alias(f"__m{i}") for i, x in enumerate(_X)),
        *(F.covar_pop(_X[i], _X[j]).alias(f"__c{i}{j}") for i in range(P) for j in range(i + 1)),
    )


def _first(rows: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """The first estimates, a row for each group and start: medians, and covariances of standardised values."""
    middle = stored(rows.groupBy("__group").agg(*(F.percentile_approx(x, 0.5, 10000).alias(f"__m{i}") for i, x in enumerate(_X))), "quality-medians")
    wide = rows.join(middle, "__group").groupBy("__group").agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(f"__m{i}")), 0.5, 10000).alias(f"__d{i}") for i, x in enumerate(_X)))
    middle = middle.join(wide, "__group").select("__group", *(f"__m{i}" for i in range(P)), *(F.greatest(1.4826 * F.col(f"__d{i}"), F.lit(floors[i])).alias(f"__d{i}") for i in range(P)))
    middle = stored(middle, "quality-medians")
    z = rows.join(middle, "__group").select("__group", *(((F.col(x) - F.col(f"__m{i}")) / F.col(f"__d{i}")).alias(f"z{i}") for i, x in enumerate(_X)))
    norm = F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0))), F.lit(1e-9))
    y = z.select("__group", *(F.tanh(f"z{i}").alias(f"t{i}") for i in range(P)), *((F.col(f"z{i}") / norm).alias(f"s{i}") for i in range(P)))
    y = y.groupBy("__group").agg(*(F.covar_pop(f"{c}{i}", f"{c}{j}").alias(f"{c}{i}{j}") for c in "ts" for i in range(P) for j in range(i + 1)))
    y = middle.join(y, "__group")
    # the variances of a standard normal's tangent (0.394) and of a spatial sign's part (1 / P) are made 1
    spread = {"deviations": lambda i, j: F.lit(float(i == j)), "tangents": lambda i, j: F.col(f"t{i}{j}") / 0.394, "signs": lambda i, j: F.col(f"s{i}{j}") * P}
    made = F.array(*(F.struct(F.lit(n).alias("__start"), *((F.col(f"__d{i}") * F.col(f"__d{j}") * spread[n](i, j)).alias(f"__c{i}{j}") for i in range(P) for j in range(i + 1))) for n in STARTS))
    y = y.select("__group", *(f"__m{i}" for i in range(P)), F.explode(made).alias("made")).select("__group", *(f"__m{i}" for i in range(P)), "made.*")
    return _factored(y, 1.0, floors)


def _concentrated(rows: DataFrame, factors: DataFrame, half: float, floors: tuple[float, ...]) -> DataFrame:
    """A concentration step for every group and start of ``factors``."""
    scale = half / chi2_cdf(chi2_quantile(half, P), P + 2)  # the covariance of the nearest rows is smaller than that of all
    near = rows.join(factors, "__group").select("__group", "__start", *_X, _distance().alias("__d"))
    bound = near.groupBy("__group", "__start").agg(F.percentile_approx("__d", half, 10000).alias("__bound"))
    near = near.join(stored(bound, "quality-bounds"), ["__group", "__start"]).filter("__d <= __bound")
    return _factored(_moments(near), scale, floors)


def least_determinants(rows: DataFrame, half: float = HALF, first_steps: int = FIRST_STEPS, steps: int = STEPS, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """One row a group: the centre and factor with the least determinant that concentration finds from any start."""
    active = _first(rows, floors)
    for _ in range(first_steps):
        active = _concentrated(rows, active, half, floors)
    best = active.groupBy("__group").agg(F.min(F.struct("__determinant", "__start")).alias("best"))
    active = stored(active.join(best.select("__group", F.col("best.__start").alias("__start")), ["__group", "__start"]), "quality-factors")
    settled = []
    for _ in range(steps - first_steps):
        after = _concentrated(rows, active, half, floors)
        before = active.select("__group", F.col("__determinant").alias("__before"))
        after = stored(after.join(before, "__group"), "quality-factors")
        done = F.col("__before") - F.col("__determinant") <= SETTLED
        settled.append(after.filter(done).drop("__before"))
        active = after.filter(~done).drop("__before")
        if active.isEmpty():
            break
    for x in settled:
        active = active.unionByName(x)
    return active


def estimates(rows: DataFrame, half: float = HALF, steps: int = STEPS, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """One row a group: centre and factor. ``rows``: __group and the vector of every row that passes the base rule."""
    factors = least_determinants(rows, half, steps=steps, floors=floors)
    inside = chi2_quantile(0.975, P)
    near = rows.join(factors, "__group").select("__group", "__start", *_X, _distance().alias("__d")).filter(F.col("__d") <= inside)
    return _factored(_moments(near), 0.975 / chi2_cdf(inside, P + 2), floors).drop("__determinant")


def judged(measured_rows: DataFrame, least_rows: int = LEAST_ROWS, tail: float = TAIL) -> DataFrame:
    """The rows of ``measured`` with ``__distance`` (squared; null where no group has an estimate) and ``__kept``.

    ``measured_rows`` is read many times and should be a stored table.
    """
    rows = _grouped(measured_rows, least_rows)
    factors = estimates(rows.filter("not __base_failed").select("__group", *_X))
    found = rows.join(factors, "__group", "left").withColumn("__distance", _distance())
    near = F.coalesce(F.col("__distance") <= chi2_quantile(1 - tail, P), F.lit(True))
    return found.withColumn("__kept", ~F.col("__base_failed") & near)


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of each row."""
    rows = stored(measured(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
    return judged(rows).select("doc_id", *(F.col(f"__{n}").alias(n) for n in names))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    inner, back = carried(docs, "text", "lang", "source")
    return judged(stored(measured(inner), "quality")).filter("__kept").select(*back)
