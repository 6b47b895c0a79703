"""URL filter: rules on host and path, and for all other URLs a ratio of two character language models.

The rules judge what they fit. URLs that they allow and URLs that they block are also what is learned from: for each of
the two a Markov model over characters, whose contexts are as long as the URL gives cause for. A context of ORDER
characters is smoothed by the next shorter one in proportion to how many different characters followed it (Witten and
Bell), down to equal chances; one that was never seen gives its place to the shorter one.

A URL's score is the difference of the two log-likelihoods for each character, the end included. Scores are calibrated
by a logistic curve with equal weight of both classes, fitted to the rows with crc32(url) mod FOLDS = 0, which the models
do not learn from. A URL that no rule fits is blocked if the calibrated chance that it is of the blocked kind is over 0.5.

Bounds: characters fall into SYMBOLS classes, so a model is an array of SYMBOLS^(ORDER + 1) counts, whatever is learned
from: 10 MB is what is broadcast, and at most twice as many counts as cells reach the driver. All rows are learned from;
counts and the histogram behind the calibration are whole numbers, so models do not depend on how rows are dealt.

Defined cases: a null URL or one without ``://`` has an empty host and path, which no rule fits; a null or empty URL is
allowed, with a chance of 0.5. Without URLs of both kinds there is no evidence: all chances are 0.5, and all that no rule
fits is allowed. Without rows of both kinds to calibrate by, the curve is the plain one. Repeated rows count each time.
Of rules that fit the longest decides, of one length the one with the longer host; of one rule told twice, block.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, flat, pieces
from .divergence import ascii_lower

#: The rules of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Rules become one expression each; more than this belong into a table.
MOST_RULES = 1000

ORDER = 3
FOLDS = 5
_MARKS = b"/.-_?=&#%:"
#: Letters, one class for digits, the marks, other ASCII, bytes above it, the edge of a URL.
SYMBOLS = 26 + 1 + len(_MARKS) + 3
EDGE = SYMBOLS - 1
CELLS = SYMBOLS ** (ORDER + 1)

_CLASS = np.full(256, SYMBOLS - 2, np.int64)
_CLASS[:128] = SYMBOLS - 3
_CLASS[48:58] = 26
_CLASS[65:91] = _CLASS[97:123] = np.arange(26)
_CLASS[list(_MARKS)] = 27 + np.arange(len(_MARKS))

#: Bins of scores for the calibration; scores beyond the ends count as the ends.
_BINS, _WIDTH = 8192, 1 / 256


# --- rules -----------------------------------------------------------------------------------------------------------


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def ordered(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(host, path, rule, verdict), the ones that decide first in front."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = []
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        if not host or verdict not in ("allow", "block"):
            raise ValueError(f"no rule: {rule!r}, {verdict!r}")
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        out.append((lower, slash + path, rule, verdict))
    return sorted(out, key=lambda x: (-len(x[2]), -len(x[0]), x[3] != "block"))


def _decided(rules, host: Column, path: Column, what: int) -> Column:
    found = F.lit(None).cast("string")
    for rule in reversed(ordered(rules)):
        fits = ((host == rule[0]) | F.endswith(host, F.lit("." + rule[0]))) & F.startswith(path, F.lit(rule[1]))
        found = F.when(fits, F.lit(rule[what])).otherwise(found)
    return found


# --- models ----------------------------------------------------------------------------------------------------------


def grams(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of ORDER + 1 symbols that end at each character of each URL and at its end, and where each URL begins."""
    data, offsets = flat(urls)
    n = len(offsets) - 1
    sizes = np.diff(offsets) + 1
    begins = offsets[:-1] + np.arange(n)  # of a URL's grams
    padded = np.full(len(data) + n * (ORDER + 1), EDGE, np.int64)
    lead = ORDER * (np.arange(n) + 1)
    padded[np.arange(len(data)) + np.repeat(begins - offsets[:-1] + lead, sizes - 1)] = _CLASS[data]
    at = np.arange(int(sizes.sum())) + np.repeat(lead, sizes)
    code = np.zeros(len(at), np.int64)
    for back in range(ORDER, -1, -1):
        code = code * SYMBOLS + padded[at - back]
    return code, begins


def _counted(batches):
    counts = np.zeros((2, CELLS), np.int64)
    for batch in pieces(batches, "url"):
        code, begins = grams(batch.column("url"))
        rejected = batch.column("rejected").to_numpy(zero_copy_only=False).astype(bool)
        mine = np.repeat(rejected, np.diff(np.append(begins, len(code))))
        for kind in (0, 1):
            some = code[mine == bool(kind)]
            np.add.at(counts[kind], some, 1)
    for kind in (0, 1):
        cells = np.flatnonzero(counts[kind])
        for i in range(0, len(cells), 1 << 16):
            some = cells[i : i + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(some), kind, np.int32)), "cell": pa.array(some), "n": pa.array(counts[kind][some])})


def log_chances(counts: np.ndarray) -> np.ndarray:
    """The log of the chance of each symbol after each context of ORDER symbols."""
    longer = counts.reshape((SYMBOLS,) * (ORDER + 1))
    levels = [longer]
    for _ in range(ORDER):
        levels.append(levels[-1].sum(axis=0))
    chance = np.full(SYMBOLS, 1 / SYMBOLS)
    for level in reversed(levels):
        total, kinds = level.sum(axis=-1, keepdims=True), (level > 0).sum(axis=-1, keepdims=True)
        chance = np.where(total > 0, (level + kinds * chance) / np.maximum(total + kinds, 1), chance)
    return np.log(chance).reshape(-1)


def logistic(scores: np.ndarray, accepted: np.ndarray, rejected: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and place of the logistic curve of the rejected among both; each class weighs one, and targets are softened."""
    a, b = 1.0, 0.0
    n0, n1 = accepted.sum(), rejected.sum()
    if not n0 or not n1:
        return a, b
    weight = accepted / n0 + rejected / n1
    target = (accepted / n0 / (n0 + 2) + rejected / n1 * (n1 + 1) / (n1 + 2)) / np.where(weight > 0, weight, 1)

    def loss(a, b):
        z = a * scores + b
        return float((weight * (np.logaddexp(0, z) - target * z)).sum())

    for _ in range(steps):  # Newton's method; a step that does not help is halved
        chance = 1 / (1 + np.exp(-np.clip(a * scores + b, -500, 500)))
        slope, bend = weight * (chance - target), weight * chance * (1 - chance) + 1e-12
        g = np.array([(slope * scores).sum(), slope.sum()])
        h = np.array([[(bend * scores**2).sum(), (bend * scores).sum()], [(bend * scores).sum(), bend.sum()]]) + 1e-9 * np.eye(2)
        step, now, size = np.linalg.solve(h, g), loss(a, b), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-10:
            break
        a, b = a - size * step[0], b - size * step[1]
    return float(a), float(b)


@dataclasses.dataclass
class UrlModel:
    """Log-likelihood differences by gram (None: no evidence), and the curve that turns scores into chances."""

    ratio: np.ndarray | None
    slope: float = 1.0
    place: float = 0.0


def _with_scores(df: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``df`` with ``__score``: the difference of the log-likelihoods for each character; null for an empty URL."""
    shared = df.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))
    names = [*df.columns, "__score"]

    def score(batches):
        ratio = shared.value
        for batch in pieces(batches, "url"):
            code, begins = grams(batch.column("url"))
            sizes = np.diff(np.append(begins, len(code)))
            sums = np.add.reduceat(ratio[code].astype(np.float64), begins)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums / sizes, mask=sizes == 1)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(score, f"{schema}, `__score` double")


def learn(labelled: DataFrame) -> UrlModel:
    """Both models and their calibration, from all rows of (url string, rejected boolean)."""
    fold = F.crc32(F.col("url").cast("binary")) % FOLDS == 0
    rows = labelled.select("url", "rejected").filter(F.col("url").isNotNull() & F.col("rejected").isNotNull())
    found = rows.filter(~fold).mapInArrow(_counted, "kind int, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow()
    kind, cell, n = (found.column(c).to_numpy() for c in ("kind", "cell", "n"))
    counts = np.zeros((2, CELLS), np.int64)
    counts[kind, cell] = n
    if not counts[0].any() or not counts[1].any():
        return UrlModel(None)
    ratio = log_chances(counts[1]) - log_chances(counts[0])
    score = F.col("__score")
    place = F.least(F.greatest(F.floor(score / _WIDTH) + _BINS // 2, F.lit(0)), F.lit(_BINS - 1)).cast("int")
    bins = _with_scores(rows.filter(fold), ratio).filter(score.isNotNull()).groupBy("rejected", place.alias("bin")).count().toArrow()
    held = np.zeros((2, _BINS))
    held[bins.column("rejected").to_numpy(zero_copy_only=False).astype(int), bins.column("bin").to_numpy()] = bins.column("count").to_numpy()
    centres = (np.arange(_BINS) - _BINS // 2 + 0.5) * _WIDTH
    return UrlModel(ratio, *logistic(centres, held[0], held[1]))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, and chance: that of being of the blocked kind by the models.

    Columns of ``pages`` with one of these names give way to them.
    """
    made = ("host", "path", "rule", "verdict", "chance")
    inner, back = carried(pages, "url")
    host, path = host_and_path(F.col("url"))
    placed = inner.withColumns({"__host": host, "__path": path})
    at = F.col("__host"), F.col("__path")
    placed = placed.withColumns({"__rule": _decided(rules, *at, 2), "__told": _decided(rules, *at, 3)})
    told = placed.filter(F.col("__told").isNotNull()).select("url", (F.col("__told") == "block").alias("rejected"))
    model = learn(told)
    scored = placed.withColumn("__score", F.lit(None).cast("double")) if model.ratio is None else _with_scores(placed, model.ratio)
    chance = F.coalesce(1 / (1 + F.exp(-(F.col("__score") * model.slope + model.place))), F.lit(0.5))
    verdict = F.coalesce("__told", F.when(F.col("chance") > 0.5, "block").otherwise("allow"))
    stay = [b for b, c in zip(back, pages.columns, strict=True) if c.lower() not in made]
    return scored.withColumn("chance", chance).select(
        *stay, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), verdict.alias("verdict"), "chance"
    )


def allowed(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The rows of ``pages`` whose URLs are allowed, as they are."""
    rows, names = judged(pages.withColumnsRenamed({c: f"__p{i}" for i, c in enumerate(pages.columns) if c.lower() != "url"}), rules), pages.columns
    return rows.filter(F.col("verdict") == "allow").drop("host", "path", "rule", "verdict", "chance").toDF(*names)


def verdicts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, chance) of every page."""
    return judged(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "chance")
