"""How far the sources of a language differ in their words, by whole-number frequencies.

Terms are runs of letters, A-Z lower-cased. Each language keeps the terms that are in at least ``least`` of its
documents. The terms of all documents are counted once a (language, source, term); the groups of a language are then
crossed with its kept terms, so that a term that a group lacks counts as 0; each count becomes a smoothed frequency p in
parts of 10^9; and a join of the groups on language and term gives the distance (p - q)^2 / (p + q) of every two sources
of a language, summed over the terms. A group's own terms are those that it has oftener than its language has.

All numbers are whole. p is worked out in decimals, since a count times 10^9 can pass 64 bits.

At scale: words are counted before the shuffle; crossing and joining touch sources x kept terms, and (sources of a
language)^2 x kept terms, rows, which is what is asked. The crossing is an equi-join dealt by language and a hash of the
term, so one large language is spread over all tasks, and nothing is broadcast by hint.

Defined cases: a null text, language or source is an empty one. Each row is a document of its own, whatever its doc_id.
A group without terms is compared all the same. In a language without kept terms all distances are 0. An empty table
gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: What stands between terms. Splitting there gives the matches of its complement in a fifth of the time of extracting them.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
PARTS = 1_000_000_000


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z alone lower-cased; texts of ASCII alone take the shorter way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = F.sort_array(F.split(ascii_lower(text("text")), BETWEEN, -1))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), found.alias("term"))
    # beside each term the one before it in order, so that a document's first one of a kind is known
    rows = rows.withColumn("before", F.concat(F.array(F.lit("")), "term"))
    each = rows.select("lang", "source", F.inline(F.arrays_zip("term", "before"))).filter(F.col("term") != "")
    first = F.when(F.col("term") != F.col("before"), 1).otherwise(0).cast("long")
    return each.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum(first).alias("docs"))


def _frequency(n: str, total: str, kept: str) -> Column:
    return F.expr(f"1 + (cast({PARTS} as decimal(10, 0)) * (cast({n} as decimal(20, 0)) + 2)) div (cast({total} as decimal(20, 0)) + 2 * {kept})")


_DISTANCE = "((p - q) * (p - q)) div (p + q)"


def frequencies(docs: DataFrame, least: int = 10) -> DataFrame:
    """(lang, source, term, n, p, q): the frequency of each kept term in each group and in the whole language.

    Each language has one row more a group, whose term is empty and whose p and q are 1: it stands for the group itself.
    """
    counts = stored(term_counts(docs), "divergence-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).filter(F.col("docs") >= least).drop("docs")
    terms = stored(terms, "divergence-terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("all"))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(empty("lang"), empty("source")).distinct()
    own = counts.join(terms.select("lang", "term"), ["lang", "term"]).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "all"])
    deal = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = terms.withColumnRenamed("n", "lang_n").withColumn("deal", F.pmod(F.hash("term"), F.lit(deal)))
    wide = sizes.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    crossed = whole.join(wide, ["lang", "deal"]).drop("deal")
    dense = crossed.join(counts.drop("docs"), ["lang", "source", "term"], "left").fillna(0, ["n"])
    rows = dense.select("lang", "source", "term", "n", _frequency("n", "total", "kept").alias("p"), _frequency("lang_n", "all", "kept").alias("q"))
    one = F.lit(1).cast("long")
    return rows.unionByName(groups.select("lang", "source", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), one.alias("p"), one.alias("q")))


def source_distances(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each source to each other one of its language."""
    a = rows.select("lang", "term", "source", "p")
    b = rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    half = a.join(b, ["lang", "term"]).filter(F.col("source") < F.col("item"))
    half = half.groupBy("lang", "source", "item").agg(F.sum(F.expr(_DISTANCE)).alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return half.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def own_terms(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms that a group has oftener than its language, and by how much."""
    more = rows.filter((F.col("n") > 0) & (F.col("p") > F.col("q")))
    return more.select("lang", "source", F.col("term").alias("item"), F.expr(_DISTANCE).alias("value"))


def divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources as ``pair``, the first ``top`` own terms as ``term``."""
    rows = stored(frequencies(docs, least), "divergence-rows")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(source_distances(rows), "pair").unionByName(ranked(own_terms(rows), "term").filter(F.col("rank") <= top))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), g AS (SELECT DISTINCT lang, source FROM d), x AS (
  SELECT lang, source, unnest(terms) AS term FROM d
), y AS (
  SELECT lang, unnest(list_distinct(terms)) AS term FROM d
), kept AS (SELECT lang, term FROM y GROUP BY ALL HAVING count(*) >= 10
), c AS (
  SELECT lang, source, term, count(*) AS n FROM x JOIN kept USING (lang, term) GROUP BY ALL
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL
), r AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS gn,
    sum(coalesce(n, 0)) OVER (PARTITION BY lang, term) AS ln, sum(coalesce(n, 0)) OVER (PARTITION BY lang) AS alln, v
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
  SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (gn + 2 * v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (ln + 2) // (alln + 2 * v) AS q FROM r
), pairs AS (
  SELECT g.lang, g.source, o.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)), 0) AS value
  FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN p a ON a.lang = g.lang AND a.source = g.source
  LEFT JOIN p b ON b.lang = g.lang AND b.source = o.source AND b.term = a.term
  GROUP BY ALL
), own AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM own
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
