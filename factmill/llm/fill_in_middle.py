"""Fill-in-middle examples by escaped markers: texts are cut at line ends and their parts put in another order.

A delimiter that a text may hold itself is escaped first, so that the one that ``regexp_replace`` then appends to every
unit is unmistakable: counting it counts the units, and ``substring_index`` takes the parts between two of them. Parts
are unescaped and put together with marks. Everything is a DataFrame expression on one row: there is no shuffle, and a
task holds one text and a few copies of it.

A text of n units is cut after the smaller and the larger of h1 % (n + 1) and h2 % (n + 1) units. h1 to h4 are digits of
a hash of the seed and the doc_id, so a text is cut alike in every run.

Defined cases: a null text is an empty one. An empty text, one that holds a mark, and one that the rate leaves out are
plain: the output is the text. A null doc_id is hashed as an empty one. Rows with one doc_id are cut each by itself, at
the same hashes. doc_id may be of any type that has a text form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried

#: Prefix, suffix, middle.
MARKS = ("<P>", "<S>", "<M>")

#: A unit: a line with its end, or what follows the last end.
UNIT = r"[^\n]*+\n|[^\n]++"

_DELIMITER, _ESCAPE = "\x01", "\x02"


def escaped(text: Column) -> Column:
    """``text`` without a delimiter: two characters stand for each delimiter and for each escape."""
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e")), F.lit(_DELIMITER), F.lit(_ESCAPE + "d"))


def unescaped(text: Column) -> Column:
    """The text of a part: without the delimiters between its units, and with its own characters again."""
    bare = F.replace(text, F.lit(_DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_ESCAPE + "d"), F.lit(_DELIMITER)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))


def _index(text: Column, delimiter: str, count: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(delimiter), count)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. No mark overlaps itself, so the first one found is the one put in."""
    p, s, m = marks
    parts = {
        "psm": lambda: (_index(F.substr(output, F.lit(len(p) + 1)), s, F.lit(1)), _index(output, m, F.lit(-1)), _index(_index(output, m, F.lit(1)), s, F.lit(-1))),
        "spm": lambda: (_index(_index(output, m, F.lit(1)), p, F.lit(-1)), _index(output, m, F.lit(-1)), _index(F.substr(output, F.lit(len(s) + 1)), p, F.lit(1))),
    }
    return F.when(form == "psm", F.concat(*parts["psm"]())).when(form == "spm", F.concat(*parts["spm"]())).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``docs`` with n, form, prefix, middle, suffix, output; of plain rows the three parts are null.

    Of 100 texts about ``rate`` are rearranged, and of 100 of these about ``spm_rate`` with the suffix first. Columns of
    ``docs`` with one of these six names give way to them.
    """
    if any(not x or x in y for i, x in enumerate(marks) for j, y in enumerate(marks) if i != j):
        raise ValueError("marks must differ and none may hold another")
    if any(x[:k] == x[-k:] for x in marks for k in range(1, len(x))):
        raise ValueError("no mark may end as it begins")
    made = ("n", "form", "prefix", "middle", "suffix", "output")
    inner, back = carried(docs, "doc_id", "text")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = lambda i: F.conv(F.substring("__key", 8 * i + 1, 8), 16, 10).cast("long")
    text = F.coalesce("text", F.lit(""))
    held = F.lit(False)
    for mark in marks:
        held = held | F.contains(text, F.lit(mark))
    marked = inner.withColumn("__key", key).withColumn("__marked", F.regexp_replace(escaped(text), UNIT, "$0" + _DELIMITER))
    counted = marked.withColumn("n", F.regexp_count("__marked", F.lit(_DELIMITER)).cast("long"))
    ends = counted.select("*", *(F.pmod(h(i), F.col("n") + 1).alias(f"__e{i}") for i in (0, 1)), h(2).alias("__h2"), h(3).alias("__h3"))
    cut = ends.withColumn("__low", F.least("__e0", "__e1").cast("int")).withColumn("__high", F.greatest("__e0", "__e1").cast("int"))
    form = F.when((text == "") | held | (F.pmod("__h2", F.lit(100)) >= rate), "plain").when(F.pmod("__h3", F.lit(100)) < spm_rate, "spm").otherwise("psm")
    head = _index(F.col("__marked"), _DELIMITER, F.col("__high"))
    parts = {
        "prefix": _index(F.col("__marked"), _DELIMITER, F.col("__low")),
        "middle": _index(head, _DELIMITER, F.col("__low") - F.col("__high")),
        "suffix": _index(F.col("__marked"), _DELIMITER, F.col("__high") - F.col("n").cast("int") - 1),
    }
    split = cut.withColumn("form", form).withColumns({c: F.when(F.col("form") != "plain", unescaped(x)) for c, x in parts.items()})
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "psm", F.concat(p, F.col("prefix"), s, F.col("suffix"), m, F.col("middle")))
    output = output.when(F.col("form") == "spm", F.concat(s, F.col("suffix"), p, F.col("prefix"), m, F.col("middle"))).otherwise(text)
    stay = [b for b, c in zip(back, docs.columns, strict=True) if c.lower() not in made]
    return split.withColumn("output", output).select(*stay, *made)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every document."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units,
    [CAST('0x' || substr(k, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM d
), e AS (
  SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS low,
    greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS high,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
      WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
    array_to_string(units[high + 1:n], '') AS suffix FROM e
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
