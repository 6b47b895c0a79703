"""Personal data by regular expressions, checksums and context.

Each kind has a pattern that proposes spans, leftmost and not overlapping within the kind; a validator that confirms
them (octets of at most 255, Luhn, mod-97, area rules); and words that, near a span, raise its score. Spans of the base
kinds stand whenever their validator holds. Spans of the further kinds (iban, ssn) stand from a score of 0.5 on.

Everything is a DataFrame expression: the text is split at a pattern, the matches are extracted, and running sums of
both give places in code points. Patterns are written with possessive parts and look-behinds, where that finds the same
spans, so that no text takes quadratic time. The context of a span is at most ``CONTEXT`` code points to either side, up
to the next span of its kind.

Defined cases: a null text is an empty one and has no spans. Rows with one doc_id are searched each by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let

CONTEXT = 40
LEAST_SCORE = 0.5

#: The base kinds, in their order, then the further ones.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}

#: A text without this has no span of the kind; it is cheaper to look for.
_GUARD = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}

#: Score of a span whose validator holds, before context.
_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.4}
NEAR = 0.2
_NEAR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|direcci[oó]n)\b",
    "card": r"(?i)\b(?:card|credit|visa|tarjeta|carte|karte|kreditkarte)\b",
    "phone": r"(?i)\b(?:phone|tel|telefon|t[eé]l[eé]phone|tel[eé]fono|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b",
    "ssn": r"(?i)\b(?:ssn|social security)\b",
}


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _octets(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda x: let(F.regexp_replace(x, "^0+", ""), lambda y: (F.length(y) < 3) | ((F.length(y) == 3) & (y <= "255"))))


def _luhn(match: Column) -> Column:
    return let(digits(match), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d))


def mod97(match: Column) -> Column:
    """Whether the characters, the first four moved to the end and letters read as 10 to 35, leave 1 modulo 97."""
    held = F.regexp_replace(match, r"\x20", "")
    turned = F.concat(F.substring(held, 5, 1 << 30), F.substring(held, 1, 4))

    def add(acc: Column, x: Column) -> Column:
        code = F.ascii(x)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.length(held).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), add) == 1)


def _areas(match: Column) -> Column:
    a, b, c = F.substring(match, 1, 3), F.substring(match, 5, 2), F.substring(match, 8, 4)
    return ~a.isin("000", "666") & (a < "900") & (b != "00") & (c != "0000")


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": lambda m: F.length(digits(m)).between(10, 15),
    "iban": mod97,
    "ssn": _areas,
}

_SPAN = "struct<start:int,order:int,stop:int,kind:string,score:double>"
_STEP = 256


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start, order, stop, kind, score>> of the valid matches of one kind."""
    none = F.array().cast(f"array<{_SPAN}>")

    def placed(both: Column) -> Column:
        gaps, found = both["gaps"], both["found"]
        # running sums; ready spans move to a list of lists now and then, so that no long list is copied for each match
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), none.alias("now"), F.array().cast(f"array<array<{_SPAN}>>").alias("done"))

        def add(acc: Column, match: Column) -> Column:
            gap = F.get(gaps, acc["i"])
            begin = acc["at"] + F.length(gap)
            after = F.get(gaps, acc["i"] + 1)
            near = F.right(gap, F.lit(CONTEXT)).rlike(_NEAR[kind]) | F.left(after, F.lit(CONTEXT)).rlike(_NEAR[kind])
            score = F.lit(_SCORE[kind]) + F.when(near, NEAR).otherwise(0.0)
            span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("order"), (begin + F.length(match)).alias("stop"), F.lit(kind).alias("kind"), score.alias("score"))
            stands = _VALID[kind](match) & (F.lit(kind in BASE) | (score >= LEAST_SCORE))
            now = F.when(stands, F.concat(acc["now"], F.array(span))).otherwise(acc["now"])
            full = F.size(acc["now"]) >= _STEP
            return F.struct(
                (begin + F.length(match)).alias("at"),
                (acc["i"] + 1).alias("i"),
                F.when(full, F.when(stands, F.array(span)).otherwise(none)).otherwise(now).cast(f"array<{_SPAN}>").alias("now"),
                F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            )

        return F.aggregate(found, start, add, lambda acc: F.concat(F.flatten(acc["done"]), acc["now"]))

    pattern = _PATTERN[kind]
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(_GUARD[kind](text), let(both, placed)).otherwise(none)


def detected(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__spans``: array<struct<start, order, stop, kind, score>> in order, in code points."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("__spans", F.sort_array(F.concat(*(_spans(text, k) for k in KINDS))))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; overlapping spans become one."""

    def add(acc: Column, x: Column) -> Column:
        new = x["start"] >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], x["stop"]).alias("at"),
            F.when(new, F.concat(acc["out"], F.array(gap, F.concat(F.lit("<"), x["kind"], F.lit(">"))))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("__spans", start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, 1 << 30)))
    return detected(docs).withColumn("text", F.when(F.size("__spans") > 0, done).otherwise(F.col("text"))).drop("__spans")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, top_score) of every document."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    found = detected(docs.select("doc_id", "text")).select("doc_id", "__spans")
    base = F.filter("__spans", lambda x: x["order"] < len(BASE))
    count = lambda kind: F.size(F.filter("__spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("__spans")).alias("spans"),
        F.size("__spans").cast("long").alias("n_spans"),
        F.array_max(F.transform("__spans", lambda x: x["score"])).alias("top_score"),
    )
