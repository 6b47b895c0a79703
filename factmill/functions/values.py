"""Small value rules that many operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(value: Column) -> Column:
    """The value, or null where it is empty: filters and targets treat both alike."""
    return F.nullif(value, F.lit(""))


def one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The value if it is allowed, else the default: how severities, kinds and statuses are read."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def parsed(text: Column, schema: str) -> Column:
    """Lenient JSON: unknown properties are ignored, a text that is none gives null."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def as_json(value: Column) -> Column:
    """JSON without null fields."""
    return F.to_json(value, {"ignoreNullFields": "true"})
