"""Helpers for operators that are DataFrame expressions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is worked out once, also if it is used inside lambdas."""
    return F.transform(F.array(value), then)[0]


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
