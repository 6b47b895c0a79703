"""Deterministic identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import blank


def type_id(language: Column, qualified_name: Column) -> Column:
    return F.concat(language, F.lit(":"), qualified_name)


def executable_id(language: Column, qualified_name: Column, signature: Column) -> Column:
    return F.concat(type_id(language, qualified_name), F.lit("#"), signature)


def field_id(language: Column, owner: Column, name: Column) -> Column:
    return F.concat(type_id(language, owner), F.lit("."), name)


def parameter_id(parent: Column, index: Column) -> Column:
    """``index`` counts from 1."""
    return F.concat(parent, F.lit(".param("), index.cast("string"), F.lit(")"))


def position_id(language: Column, path: Column, line: Column, col: Column) -> Column:
    return F.concat_ws(":", language, path, line.cast("string"), col.cast("string"))


def relation_id(source: Column, kind: Column, target: Column, line: Column, col: Column, number: Column | None = None) -> Column:
    """``number`` above 0 tells relations at one place apart."""
    base = F.concat(F.concat_ws(":", source, kind, F.coalesce(blank(target), F.lit("ext"))), F.lit("@"), line.cast("string"), F.lit(":"), col.cast("string"))
    return base if number is None else F.when(number > 0, F.concat(base, F.lit("#"), number.cast("string"))).otherwise(base)
