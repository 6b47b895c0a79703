"""Half-open source intervals, counted from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(start_line: Column, start_col: Column, end_line: Column, end_col: Column, line: Column, col: Column) -> Column:
    """Whether (line, col) is in [start, end)."""
    begun = (start_line < line) | ((start_line == line) & (start_col <= col))
    return begun & ((line < end_line) | ((line == end_line) & (col < end_col)))


def contains_line(start_line: Column, end_line: Column, line: Column) -> Column:
    return (start_line <= line) & (line < end_line)


def location_text(path: Column, start_line: Column, end_line: Column) -> Column:
    """`file#Lfirst-last`."""
    return F.concat(path, F.lit("#L"), start_line.cast("string"), F.lit("-"), (end_line - 1).cast("string"))
