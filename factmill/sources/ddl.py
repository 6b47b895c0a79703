"""Runs SQL scripts of definitions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def statements(script: str) -> list[str]:
    """The statements of a script: whole-line comments go, semicolons part."""
    lines = [line for line in script.splitlines() if not line.strip().startswith("--")]
    return [s.strip() for s in "\n".join(lines).split(";") if s.strip()]


def run(spark: SparkSession, script: str) -> int:
    """Run the statements in order; returns how many."""
    found = statements(script)
    for statement in found:
        spark.sql(statement)
    return len(found)
