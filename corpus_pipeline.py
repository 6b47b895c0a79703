"""The corpus pipeline: quality rules, line dedup, near dedup, decontamination and packing of ``documents``.

Each stage takes what its predecessor kept and calls one operator of the library. All stages but the last return the
columns of documents. Nulls, empty texts, repeated rows and empty tables are as the operators define them; a document
whose lines are all dropped stays with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm.common import stored, table
from factmill.llm.decontaminate import decontaminated
from factmill.llm.line_dedup import dedup_lines
from factmill.llm.near_dedup import deduplicated
from factmill.llm.packing import pack
from factmill.llm.quality_rules import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that are in ten documents or more; n_chars is that of the text that stays."""
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in kept.columns else kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, a similarity of 0.8 or more."""
    return deduplicated(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten words or more of a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1024 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("packing", packing)]

#: The estimates behind the quality rules and the token ids of the packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
