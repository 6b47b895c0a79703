"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import (
    decontaminate,
    divergence,
    fill_in_middle,
    language_id,
    line_dedup,
    near_dedup,
    packing,
    pii,
    quality_rules,
    substring_dedup,
    token_counts,
    toxicity,
    url_filter,
)
from .common import table

QUERIES = {
    "op1_quality_rules": lambda spark, d: quality_rules.quality_rules(table(spark, d, "documents")),
    "op2_toxicity": lambda spark, d: toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_token_counts": lambda spark, d: token_counts.section_tokens(table(spark, d, "documents")),
    "op4_language_id": lambda spark, d: language_id.language_id(table(spark, d, "documents")),
    "op5_decontamination": lambda spark, d: decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op6_substring_dedup": lambda spark, d: substring_dedup.substring_dedup(table(spark, d, "documents")),
    "op7_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op8_pii": lambda spark, d: pii.personal_data(table(spark, d, "documents")),
    "op9_line_dedup": lambda spark, d: line_dedup.line_dedup(table(spark, d, "documents")),
    "op10_near_dedup": lambda spark, d: near_dedup.near_dedup(table(spark, d, "documents")),
    "op11_fill_in_middle": lambda spark, d: fill_in_middle.digests(table(spark, d, "documents")),
    "op12_divergence": lambda spark, d: divergence.divergence(table(spark, d, "documents")),
    "op13_url_filter": lambda spark, d: url_filter.verdicts(table(spark, d, "pages")),
}

ORACLE_SQL = {
    "op5_decontamination": decontaminate.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op10_near_dedup": near_dedup.SQL,
    "op11_fill_in_middle": fill_in_middle.SQL,
    "op12_divergence": divergence.SQL,
}
