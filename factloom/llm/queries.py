"""The queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact_dedup, html_text, jaccard, mixture, pii, quality_rules, resample, simhash, toxicity, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": html_text.op1,
    "op2_chat_format": chat.op2,
    "op3_pii_feistel": pii.op3,
    "op4_url_filter": url_filter.op4,
    "op5_toxicity": toxicity.op5,
    "op6_source_mixture": mixture.op6,
    "op7_exact_dedup": exact_dedup.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_byte_bpe": bpe.op9,
    "op10_simhash": simhash.op10,
    "op11_whitening": whitening.op11,
    "op12_ngram_jaccard": jaccard.op12,
    "op13_importance_resampling": resample.op13,
}

SQL: dict[str, str] = {
    "op2_chat_format": chat.OP2_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op12_ngram_jaccard": jaccard.OP12_SQL,
    "op13_importance_resampling": resample.OP13_SQL,
}
