"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontaminate, html_extract, media, mixing, ngram_join, quality, secrets, token_store, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_media_columns": media.op4_media_columns,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_token_store": token_store.op6_token_store,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_html_extraction": html_extract.op9_html_extraction,
    "op10_quality": quality.op10_quality,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_mix_sources": mixing.ORACLE,
    "op7_ngram_join": ngram_join.ORACLE,
}
