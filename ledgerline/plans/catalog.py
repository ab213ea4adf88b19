"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.plans import alignment_queries, change_queries, evidence_queries, extraction_queries, fact_queries, metric_queries, report_queries, table_queries, text_queries

_MODULES = (change_queries, fact_queries, metric_queries, evidence_queries, report_queries, alignment_queries, extraction_queries, table_queries, text_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
FLAGSHIP = "distribution_two_dims"
