"""The read model: one row per alignment with its labels and scores.

The driver's tables stand in for filings: a document is an alignment, its source the company, its language the item, and
labels what an analyst said. Everything else is derived from the identifier and the length, the same way in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.aggregates import TYPES
from ledgerline.sources.tables import table

STATUSES = ("needs_review", "auto_matched", "ai_verified", "ai_verified", "unmatched")


def pick(values: tuple, index) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    k, n = F.col("doc_id"), F.col("n_chars")
    rows = d.join(labels, "doc_id", "left")
    kind = pick((*TYPES, None), k % 8)
    return rows.select(
        k.alias("match_id"), F.col("source").alias("company"), (F.lit(2020) + k % 3).cast("int").alias("previous_year"), (F.lit(2021) + k % 3).cast("int").alias("current_year"),
        F.col("lang").alias("item"), kind.alias("change_type"), pick(TYPES[1:5], n % 4).alias("lexical_label"), pick((*TYPES[1:5], None), n % 5).alias("semantic_label"),
        pick(STATUSES, k % 5).alias("status"),
        F.when(k % 8 == 5, "current_only").when(k % 8 == 6, "previous_only").otherwise("one_to_one").alias("relationship"),
        F.when(F.col("quality").isNull(), None).when(F.col("quality") == 1, "Yes").otherwise("No").alias("material"),
        F.when(F.col("quality").isNotNull(), (n % 101).cast("double") / 100).alias("materiality_score"),
        F.when(F.col("quality").isNotNull(), (n % 37).cast("double") / 36).alias("confidence_score"),
        n.alias("n_chars"), "text",
    )


_T = ", ".join(f"'{t}'" for t in TYPES)
SQL = f"""changes AS (
  SELECT d.doc_id AS match_id, source AS company, CAST(2020 + d.doc_id % 3 AS INT) AS previous_year, CAST(2021 + d.doc_id % 3 AS INT) AS current_year,
    lang AS item, ([{_T}])[CAST(d.doc_id % 8 + 1 AS INT)] AS change_type,
    (['Modified','Reworded','Expanded','Reduced'])[CAST(n_chars % 4 + 1 AS INT)] AS lexical_label,
    (['Modified','Reworded','Expanded','Reduced'])[CAST(n_chars % 5 + 1 AS INT)] AS semantic_label,
    (['needs_review','auto_matched','ai_verified','ai_verified','unmatched'])[CAST(d.doc_id % 5 + 1 AS INT)] AS status,
    CASE d.doc_id % 8 WHEN 5 THEN 'current_only' WHEN 6 THEN 'previous_only' ELSE 'one_to_one' END AS relationship,
    CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS material,
    CASE WHEN quality IS NOT NULL THEN CAST(n_chars % 101 AS DOUBLE) / 100 END AS materiality_score,
    CASE WHEN quality IS NOT NULL THEN CAST(n_chars % 37 AS DOUBLE) / 36 END AS confidence_score,
    n_chars, text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
