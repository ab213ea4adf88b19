"""From raw documents to token shards: quality, near copies, decontamination, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages but the last give back the
columns of ``docs``, whatever they are, extra ones included. Nulls, empty and very long texts, repeated rows and empty
tables have the results that the operators' docstrings state:

- quality: rows whose score is under the threshold go; a null text is scored by the bias alone.
- near_copies: of each group of linked documents the row with the smallest identifier stays (of several such rows the one
  whose columns hash least); documents without words link with nothing and stay.
- decontaminate: a document with a hit of any benchmark item goes; the others stay whole.
- mix: a row per copy that its source's rate gives it.
- token_store: one row per row, with its place among all ids, from the shards read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate as contamination
from ledgerline.llm import mixing, ngram_join, quality, token_store
from ledgerline.llm._common import scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from all documents' labels but the held-out ones'."""
    known = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(known, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.good(docs, model)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents as their sources' target weights ask."""
    return mixing.copies(docs)


def token_store_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all documents in shards, and where each document is."""
    return token_store.read(token_store.write(docs, scratch(spark, "shards"), token_store.default_vocabulary()), digest=True)


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("token_store", token_store_stage),
]

#: The trained classifier cannot be written in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
