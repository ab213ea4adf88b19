"""Sources and sinks: checked record files, replaced partitions, hashed snapshots, delimited exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import text as X

CHUNK = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "company", "year", "item", "item_title", "text")])


def read_records(spark: SparkSession, path: str, schema: T.StructType = CHUNK) -> DataFrame:
    """A JSON list of records with a fixed schema; anything else fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def explode_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Rows from columns that hold arrays of the same length."""
    rest = [c for c in frame.columns if c not in columns]
    return frame.select(*rest, F.explode(F.arrays_zip(*columns)).alias("_z")).select(*rest, *[F.col("_z")[c].alias(c) for c in columns])


def replace_partitions(frame: DataFrame, path: str, keys: list[str]) -> None:
    """Write the partitions that ``frame`` has rows of, in place of what is there; others stay."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def revision(frame: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: the sum of their hashes as an exact number."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"}))
    got = frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")).first()
    return f"{got.n}-{got.h}"


def publish(frame: DataFrame, path: str) -> str:
    """Write a snapshot with a manifest; gives its revision."""
    frame.write.mode("overwrite").parquet(f"{path}/data")
    stored = frame.sparkSession.read.parquet(f"{path}/data")
    digest = revision(stored)
    manifest = json.dumps({"revision": digest, "columns": stored.columns})
    frame.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return digest


def published(spark: SparkSession, path: str, expected: str | None = None) -> DataFrame:
    """A snapshot, if its rows are those of its manifest and its revision is the expected one."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    frame = spark.read.parquet(f"{path}/data")
    if manifest["revision"] != revision(frame) or expected not in (None, manifest["revision"]):
        raise ValueError("the snapshot is not the expected one")
    return frame


def write_delimited(frame: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited rows: nested columns as JSON, one line each, no formulas."""
    flat = []
    for name, kind in frame.dtypes:
        c = F.col(f"`{name}`")
        c = F.to_json(c) if kind.startswith(("array", "struct", "map")) else c
        flat.append(X.safe_cell(F.regexp_replace(c.cast("string"), r"[\t\r\n]+", " ")).alias(name) if kind == "string" else c.alias(name))
    frame.select(*flat).write.mode("overwrite").option("header", True).option("sep", sep).option("quoteAll", sep == "\t").csv(path)


def nested(frame: DataFrame, levels: list[tuple[list[str], str, list[str]]]) -> DataFrame:
    """Rows as documents: each level (keys, name, columns) gathers its columns as a sorted array, innermost first. The
    groups are one document's parts."""
    for keys, name, columns in levels:
        frame = frame.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return frame


def check_records(chunks: DataFrame, sentences: DataFrame) -> DataFrame:
    """What is wrong with two tables: repeated ids, sentences without a paragraph, texts that are not in theirs."""
    twice = chunks.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated id").alias("problem"), "id")
    lost = sentences.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").select(F.lit("no paragraph").alias("problem"), "id")
    squeezed = chunks.select(F.col("id").alias("chunk_id"), X.squeeze(F.col("text")).alias("whole"))
    other = sentences.join(squeezed, "chunk_id").where(~F.col("whole").contains(X.squeeze(F.col("text")))).select(F.lit("not in its paragraph").alias("problem"), "id")
    return twice.unionByName(lost).unionByName(other)
