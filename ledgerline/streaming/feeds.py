"""Extension: reports that are saved again and again as a stream, and windowed counts of events with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def feed(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per time window and kind; rows later than the watermark are dropped from state."""
    timed = events.withWatermark(at, late)
    return timed.groupBy(F.window(at, window).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", "w.end", kind, "n")


def keep_latest(rows: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Write each batch's rows as a version of its own; the newest version of a key is what readers take."""

    def save(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
