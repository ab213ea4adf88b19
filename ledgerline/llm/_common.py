"""What the operators of this subpackage share: tables, shared folders, Arrow batch bounds."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch that goes to a Python worker. Texts may be long, so far below Spark's 10,000.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that a worker never holds many long texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Only a local session, which has one machine,
    may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/ledgerline/{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stash(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The frame as a written table in the shared folder, and its path. In loops this is used in place of checkpoint(),
    whose frames carry the constraints of all rounds before and fill the driver's memory."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that a checkpoint has made needless; it does so when both garbage
    collectors have run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Let a Python worker hand memory that a task no longer needs back to the machine: workers live on, and what their
    allocators keep adds up over the stages of a job. Nothing happens where the C library cannot do it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI or a bare path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def remove_tree(spark: SparkSession, uri: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


__all__ = ["BATCH_ROWS", "table", "bound_batches", "shared_dir", "scratch", "stash", "checkpoint", "give_back", "local_path", "release", "remove_tree"]
