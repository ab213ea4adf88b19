"""Session defaults. On a cluster the submitting side decides; these only fill what a local run needs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("ledgerline")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. Only a local session, which has one machine, may leave it unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or f"/tmp/checkpoints/{context.applicationId}")
    return context.getCheckpointDir().rstrip("/")


def cut_lineage(frame: DataFrame) -> DataFrame:
    """The frame, checkpointed in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> tuple[DataFrame, str]:
    """The frame as a table written in the shared folder, and its path. For loops: checkpointed frames carry the partitioning,
    order and constraints of the plans before them, which the driver holds and reasons about in every round."""
    path = f"{shared_folder(frame.sparkSession)}/stored-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


def remove_stored(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no frame needs any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
