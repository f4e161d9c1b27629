"""The folder that driver and executors share, and what a session has written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode without one a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="quarry-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A new path for this application's tables."""
    return f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def width(spark: SparkSession) -> int:
    """Partitions of an explicit exchange: what the cluster sets for its shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete folders, in whatever store they are."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in map(hadoop, paths):
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes in fewer files than there are; else as it is, without an exchange. For work that is heavy a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df
