"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir`` or set on the context; it must be one that all executors share."""
    sc = spark.sparkContext
    if (named := sc.getConf().get("spark.checkpoint.dir", None)) and not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))  # one process on one machine
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let Arrow batches of this session hold so many bytes at most, as a batch of 10,000 texts may be large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: a lost executor takes nothing of it away."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, but as a compressed table; the shuffles that led to it are removed once it is written."""
    spark, path = df.sparkSession, f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
