"""Cutting lineage with reliable storage that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: dict[DataFrame, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only where the setting is absent and all runs on one machine, as in tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="refminer-checkpoint-"))
        current = spark.sparkContext.getCheckpointDir()
    return str(named or current)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, written as Parquet to the shared folder and read again. It is there until release, or until the driver ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    if not _kept:
        atexit.register(_release_all)
    _kept[kept] = path
    return kept


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*frames: DataFrame) -> None:
    """Removes what cut has written for these; no plan that still has to run may read it."""
    for df in frames:
        remove(df.sparkSession, _kept.pop(df))


def _release_all() -> None:
    for df in list(_kept):
        path = _kept.pop(df)
        if df.sparkSession.sparkContext._jsc is not None:
            remove(df.sparkSession, path)
