"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; only a local session may make its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docmerge-checkpoint-")
    context.setCheckpointDir(folder)


@contextmanager
def with_setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for what runs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def few_tasks(scan: DataFrame, splits: int = 16) -> DataFrame:
    """A scan in fewer tasks, without a shuffle: Spark puts some thirty small files into a split and sends each split's figures to the driver.

    ``splits`` of them go to a task where there are many; a task still reads one file after the other, so its memory stays as it was.
    """
    found, least = scan.rdd.getNumPartitions(), 4 * scan.sparkSession.sparkContext.defaultParallelism
    return scan if found <= least else scan.coalesce(max(least, found // splits))


def with_freed_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """For steps whose result is stored: what they shuffle goes when they end. Frames made inside should not run again, they would shuffle once more."""
    return with_setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` stored once on shared storage, so that later steps do not recompute it; what was shuffled for it goes as soon as it is stored."""
    ensure_checkpoint_dir(df.sparkSession)
    with with_freed_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # of its own, since ``df`` may run again


def stored(df: DataFrame, path: str) -> DataFrame:
    """As ``checkpointed``, in compressed columns: for rows that are many and alike."""
    with with_freed_shuffles(df.sparkSession):
        df.select("*").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
