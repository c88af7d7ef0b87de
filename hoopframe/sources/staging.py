"""Written intermediate tables in the cluster's shared folder.

A fact that several branches of a job read is computed once and written as parquet: the
branches then prune columns and push filters into the scan, and lost executors re-read files
instead of recomputing the join.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
PARTIAL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
FREED_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder every executor can reach")
    named = tempfile.mkdtemp(prefix="hoopframe-")
    spark.conf.set(SETTING, named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/hoopframe/{name}-{uuid.uuid4().hex}"


@contextmanager
def partial_keys(spark: SparkSession) -> Iterator[None]:
    """Within the block, sides that lie together by some of a join's keys (a game's) are joined where they are."""
    before = spark.conf.get(PARTIAL_KEYS)
    spark.conf.set(PARTIAL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(PARTIAL_KEYS, before)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within the block, a query's shuffle files go when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(FREED_SHUFFLES, "false")
    spark.conf.set(FREED_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED_SHUFFLES, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``stage`` for the block only: the folder goes when it ends."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
