"""Writing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.schedule import changed_keys, same_content

PARTITIONS = ("league", "season")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored under a path (any file system Spark can reach)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def write_fact(df: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS) -> None:
    """Fact or feature table partitioned by league and season.

    Rows are spread over several writers per partition value only when they have to be: adaptive
    execution splits oversized shuffle partitions of this rebalance, so a huge season does not
    land in one task.
    """
    df.hint("rebalance", *partitions).write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_changed_seasons(df: DataFrame, path: str, keys: Sequence[str] = PARTITIONS) -> DataFrame:
    """Rewrite only the seasons whose content moved; stored seasons absent from ``df`` stay, and an
    empty season never replaces a stored one.  Returns the keys that were written."""
    spark = df.sparkSession
    if not table_exists(spark, path):
        write_fact(df, path, keys)
        return df.select(*keys).distinct()
    stored = spark.read.parquet(path)
    old = stored.select(*[F.col(f.name).cast(f.dataType) for f in df.schema.fields])
    moved = [tuple(r) for r in changed_keys(old, df, keys).collect()]  # one short row per season
    listed = spark.createDataFrame(moved, df.select(*keys).schema)
    if moved:
        (df.join(F.broadcast(listed), list(keys), "left_semi").hint("rebalance", *keys).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))
    return listed


def write_if_changed(df: DataFrame, path: str, ignore: Sequence[str] = K.STAMP_COLUMNS) -> bool:
    """Write unless the stored rows are the same, stamp columns aside.  Answers whether it wrote."""
    spark = df.sparkSession
    if table_exists(spark, path) and same_content(spark.read.parquet(path), df, ignore):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def stamp(df: DataFrame, source: str, now: str) -> DataFrame:
    """Add the stamp columns ``_generated_utc`` and ``source``."""
    return df.withColumn("_generated_utc", F.lit(now)).withColumn("source", F.lit(source))


def export_csv(df: DataFrame, path: str, columns: Mapping[str, str]) -> None:
    """CSV with renamed columns; columns the table does not have are left out."""
    have = [F.col(c).alias(n) for c, n in columns.items() if c in df.columns]
    df.select(*have).write.mode("overwrite").option("header", True).csv(path)


def save_model(model, metrics: DataFrame, path: str) -> None:
    """Model and the run's metrics row."""
    model.write().overwrite().save(f"{path}/model")
    metrics.write.mode("append").json(f"{path}/metrics")
