"""Incremental ingestion with Structured Streaming.

All jobs are file or table streams with a checkpoint; writes go through ``foreachBatch`` and are
idempotent: a replayed micro-batch leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import constants as K
from ..operators import boards as B
from ..operators import schedule as C
from ..operators import snapshots as N
from ..sources import files as S
from ..sources.sinks import table_exists
from ..sources.staging import staged

GAME_KEY = ("league", "season", "game_id")


def valid_games(box: DataFrame) -> DataFrame:
    """Stored games with player rows of at least two teams."""
    return box.filter(F.col("team_id").isNotNull()).groupBy(*GAME_KEY).agg(
        F.countDistinct("team_id").alias("teams")).filter(F.col("teams") >= 2).select(*GAME_KEY)


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
         once: bool = True) -> StreamingQuery:
    w = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


# --- box scores -----------------------------------------------------------------------------------

def file_documents(spark: SparkSession, source: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of stored game documents, one a file (``.../{season}/games/{id}.json``)."""
    reader = (spark.readStream.schema(S.BOX_SCHEMA).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_corrupt"))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return S.with_path_fields(reader.json(source).select("*", F.col("_metadata.file_path").alias("path"),
                                                         F.col("_metadata.file_modification_time").alias("modified")))


def bundle_documents(spark: SparkSession, source: str, files_per_batch: int | None = None) -> DataFrame:
    """The same from bundles: rows of (path, modified, body), many game files in one Parquet file."""
    reader = spark.readStream.schema(S.BUNDLE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return S.parsed_bundle(reader.parquet(source))


def ingest_documents(spark: SparkSession, docs: DataFrame, table: str, rejects: str, checkpoint: str, league: str,
                     once: bool = True) -> StreamingQuery:
    """Game documents into a fact table partitioned by league and season.

    A file is taken as a whole or rejected with a reason.  A game that is already stored is
    skipped, so a file that is offered again (same game, or a replayed batch) changes nothing; a
    rejected file counts as missing and comes in once it is offered in good shape. Of several
    versions of a game in one batch the newest good one counts. Rejects are kept per micro-batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        checked = batch.withColumn("reason", S.document_problem())
        # parsed once for rows, rejects and seasons, and written: held in memory, blocks of thousands of documents don't fit
        slim = checked.select("path", "modified", "season", "file_id", F.when(F.col("reason").isNull(), F.col("players")).alias("players"), "reason")
        with staged(slim, "documents") as checked:
            good = checked.filter(F.col("reason").isNull()).drop("reason")
            stored = None
            if table_exists(spark, table):
                # prune to the seasons of the batch before looking for stored games
                seasons = [r[0] for r in good.select("season").distinct().collect()]
                # the schema is given: a table whose batches were all rejected so far has no file to tell it
                stored = spark.read.schema("game_id BIGINT, league STRING, season STRING").parquet(table).filter(
                    F.col("season").isin(seasons)).select(*GAME_KEY).distinct()
                # documents of stored games are left before they are gathered; a document may hold rows of other games
                own = F.forall("players", lambda r: r["game_id"].eqNullSafe(F.col("file_id")))
                here = stored.filter(F.col("league") == league).select(F.col("season").alias("_s"), F.col("game_id").alias("_g"))
                good = good.join(here, (F.col("season") == F.col("_s")) & (F.col("file_id") == F.col("_g")) & own, "left_anti")
            newest = good.groupBy("season", "file_id").agg(F.max_by(F.struct(*good.columns), F.struct("modified", "path")).alias("_f"))
            rows = S.player_rows(newest.select("_f.*").drop("modified"), league)
            if stored is not None:
                rows = rows.join(stored, list(GAME_KEY), "left_anti")
            rows.write.mode("append").partitionBy("league", "season").parquet(table)
            bad = checked.filter(F.col("reason").isNotNull()).select(F.lit(league).alias("league"), "path", "season", "file_id", "reason")
            bad.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(rejects)

    return _run(docs, write, checkpoint, once=once)


def ingest_box_scores(spark: SparkSession, source: str, table: str, rejects: str, checkpoint: str, league: str,
                      files_per_batch: int | None = None, once: bool = True) -> StreamingQuery:
    """``ingest_documents`` for box score files."""
    return ingest_documents(spark, file_documents(spark, source, files_per_batch), table, rejects, checkpoint, league, once)


def offered_again(spark: SparkSession, rejects: str, fact: DataFrame) -> DataFrame:
    """Rejected files whose game is still not stored: the list to fetch again."""
    kept = "league STRING, path STRING, season STRING, file_id BIGINT, reason STRING, batch_id BIGINT"
    bad = spark.read.schema(kept).parquet(rejects).select("league", F.col("file_id").alias("game_id"), "season", "path", "reason").distinct()
    stored = fact.select("league", F.col("season").cast("string").alias("season"), "game_id").distinct()
    return bad.join(stored, list(GAME_KEY), "left_anti")


# --- schedules ----------------------------------------------------------------------------------------

def upsert_batch(spark: SparkSession, table: str, fresh: DataFrame, source_order: str, failed: DataFrame) -> None:
    """One schedule pull into the stored schedule: best copy per game, a season is kept when the pull is
    empty, or smaller while calls failed.  Only the seasons of the pull are rewritten."""
    by = ["league", "season"]
    if table_exists(spark, table):
        touched = fresh.select(*by).distinct()
        stored = spark.read.parquet(table).withColumn("season", F.col("season").cast("string")).join(touched, by, "left_semi")
        out = C.upsert_schedule(stored, fresh, source_order, failed)
    else:
        out = C.best_copy(fresh, source_order).drop(source_order)
    from ..sources.staging import stage
    stage(out, "schedule").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(table)


def ingest_schedule(stream: DataFrame, table: str, checkpoint: str, source_order: str, failed: DataFrame,
                    once: bool = True) -> StreamingQuery:
    """A stream of pulled game rows into the stored schedule."""
    return _run(stream, lambda b, _: upsert_batch(b.sparkSession, table, b, source_order, failed), checkpoint, once=once)


# --- snapshots ------------------------------------------------------------------------------------------

def snapshot_batch(spark: SparkSession, table: str, arrivals: DataFrame, cap: int | None = None) -> None:
    """Arrivals of race snapshots into the stored history.

    The stored days of the touched seasons count as one earlier arrival each, then the batch rule
    decides what is kept.  Replaying a batch gives the same history.
    """
    by = ["league", "season"]
    rows = arrivals
    if table_exists(spark, table):
        touched = arrivals.select(*by).distinct()
        stored = spark.read.parquet(table).withColumn("season", F.col("season").cast("string")).join(touched, by, "left_semi")
        rows = stored.withColumn("arrival", F.lit(-1).cast(arrivals.schema["arrival"].dataType)).select(
            *arrivals.columns).unionByName(arrivals)
    from ..sources.staging import stage
    kept = stage(N.keep_changed(rows, cap), "snapshots")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(table)


def ingest_snapshots(stream: DataFrame, table: str, checkpoint: str, cap: int | None = None, once: bool = True) -> StreamingQuery:
    return _run(stream, lambda b, _: snapshot_batch(b.sparkSession, table, b, cap), checkpoint, once=once)


# --- running boards ---------------------------------------------------------------------------------------

def running_totals(stream: DataFrame, by: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Season totals kept as streaming state (update mode): only changed keys leave a micro-batch."""
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("gp"), *[F.sum(F.coalesce(s, F.lit(0))).alias(s) for s in stats])


def recompute_seasons(box: DataFrame, touched: DataFrame, parts: int | None = None) -> DataFrame:
    """Totals of the seasons that late rows touched; every other season stays as it is."""
    return B.player_totals(box.join(touched.select("league", "season").distinct(), ["league", "season"], "left_semi"), parts=parts)


def event_stream(spark: SparkSession, sf_dir: str, schema) -> DataFrame:
    """The events table as a file stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
