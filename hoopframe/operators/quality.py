"""Data-quality checks.  Each returns violations as (check, key, detail); no rows means it passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.core import nz
from ..functions.scalars import to_long


def _found(df: DataFrame, check: str, key: Column, detail: Column | str) -> DataFrame:
    d = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), d.cast("string").alias("detail"))


def index_counts(index: DataFrame, games: DataFrame) -> DataFrame:
    """Q1: the index's count per season equals the rows stored for it."""
    n = games.groupBy("league", "season").agg(F.count(F.lit(1)).alias("n"))
    j = index.join(n, ["league", "season"], "full_outer").filter(nz("games") != nz("n"))
    return _found(j, "index_counts", F.concat_ws("/", "league", "season"),
                  F.concat(nz("games").cast("string"), F.lit(" <> "), nz("n").cast("string")))


def schedule_rows(games: DataFrame, partition: str = "partition_season") -> DataFrame:
    """Q2: rows lie in their own season, finals have scores, scheduled games none, called-off games
    none or 0."""
    has = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    whole = to_long("home_score").isNotNull() & to_long("away_score").isNotNull()
    any_score = has("home_score") | has("away_score")
    zero = lambda c: ~has(c) | F.coalesce(to_long(c) == 0, F.lit(False))
    why = (F.when(F.col("season") != F.col(partition), "other season")
           .when((F.col("status") == K.FINAL) & ~whole, "final without scores")
           .when((F.col("status") == "STATUS_SCHEDULED") & any_score, "scheduled with a score")
           .when(F.col("status").isin("STATUS_POSTPONED", "STATUS_CANCELED") & ~(zero("home_score") & zero("away_score")),
                 "called off with a score"))
    return _found(games.withColumn("_w", why).filter(F.col("_w").isNotNull()), "schedule_rows", F.col("game_id"), F.col("_w"))


def postseason_apart(regular: DataFrame, post: DataFrame) -> DataFrame:
    """Q3: no game of a league in both tables, and no postseason without a regular season."""
    both = post.join(regular.select("league", "game_id"), ["league", "game_id"], "left_semi")
    alone = post.select("league", "season").distinct().join(regular.select("league", "season"), ["league", "season"], "left_anti")
    return _found(both, "postseason_apart", F.col("game_id"), "in both tables").unionByName(
        _found(alone, "postseason_apart", F.col("season"), "no regular season"))


def boards_backed(boards: DataFrame, box: DataFrame) -> DataFrame:
    """Q4: every season with a board has at least one stored game."""
    miss = boards.select("league", "season").distinct().join(box.select("league", "season"), ["league", "season"], "left_anti")
    return _found(miss, "boards_backed", F.concat_ws("/", "league", "season"), "no stored game")


def ladder_ranks(index: DataFrame, board: DataFrame, min_gp: int = K.LADDER_MIN_GP) -> DataFrame:
    """Q5: the index repeats the ladder's ranks, ranks are unique and held by qualified careers."""
    placed = index.filter(F.col("ladder_rank").isNotNull())
    j = placed.select("league", "player_id", "ladder_rank", "gp").join(
        board.select("league", "player_id", "rank"), ["league", "player_id"], "full_outer")
    why = F.when(~F.col("ladder_rank").eqNullSafe(F.col("rank")), "rank differs").when(F.col("gp") < min_gp, "too few games")
    wrong = _found(j.withColumn("_w", why).filter(F.col("_w").isNotNull()), "ladder_ranks", F.col("player_id"), F.col("_w"))
    twice = placed.groupBy("league", "ladder_rank").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return wrong.unionByName(_found(twice, "ladder_ranks", F.col("ladder_rank"), "rank held twice"))


def snapshot_history(snapshots: DataFrame, cap: int | None = None) -> DataFrame:
    """Q6: at most ``cap`` dates (if given), ranks 1..n without gaps or repeats, fields present."""
    by = ["league", "season"]
    many = snapshots.groupBy(*by).agg(F.countDistinct("snap_date").alias("n")).filter(
        F.lit(False) if cap is None else F.col("n") > cap)
    ranks = snapshots.groupBy(*by, "snap_date", "race").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    bad = ranks.filter((F.col("d") != F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n")))
    blank = snapshots.filter(F.col("player_id").isNull() | F.col("rank").isNull() | F.col("score").isNull() | F.col("snap_date").isNull())
    return (_found(many, "snapshot_history", F.col("season"), "too many dates")
            .unionByName(_found(bad, "snapshot_history", F.concat_ws("/", "season", "snap_date", "race"), "ranks broken"))
            .unionByName(_found(blank, "snapshot_history", F.col("race"), "missing field")))


def injury_rows(injuries: DataFrame) -> DataFrame:
    """Q7: report rows name a player and a team and carry all columns."""
    need = ("player_name", "team", "status", "detail", "date")
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    out = _found(injuries.filter(blank("player_name") | blank("team")), "injury_rows",
                 F.coalesce("player_name", F.lit("?")), "no player or team")
    absent = [c for c in need if c not in injuries.columns]
    if absent:
        out = out.unionByName(_found(injuries.limit(1), "injury_rows", F.lit(",".join(absent)), "column missing"))
    return out


def no_leak(features: DataFrame, column: str = "fantasy_points_avg_last_3") -> DataFrame:
    """Q8: the first row of a career has no rolling value."""
    bad = features.filter((F.col("career_game_count") == 0) & F.col(column).isNotNull())
    return _found(bad, "no_leak", F.concat_ws("/", "player_id", "game_id"), column)


def home_agreement(rows: DataFrame) -> DataFrame:
    """Q9: box score and schedule name the same home team (``home_mismatch`` from the join)."""
    return _found(rows.filter("home_mismatch"), "home_agreement", F.concat_ws("/", "game_id", "player_id"), "home team differs")


def feature_columns(features: DataFrame, columns: Sequence[str] = K.FEATURE_COLUMNS, target: str = "fantasy_points") -> DataFrame:
    """Q10: every model input exists and the target is not one of them."""
    spark = features.sparkSession
    bad = [("feature_columns", c, "missing") for c in columns if c not in features.columns]
    bad += [("feature_columns", target, "target is an input")] if target in columns else []
    return spark.createDataFrame(bad, "check string, key string, detail string")
