"""Daily ranking snapshots: what is kept, how ranks moved, who leads over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.core import ranked
from ..functions.seasons import current_season_label, season_label
from .schedule import content_hash

KEY = ("league", "season")
ROW = ("race", "rank", "player_id", "player_name", "score")


def snapshot_rows(races: DataFrame, top: int = K.SNAPSHOT_TOP) -> DataFrame:
    """The part of a race table that a snapshot stores."""
    return races.filter(F.col("rank") <= top).select(*KEY, *ROW)


def keep_changed(arrivals: DataFrame, cap: int | None = None) -> DataFrame:
    """Snapshots that are stored, from all arrivals (league, season, snap_date, arrival, race rows).

    A day is stored when any of its arrivals differs from the last content before that day, and
    holds the day's last arrival; with a ``cap`` only the newest days stay.  This is the fold "skip when
    equal to the last kept, replace on the same day, else append": the last kept content always
    equals the last arrival's.
    """
    day = [*KEY, "snap_date"]
    one = [*day, "arrival"]
    content = content_hash(arrivals.select(*one, *ROW), one, ignore=one).withColumnRenamed("hash", "h")
    last = content.groupBy(*day).agg(F.max_by(F.struct("h", "n"), "arrival").alias("last"), F.max("arrival").alias("arrival"))
    w = Window.partitionBy(*KEY).orderBy("snap_date")
    before = last.withColumn("prev", F.lag("last").over(w)).select(*day, F.col("arrival").alias("_last"), "prev")
    differs = F.col("prev").isNull() | ~(F.struct("h", "n").eqNullSafe(F.struct("prev.h", "prev.n")))
    kept = content.join(before, day).groupBy(*day).agg(
        F.bool_or(differs).alias("keep"), F.max("_last").alias("arrival")).filter("keep")
    if cap is not None:
        kept = ranked(kept, KEY, [F.desc("snap_date")], cap, "_n")
    return arrivals.join(kept.select(*day, "arrival"), [*day, "arrival"], "left_semi").drop("arrival")


def last_two(snapshots: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Rows of the two newest snapshot dates, ``age`` 1 is the newest."""
    w = Window.partitionBy(*by).orderBy(F.desc("snap_date"))
    dates = snapshots.select(*by, "snap_date").distinct().withColumn("age", F.row_number().over(w)).filter(F.col("age") <= 2)
    return snapshots.join(dates, [*by, "snap_date"])


def race_movement(snapshots: DataFrame) -> DataFrame:
    """Climb (+) or fall (-) between the two newest snapshots; new entrants have no row."""
    two = last_two(snapshots)
    agg = two.groupBy(*KEY, "race", "player_id").agg(
        F.max(F.when(F.col("age") == 2, F.col("rank"))).alias("before"),
        F.max(F.when(F.col("age") == 1, F.col("rank"))).alias("now"))
    return agg.filter(F.col("before").isNotNull() & F.col("now").isNotNull()).select(
        *KEY, "race", "player_id", (F.col("before") - F.col("now")).alias("delta"))


def race_trend(snapshots: DataFrame, top: int = K.TREND_TOP) -> DataFrame:
    """Score per snapshot date of the newest snapshot's leaders, null where absent; needs two dates."""
    by = [*KEY, "race"]
    dates = snapshots.select(*by, "snap_date").distinct()
    span = dates.groupBy(*by).agg(F.max("snap_date").alias("_newest"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    lead = snapshots.filter(F.col("rank") <= top).join(
        span.select(*by, F.col("_newest").alias("snap_date")), [*by, "snap_date"], "left_semi").select(
        *by, "player_id", "player_name", F.col("rank").alias("latest_rank"))
    spine = dates.join(lead, by)
    return spine.join(snapshots.select(*by, "snap_date", "player_id", "score"), [*by, "snap_date", "player_id"], "left")


def official_vs_top(races: DataFrame, official: DataFrame) -> DataFrame:
    """Race leader against the official winners by name: agree, differs, or null while either is missing.

    ``official`` is (league, season, race, player_name), several winners allowed; all of them are listed.
    """
    by = [*KEY, "race"]
    top = races.filter(F.col("rank") == 1).select(*by, F.col("player_name").alias("top"))
    won = official.filter(F.coalesce(F.col("player_name") != "", F.lit(False)))
    j = won.join(top, by, "full_outer").groupBy(*by).agg(
        F.max("top").alias("top"), F.nullif(F.concat_ws(", ", F.array_sort(F.collect_set("player_name"))), F.lit("")).alias("official"),
        F.bool_or(F.col("player_name") == F.col("top")).alias("_hit"))
    return j.withColumn("verdict", F.when(F.col("top").isNull() | F.col("official").isNull(), F.lit(None)).when(
        F.coalesce("_hit", F.lit(False)), "agree").otherwise("differs")).drop("_hit")


def finals_tracker(winners: DataFrame, champions: DataFrame, today: str, names: DataFrame | None = None) -> DataFrame:
    """Finals winners with season label and team; the current season rides along as pending."""
    team = champions.select("league", "year", "team_id")
    rows = winners.select("league", "year", "player_id").join(team, ["league", "year"], "left").select(
        "league", season_label("year", F.col("league")).alias("season"), "player_id", "team_id", F.lit(False).alias("pending"))
    if names is not None:
        rows = rows.join(names.select("league", "player_id", "player_name"), ["league", "player_id"], "left")
    now = winners.select("league").distinct().select(
        "league", current_season_label(F.lit(today).cast("date"), F.col("league")).alias("season"))
    pending = now.join(rows.select("league", "season"), ["league", "season"], "left_anti").withColumn("pending", F.lit(True))
    return rows.unionByName(pending, allowMissingColumns=True)


def other_seasons(tracker: DataFrame, season: str, size: int | None = K.FINALS_TRACKER_SIZE) -> DataFrame:
    """Newest tracker rows of each league apart from the selected season."""
    order = [F.desc("season"), F.desc("pending"), F.asc("player_id")]
    rest = tracker.filter(F.col("season") != season)
    rest = rest if size is None else ranked(rest, ["league"], order, size, "_n").drop("_n")
    return rest.orderBy("league", *order)


def best_profiles(board: DataFrame, size: int | None = 4) -> DataFrame:
    """The best ladder ranks of each league, the default profile selection."""
    known = board.filter(F.col("rank").isNotNull())
    known = known if size is None else ranked(known, ["league"], [F.asc("rank"), F.asc("player_id")], size, "_n").drop("_n")
    return known.orderBy("league", "rank", "player_id")
