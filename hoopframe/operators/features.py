"""Leak-free features per player-game: every value uses earlier rows only.

Order of a log is (season_start, ts, game_id).  Player and team windows run through
``logs.open_log``; one sort serves all columns of a pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scoring as S
from ..functions.core import half_up, nz, ratio
from ..sources.staging import stage
from . import logs as H

PLAYER = ("league", "player_id")
TEAM = ("league", "team_id")
ORDER = ("season_start", "ts", "game_id")


# --- joins that build the fact ----------------------------------------------------------

def with_scores(box: DataFrame, games: DataFrame) -> DataFrame:
    """Team and opponent score from the schedule.

    The home team is rebuilt from the row; where it disagrees with the schedule both scores
    are null (``home_mismatch`` marks the row).
    """
    sched = games.select("league", "season", "game_id", F.col("home_id").alias("_home"),
                         F.col("home_score").cast("double").alias("_hs"),
                         F.col("away_score").cast("double").alias("_as"))
    box_home = F.when(F.col("is_home"), F.col("team_id")).otherwise(F.col("opponent_id"))
    j = box.join(sched, ["league", "season", "game_id"], "left").withColumn(
        "home_mismatch", F.coalesce(F.col("_home") != box_home, F.lit(False)))
    own = F.when(F.col("is_home"), F.col("_hs")).otherwise(F.col("_as"))
    opp = F.when(F.col("is_home"), F.col("_as")).otherwise(F.col("_hs"))
    ok = ~F.col("home_mismatch")
    return j.withColumn("team_score", F.when(ok, own)).withColumn(
        "opp_score", F.when(ok, opp)).drop("_home", "_hs", "_as")


def with_positions(rows: DataFrame, positions: DataFrame | None) -> DataFrame:
    """Current position and team; 'UNK' and null without an entry."""
    if positions is None:
        return rows.withColumn("position", F.lit("UNK")).withColumn(
            "current_team_id", F.lit(None).cast("bigint"))
    p = positions.select("league", "player_id", "position", F.col("team_id").alias("current_team_id"))
    return rows.join(p, ["league", "player_id"], "left").withColumn(
        "position", F.coalesce("position", F.lit("UNK")))


def player_games(box: DataFrame, games: DataFrame, positions: DataFrame | None = None,
                 weights: dict[str, float] | None = None) -> DataFrame:
    """The training fact: scores, positions, target and ``played`` (min > 0)."""
    df = S.fantasy_points(with_positions(with_scores(box, games), positions), weights)
    return df.withColumn("played", (F.coalesce("min", F.lit(0)) > 0).cast("int"))


# --- player windows -----------------------------------------------------------------------

def rest_from(gap_seconds: Column) -> tuple[Column, Column]:
    """(rest_days, back_to_back) from the seconds since the previous game: whole 24-hour
    periods minus one, not below 0."""
    days = F.floor(gap_seconds / 86400)
    return F.when(days.isNotNull(), F.greatest(days - 1, F.lit(0))), F.coalesce((days == 1).cast("int"), F.lit(0))


def player_form(rows: DataFrame, stats: Sequence[str] = K.ROLLING_STATS,
                windows: Sequence[int] = K.ROLLING_WINDOWS, parts: int | None = None) -> DataFrame:
    """Rolling form, game counts and availability of a player before each game.

    All windows share one sort (league, player, block, season, time, game).
    """
    log = H.open_log(rows, PLAYER, ORDER, max([*windows, 5]), parts=parts)
    w = Window.partitionBy(*log.keys).orderBy(*ORDER)
    in_season = Window.partitionBy(*log.keys, "season_start").orderBy("ts", "game_id")
    before = (Window.unboundedPreceding, -1)
    prev_min = F.lag("min").over(w)
    rest, b2b = rest_from(F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w)))
    out = log.rows.select(
        "*",
        *[F.avg(s).over(w.rowsBetween(-n, -1)).alias(f"{s}_avg_last_{n}")
          for n in windows for s in stats],
        F.count(log.own()).over(w.rowsBetween(*before)).alias("career_game_count"),
        F.count(log.own()).over(in_season.rowsBetween(*before)).alias("season_game_count"),
        prev_min.alias("minutes_last_game"),
        F.when(F.coalesce(prev_min, F.lit(0)) > 0, 1).otherwise(0).alias("played_last_game"),
        F.sum(_played_flag()).over(w.rowsBetween(-5, -1)).alias("games_played_last_5"),
        rest.alias("rest_days"), b2b.alias("back_to_back"))
    return log.finish(out, "career_game_count", "season_game_count")


def _played_flag() -> Column:
    """1/0 for minutes over 0, null where minutes are unknown."""
    return F.when(F.col("min").isNotNull(), (F.col("min") > 0).cast("double"))


# --- team windows ---------------------------------------------------------------------------

def team_game_table(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(team-games, contradictions): one row per team and game; a key whose player rows
    disagree on date, side or scores is dropped whole and returned in the second table.

    One hash aggregation: a field agrees when its smallest and largest value are equal and it is
    null in all rows or in none.
    """
    keys = ["league", "season", "season_start", "game_id", "team_id"]
    fields = ("ts", "is_home", "team_score", "opp_score")
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[a for f in fields for a in (F.min(f).alias(f), F.max(f).alias(f"_max_{f}"), F.count(f).alias(f"_n_{f}"))])
    same = F.lit(True)
    for f in fields:
        same = same & ((F.col(f"_n_{f}") == 0) | (
            (F.col(f"_n_{f}") == F.col("_n")) & (F.col(f) == F.col(f"_max_{f}"))))
    return agg.filter(same).select(*keys, *fields), agg.filter(~same).select(*keys)


def team_form(team_games: DataFrame, window: int = 5, parts: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Average score made and allowed over a team's last ``window`` games before each game; ``keep`` names columns besides the key."""
    log = H.open_log(stage(team_games, "team-games"), TEAM, ORDER, window, parts=parts)  # counted first, then read
    f = Window.partitionBy(*log.keys).orderBy(*ORDER).rowsBetween(-window, -1)
    out = log.finish(log.rows.select("*", F.avg("team_score").over(f).alias("form_pf"),
                                     F.avg("opp_score").over(f).alias("form_pa")))
    return out.select("league", "season", "game_id", "team_id", "form_pf", "form_pa", *keep)


def with_team_form(rows: DataFrame, window: int = 5) -> DataFrame:
    """Own and opponent form joined onto player rows."""
    good, _ = team_game_table(rows)
    return join_team_form(rows, team_form(good, window))


def join_team_form(rows: DataFrame, form: DataFrame) -> DataFrame:
    """Own and opponent form on rows; with ``season_start`` in ``form`` it must agree too, so that no row comes twice.

    Both forms are met by the few keys of a game's sides first, so the rows themselves are moved once.
    """
    same = ["league", "season", "game_id"]
    sides = rows.select(*same, "season_start", "team_id", "opponent_id").distinct()
    for id_, name in (("team_id", "team"), ("opponent_id", "opp")):
        side = form.withColumnsRenamed({"form_pf": f"{name}_form_pf", "form_pa": f"{name}_form_pa",
                                        **{c: f"_of_{c}" for c in (*same, "season_start", "team_id")}})
        meets = F.col(id_) == F.col("_of_team_id")
        for c in same:
            meets = meets & (F.col(c) == F.col(f"_of_{c}"))
        if "season_start" in form.columns:
            meets = meets & F.col("season_start").eqNullSafe(F.col("_of_season_start"))
        sides = sides.join(side, meets, "left").drop(*[c for c in side.columns if c.startswith("_of_")])
    return H.join_on(rows, sides, [*same, "season_start", "team_id", "opponent_id"], "left")


# --- new-player baseline ----------------------------------------------------------------------

def grain_key(grain: str) -> Column:
    """'day' groups calendar days, 'instant' groups equal tip-off times."""
    if grain not in ("day", "instant"):
        raise ValueError(f"grain must be 'day' or 'instant', not {grain!r}")
    return F.to_date("ts") if grain == "day" else F.col("ts")


def daily_means(rows: DataFrame, score: str = "fantasy_points", grain: str = "day") -> DataFrame:
    """Mean score per league, season and day."""
    return rows.groupBy("league", "season", "season_start", grain_key(grain).alias("slot")).agg(
        F.avg(score).alias("day_mean"))


def baseline(rows: DataFrame, score: str = "fantasy_points", grain: str = "day") -> DataFrame:
    """Mean of all earlier slot means per league.

    The league-wide order runs over a day table only (at most 366 rows per year).  Instants add a
    second level: a running sum inside each day on top of the prefix over days, so no task ever
    holds all instants of a league.
    """
    slots = daily_means(rows, score, grain)
    before = (Window.unboundedPreceding, -1)
    if grain == "day":
        w = Window.partitionBy("league").orderBy("season_start", "slot").rowsBetween(*before)
        return slots.select("league", "season", "slot", F.avg("day_mean").over(w).alias("new_player_baseline"))
    keys = ["league", "season_start", "_day"]
    slots = slots.withColumn("_day", F.to_date("slot"))
    inner = Window.partitionBy(*keys).orderBy("slot").rowsBetween(*before)
    outer = Window.partitionBy("league").orderBy("season_start", "_day").rowsBetween(*before)
    days = slots.groupBy(*keys).agg(F.sum("day_mean").alias("_s"), F.count("day_mean").alias("_n")).select(
        *keys, F.sum("_s").over(outer).alias("_s0"), F.sum("_n").over(outer).alias("_n0"))
    out = slots.withColumn("_s1", F.sum("day_mean").over(inner)).withColumn(
        "_n1", F.count("day_mean").over(inner)).join(F.broadcast(days), keys, "left")
    return out.select("league", "season", "slot", ratio(
        nz("_s0") + nz("_s1"), nz("_n0") + nz("_n1")).alias("new_player_baseline"))


def with_baseline(rows: DataFrame, score: str = "fantasy_points", grain: str = "day") -> DataFrame:
    """Baseline joined onto player rows."""
    return join_baseline(rows, baseline(rows, score, grain), grain)


def join_baseline(rows: DataFrame, b: DataFrame, grain: str) -> DataFrame:
    """A day table has at most 366 rows per league and year, which is the bound for broadcasting
    it; the instant grain has none and is left to Spark."""
    b = F.broadcast(b) if grain == "day" else b
    return rows.withColumn("slot", grain_key(grain)).join(
        b, ["league", "season", "slot"], "left").drop("slot")


# --- everything ------------------------------------------------------------------------------

def feature_table(rows: DataFrame, grain: str = "day") -> DataFrame:
    """All features on the fact from ``player_games``."""
    good, _ = team_game_table(rows)
    days = baseline(rows, grain=grain)
    # the rows meet their teams before the many columns of the player's form are added
    out = player_form(join_team_form(rows, team_form(good, keep=("season_start",))))
    return join_baseline(out, days, grain)


def model_inputs(features: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Exactly the model's input columns (plus named extras)."""
    return features.select(*extra, *K.FEATURE_COLUMNS)


def naive_projection(features: DataFrame, name: str = "naive") -> DataFrame:
    """The last-5 average, 0 without history, never negative."""
    return features.withColumn(name, F.greatest(
        F.coalesce("fantasy_points_avg_last_5", F.lit(0.0)), F.lit(0.0)))


def regression_metrics(df: DataFrame, label: str, prediction: str,
                       by: Sequence[str] = ()) -> DataFrame:
    """MAE and RMSE over all, played and not-played rows, in one aggregation."""
    err = F.col(prediction) - F.col(label)
    cols = []
    for name, cond in (("", F.lit(True)), ("played_", F.col("played") == 1),
                       ("dnp_", F.col("played") == 0)):
        cols += [F.count_if(cond).alias(f"{name}n"),
                 half_up(F.avg(F.when(cond, F.abs(err))), 6).alias(f"{name}mae"),
                 half_up(F.sqrt(F.avg(F.when(cond, err * err))), 6).alias(f"{name}rmse")]
    return df.groupBy(*by).agg(*cols)
