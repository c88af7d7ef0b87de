"""Projections for games not yet played.

Every target row sees only history of calendar days before its own day.  The look-up works on
one state per (player, day) - the state after the player's last game of that day - so a player's
ordered log here never has more rows than there are days, whatever the number of games.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..sources.staging import stage
from . import features as X
from . import logs as H


def horizon(games: DataFrame, today: str, days: int = K.PROJECTION_HORIZON_DAYS) -> DataFrame:
    """Unfinished games from today on, up to ``days`` ahead."""
    d = F.to_date("ts")
    return games.filter((F.col("status") != K.FINAL) & d.between(
        F.lit(today).cast("date"), F.date_add(F.lit(today).cast("date"), days)))


def only_games(games: DataFrame, ids: DataFrame) -> DataFrame:
    """Keep the games listed by league and id."""
    return games.join(ids.select("league", "game_id"), ["league", "game_id"], "left_semi")


def drop_null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows without a date (or whatever must be known)."""
    for c in cols:
        df = df.filter(F.col(c).isNotNull())
    return df


def placeholders(upcoming: DataFrame, roster: DataFrame) -> DataFrame:
    """One row per upcoming dated game and rostered player of either side."""
    side = lambda own, opp: F.struct(F.col(f"{own}_id").alias("team_id"),
                                     F.col(f"{opp}_id").alias("opponent_id"),
                                     F.lit(own == "home").alias("is_home"))
    teams = drop_null_rows(upcoming, ["ts"]).select(
        "league", "season", "season_start", "game_id", "ts",
        F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s"),
    ).select("league", "season", "season_start", "game_id", "ts", "s.*")
    return teams.join(roster.select("league", "team_id", "player_id", "position"), ["league", "team_id"])


def asof_day(states: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per distinct (key, day) of ``targets`` the last ``state`` of an earlier day.

    ``states`` has one row per (key, day).  Targets sort before states of their day, so the
    same day is never seen; a state is one struct, so null fields inside it are kept.
    """
    wanted = targets.select(*keys, "day").distinct().withColumn(
        "state", F.lit(None).cast(states.schema["state"].dataType)).withColumn("_kind", F.lit(0))
    log = states.select(*keys, "day", "state").withColumn("_kind", F.lit(1)).unionByName(wanted)
    w = Window.partitionBy(*keys).orderBy("day", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("state", F.last("state", ignorenulls=True).over(w)).filter(
        F.col("_kind") == 0).drop("_kind")


def player_states(history: DataFrame, stats: Sequence[str] = K.ROLLING_STATS,
                  windows: Sequence[int] = K.ROLLING_WINDOWS, parts: int | None = None) -> DataFrame:
    """State after the last game of each (player, day): inclusive form, counts, last game."""
    log = H.open_log(history, X.PLAYER, X.ORDER, max([*windows, 5]) - 1, parts=parts)
    w = Window.partitionBy(*log.keys).orderBy(*X.ORDER)
    in_season = Window.partitionBy(*log.keys, "season_start").orderBy("ts", "game_id")
    upto = (Window.unboundedPreceding, 0)
    form = [(f"{s}_avg_last_{n}", F.avg(s).over(w.rowsBetween(-n + 1, 0))) for n in windows for s in stats]
    rows = log.finish(log.rows.withColumn("day", F.to_date("ts")).select(
        "*", *[c.alias(n) for n, c in form],
        F.count(log.own()).over(w.rowsBetween(*upto)).alias("career"),
        F.count(log.own()).over(in_season.rowsBetween(*upto)).alias("in_season"),
        F.sum(X._played_flag()).over(w.rowsBetween(-4, 0)).alias("games_played_last_5"),
        F.lead("day").over(w).alias("_next")), "career", "in_season", ("_next", F.to_date("_next_first.ts")))
    state = F.struct(*[F.col(n) for n, _ in form], "career", "in_season", "season",
                     F.col("min").alias("last_min"), F.col("ts").alias("last_ts"), "games_played_last_5")
    return last_of_day(rows).select(*X.PLAYER, "day", state.alias("state"))


def last_of_day(rows: DataFrame) -> DataFrame:
    """Keep the last row of each day: the next row of the same sort has another day."""
    return rows.filter(F.col("_next").isNull() | (F.col("_next") != F.col("day"))).drop("_next")


def team_states(team_games: DataFrame, window: int = 5, parts: int | None = None) -> DataFrame:
    """Form of a team after its last game of each day."""
    log = H.open_log(team_games, X.TEAM, X.ORDER, max(window - 1, 1), parts=parts)
    w = Window.partitionBy(*log.keys).orderBy(*X.ORDER)
    f = w.rowsBetween(-window + 1, 0)
    rows = log.finish(log.rows.withColumn("day", F.to_date("ts")).select(
        *log.rows.columns, "day", F.avg("team_score").over(f).alias("pf"),
        F.avg("opp_score").over(f).alias("pa"), F.lead("day").over(w).alias("_next")), next_first=("_next", F.to_date("_next_first.ts")))
    return last_of_day(rows).select(*X.TEAM, "day", F.struct("pf", "pa").alias("state"))


def baseline_states(history: DataFrame, score: str = "fantasy_points") -> DataFrame:
    """League baseline including each day."""
    w = Window.partitionBy("league").orderBy("season_start", "slot").rowsBetween(
        Window.unboundedPreceding, 0)
    days = X.daily_means(history, score, "day").select(
        "league", "season_start", F.col("slot").alias("day"), F.struct(F.avg("day_mean").over(w).alias("v")).alias("state"))
    return days.groupBy("league", "day").agg(F.max_by("state", "season_start").alias("state"))


def projection_rows(history: DataFrame, upcoming: DataFrame, roster: DataFrame,
                    stats: Sequence[str] = K.ROLLING_STATS,
                    windows: Sequence[int] = K.ROLLING_WINDOWS) -> DataFrame:
    """Feature-ready rows for every upcoming (game, player)."""
    rows = stage(placeholders(upcoming, roster).withColumn("day", F.to_date("ts")), "placeholders")  # read by five branches
    ps = asof_day(player_states(history, stats, windows), rows, list(X.PLAYER)).withColumnRenamed("state", "p")
    good, _ = X.team_game_table(history)
    teams = rows.select("league", "team_id", "day").unionByName(
        rows.select("league", F.col("opponent_id").alias("team_id"), "day"))
    ts = asof_day(team_states(good), teams, list(X.TEAM))
    bs = asof_day(baseline_states(history), rows, ["league"]).withColumnRenamed("state", "b")
    out = (rows.join(ps, [*X.PLAYER, "day"], "left")
           .join(ts.withColumnRenamed("state", "t"), [*X.TEAM, "day"], "left")
           .join(ts.withColumnsRenamed({"team_id": "opponent_id", "state": "o"}),
                 ["league", "opponent_id", "day"], "left")
           .join(F.broadcast(bs), ["league", "day"], "left"))  # one row per league and day
    rest, b2b = X.rest_from(F.unix_timestamp("ts") - F.unix_timestamp("p.last_ts"))
    return out.select(
        "league", "season", "season_start", "game_id", "ts", "player_id", "team_id", "opponent_id",
        "is_home", "position",
        *[F.col(f"p.{s}_avg_last_{n}").alias(f"{s}_avg_last_{n}") for n in windows for s in stats],
        F.coalesce("p.career", F.lit(0)).alias("career_game_count"),
        F.when(F.col("p.season") == F.col("season"), F.col("p.in_season")).otherwise(0).alias("season_game_count"),
        F.col("p.last_min").alias("minutes_last_game"),
        F.when(F.coalesce("p.last_min", F.lit(0)) > 0, 1).otherwise(0).alias("played_last_game"),
        F.col("p.games_played_last_5").alias("games_played_last_5"),
        rest.alias("rest_days"), b2b.alias("back_to_back"),
        F.col("t.pf").alias("team_form_pf"), F.col("t.pa").alias("team_form_pa"),
        F.col("o.pa").alias("opp_form_pa"), F.col("o.pf").alias("opp_form_pf"),
        F.col("b.v").alias("new_player_baseline"))


PROJECTION_COLUMNS = ("game_id", "ts", "season", "player_id", "team_id", "opponent_id", "is_home",
                      "position", "projected_points")


def project_upcoming(history: DataFrame, games: DataFrame, roster: DataFrame, score,
                     ids: DataFrame | None = None) -> DataFrame:
    """Projections of unfinished games, earliest and highest first.

    ``score(rows)`` adds ``projected_points``: a fitted model (``models.predict_points``) or
    the naive rule.
    """
    upcoming = games.filter(F.col("status") != K.FINAL)
    if ids is not None:
        upcoming = only_games(upcoming, ids)
    out = score(projection_rows(history, upcoming, roster))
    return out.select("league", *PROJECTION_COLUMNS).orderBy(
        "ts", F.desc("projected_points"), "game_id", "player_id")


def naive_score(rows: DataFrame) -> DataFrame:
    return X.naive_projection(rows, "projected_points")
