"""Season aggregates and ranked boards over the player-game table.

All functions work on every league and season at once; ``BY`` is the grouping.
Expected columns: league, season, season_start, game_id, player_id, player_name,
team_abbrev, starter, did_not_play, min and the box score stats.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scoring as S
from ..functions.core import board_order, half_up, nz, ranked, ratio, text_order
from ..functions.scalars import local_date, to_long
from .ordering import quantiles

BY = ("league", "season", "season_start")


# --- filters -----------------------------------------------------------------------

def appeared(box: DataFrame) -> DataFrame:
    """Drop did-not-play rows (the boards' notion of an appearance)."""
    return box.filter(~F.coalesce(F.col("did_not_play"), F.lit(False)))


def final_games(games: DataFrame) -> DataFrame:
    """Finished games with two readable scores, scores as whole numbers."""
    return (games.filter(F.col("status") == K.FINAL)
            .withColumn("home_score", to_long("home_score"))
            .withColumn("away_score", to_long("away_score"))
            .filter(F.col("home_score").isNotNull() & F.col("away_score").isNotNull()))


def qualified(totals: DataFrame, bars: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Players at or over their season's games-played bar (1 where no bar is known)."""
    keys = list(by)
    return (totals.join(bars.select(*keys, "min_gp"), keys, "left")
            .withColumn("min_gp", F.coalesce("min_gp", F.lit(1)))
            .filter(F.col("gp") >= F.col("min_gp")))


def bench_only(totals: DataFrame, most: float = K.BENCH_MAX_START_SHARE) -> DataFrame:
    """Started at most 40 % of the games played."""
    return totals.filter(F.coalesce(ratio("starts", "gp"), F.lit(1.0)) <= F.lit(most))


def attempt_floor(category: str) -> Column:
    """Enough attempts per game for an efficiency board."""
    column, floor = K.ATTEMPT_FLOORS[category]
    return F.coalesce(ratio(nz(column), "gp") >= F.lit(floor), F.lit(False))


# --- aggregates ------------------------------------------------------------------------

def player_totals(box: DataFrame, by: Sequence[str] = BY,
                  stats: Sequence[str] = K.SEASON_STATS, first_team: bool = False, parts: int | None = None) -> DataFrame:
    """gp, starts, minutes, summed stats, first-seen name and primary team per player.

    Two aggregations: per (player, name, team), then per player, so that the team with most
    appearances (tie: met first in game-id text order) needs no second scan.  The first one
    carries numbers only, which keeps it a hash aggregate with map-side partial sums.
    ``first_team`` names the team of the first appearance instead. Both later steps share one exchange;
    ``parts`` says over how many tasks (names can't be picked in a hash aggregate, so rows are sorted there).
    """
    per_team = appeared(box).groupBy(*by, "player_id", "player_name", "team_abbrev").agg(
        F.count(F.lit(1)).alias("gp"),
        F.sum(F.when(F.col("starter"), 1).otherwise(0)).alias("starts"),
        F.sum(nz("min")).alias("minutes"),
        F.min(text_order("game_id")).alias("_seen"),
        *[F.sum(nz(s)).alias(s) for s in stats])
    # a league that is one constant is folded away in the aggregates' keys, and rows dealt by it would move again
    held = per_team.repartition(*([parts] if parts else []), *[c for c in by if c != "league"], "player_id")
    teams = held.groupBy(*by, "player_id", "team_abbrev").agg(
        F.min_by("player_name", "_seen").alias("player_name"), F.min("_seen").alias("_seen"),
        *[F.sum(c).alias(c) for c in ("gp", "starts", "minutes", *stats)])
    named = F.coalesce(F.col("team_abbrev") != "", F.lit(False))
    return teams.groupBy(*by, "player_id").agg(
        F.min_by("player_name", "_seen").alias("player_name"),
        F.min_by("team_abbrev", F.col("_seen") if first_team else F.when(named, F.struct(-F.col("gp"), "_seen"))).alias("team_abbrev"),
        *[F.sum(c).alias(c) for c in ("gp", "starts", "minutes", *stats)])


def team_sides(games: DataFrame, keep: Sequence[str] = BY) -> DataFrame:
    """Two rows per game, one per team, in one pass over the games."""
    side = lambda own, opp: F.struct(
        F.col(f"{own}_id").alias("team_id"), F.col(f"{own}_abbrev").alias("team_abbrev"),
        F.col(f"{own}_score").alias("scored"), F.col(f"{opp}_score").alias("allowed"),
        F.col(f"{opp}_id").alias("opponent_id"), F.lit(own == "home").alias("is_home"))
    return games.select(*keep, "game_id", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")
                        ).select(*keep, "game_id", "s.*")


def team_records(games: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Wins, losses, points and rates per team from finished games; a draw goes to the away side."""
    won = F.when(F.col("is_home"), F.col("scored") > F.col("allowed")).otherwise(
        F.col("scored") >= F.col("allowed"))
    agg = team_sides(final_games(games), by).groupBy(*by, "team_abbrev").agg(
        F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"),
        F.sum("scored").alias("points_for"), F.sum("allowed").alias("points_allowed"),
        F.count(F.lit(1)).alias("games"))
    return agg.select("*", half_up(ratio("wins", "games"), 3).alias("win_pct"),
                      half_up(ratio("points_allowed", "games"), 1).alias("opp_pg"))


def series_results(games: DataFrame, by: Sequence[str]) -> DataFrame:
    """Series standings; a missing side or a score of 0 is no result, a draw is lost by both."""
    played = played_games(games).filter(
        (F.coalesce("home_abbrev", F.lit("")) != "") & (F.coalesce("away_abbrev", F.lit("")) != ""))
    won = F.col("scored") > F.col("allowed")
    agg = team_sides(played, by).groupBy(*by, "team_abbrev").agg(
        F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"),
        F.count(F.lit(1)).alias("games"))
    return agg.withColumn("win_pct", half_up(ratio("wins", "games"), 3))


def played_games(games: DataFrame) -> DataFrame:
    """Games of a series with two scores other than 0."""
    return (games.withColumn("home_score", to_long("home_score"))
            .withColumn("away_score", to_long("away_score"))
            .filter((F.col("home_score") != 0) & (F.col("away_score") != 0)))


def in_season_bar(games: Column) -> Column:
    """Half the games, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.floor((games + 1) / 2))


def season_bar(games: Column) -> Column:
    """Half the busiest team's games; rounded up while that is under 8."""
    return F.greatest(F.lit(1), F.least(F.lit(8), in_season_bar(games)), F.floor(games / 2))


def qualifiers(records: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Busiest team and games-played bar per season."""
    return records.groupBy(*by).agg(F.max("games").alias("max_games")).withColumn(
        "min_gp", season_bar(F.col("max_games")))


def season_leaderboard(box: DataFrame, weights: Mapping[str, float] | None = None,
                       by: Sequence[str] = BY, parts: int | None = None) -> DataFrame:
    """Totals, fantasy score and efficiencies per player, best first per season."""
    out = S.fantasy_points(player_totals(box, by, K.CAREER_STATS, first_team=True, parts=parts), weights)
    out = out.select("*", *[c.alias(n) for n, c in S.efficiency().items()])
    return out.orderBy(*by, F.desc("fantasy_points"), "player_id")


def first_season_with_rows(df: DataFrame, order: DataFrame, by: Sequence[str] = ("league",)) -> DataFrame:
    """Rows of the first season in a try-order (league, season, priority) that has any."""
    have = df.select(*by, "season").distinct().join(order, [*by, "season"])
    pick = have.groupBy(*by).agg(F.min_by("season", "priority").alias("season"))
    return df.join(pick, [*by, "season"], "left_semi")


# --- races ----------------------------------------------------------------------------

RATES = {"ppg": "pts", "rpg": "reb", "apg": "ast"}


def _rates() -> list[Column]:
    return [S.per_game(stat).alias(name) for name, stat in RATES.items()]


def mvp(totals: DataFrame, records: DataFrame, bars: DataFrame, size: int | None = K.RACE_SIZE,
        by: Sequence[str] = BY) -> DataFrame:
    """Game score per game times 0.6 + 0.4 of the team's win share (0.5 for an unknown team)."""
    rec = records.select(*by, "team_abbrev", "wins", "losses", "win_pct")
    df = qualified(totals, bars, by).join(rec, [*by, "team_abbrev"], "left")
    share = F.coalesce("win_pct", F.lit(0.5))
    df = df.select(*by, "player_id", "player_name", "team_abbrev", "gp", *_rates(), "wins", "losses",
                   half_up(share, 3).alias("win_pct"), S.pct("fgm", "fga").alias("fgp"),
                   half_up(S.game_score() * S.team_multiplier(share), 2).alias("score"))
    return ranked(df, by, board_order("score", "ppg"), size)


def rookies(totals: DataFrame, debuts: DataFrame) -> DataFrame:
    """Player-seasons whose season is the player's first."""
    keys = debuts.select("league", "player_id", F.col("debut").alias("season_start"))
    return totals.join(keys, ["league", "player_id", "season_start"], "left_semi")


def roy(totals: DataFrame, bars: DataFrame, debuts: DataFrame | None,
        size: int | None = K.RACE_SIZE, by: Sequence[str] = BY) -> DataFrame | None:
    """Game score per game of rookies.  No debut table: the race does not exist (None)."""
    if debuts is None:
        return None
    df = qualified(rookies(totals, debuts), bars, by).select(
        *by, "player_id", "player_name", "team_abbrev", "gp", *_rates(),
        S.pct("fgm", "fga").alias("fgp"), half_up(S.game_score(), 2).alias("score"))
    return ranked(df, by, board_order("score", "ppg"), size)


def defence_share(records: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(n - i)/n for the i-th best defence by points allowed per game."""
    known = records.filter(F.col("opp_pg").isNotNull())
    w = Window.partitionBy(*by)
    i = F.row_number().over(w.orderBy("opp_pg", "team_abbrev")) - 1
    n = F.count(F.lit(1)).over(w)
    return known.select(*by, "team_abbrev", ((n - i) / n).alias("defence"))


def dpoy(totals: DataFrame, records: DataFrame, bars: DataFrame, size: int | None = K.RACE_SIZE,
         by: Sequence[str] = BY) -> DataFrame:
    """Steals and blocks per game times 0.6 + 0.4 of the team's defence share."""
    rec = records.select(*by, "team_abbrev", "opp_pg").join(
        defence_share(records, by), [*by, "team_abbrev"], "left")
    df = qualified(totals, bars, by).join(rec, [*by, "team_abbrev"], "left")
    stocks = F.coalesce(ratio(F.col("stl") + F.col("blk"), "gp"), F.lit(0.0))
    df = df.select(*by, "player_id", "player_name", "team_abbrev", "gp",
                   S.per_game("stl").alias("spg"), S.per_game("blk").alias("bpg"),
                   half_up(stocks, 1).alias("stocks_pg"), "opp_pg",
                   half_up(stocks * S.team_multiplier(F.coalesce("defence", F.lit(0.5))), 2).alias("score"))
    return ranked(df, by, board_order("score", "stocks_pg"), size)


def sixth_man(totals: DataFrame, bars: DataFrame, size: int | None = K.RACE_SIZE,
              by: Sequence[str] = BY) -> DataFrame:
    """(pts + 0.5 ast + 0.25 reb) per game of bench players."""
    score = ratio(F.col("pts") + F.lit(0.5) * F.col("ast") + F.lit(0.25) * F.col("reb"), "gp")
    df = bench_only(qualified(totals, bars, by)).select(
        *by, "player_id", "player_name", "team_abbrev", "gp", "starts",
        half_up(ratio("starts", "gp"), 3).alias("start_pct"), *_rates(),
        half_up(score, 2).alias("score"))
    return ranked(df, by, board_order("score", "ppg"), size)


def mip(totals: DataFrame, bars: DataFrame, size: int | None = K.RACE_SIZE) -> DataFrame:
    """Change of game score per 36 minutes against the season before.

    The season before is the previous row of the player's few qualified seasons; no self join.
    """
    ok = qualified(totals, bars).filter(F.col("minutes") > 0).select(
        *BY, "player_id", "player_name", "team_abbrev", "gp", *_rates(), S.game_score_per36().alias("_per36"))
    career = Window.partitionBy("league", "player_id").orderBy("season_start")
    lags = [F.lag(c).over(career).alias(f"{c}_prev") for c in ("gp", *RATES, "_per36", "season_start")]
    df = ok.select("*", *lags).filter(F.col("season_start_prev") == F.col("season_start") - 1).select(
        *BY, "player_id", "player_name", "team_abbrev", "gp", "gp_prev", *RATES,
        *[f"{n}_prev" for n in RATES],
        half_up(F.col("ppg") - F.col("ppg_prev"), 1).alias("delta_ppg"),
        half_up(F.col("_per36") - F.col("_per36_prev"), 2).alias("score"))
    return ranked(df, BY, board_order("score", "delta_ppg"), size)


def series_mvp(box: DataFrame, games: DataFrame, by: Sequence[str],
               size: int | None = K.RACE_SIZE, parts: int | None = None) -> DataFrame:
    """The MVP formula on a play-off series: own standings, bar at half its games rounded up."""
    played = played_games(games)
    bars = played.groupBy(*by).agg(F.count(F.lit(1)).alias("max_games")).withColumn(
        "min_gp", in_season_bar(F.col("max_games")))
    rows = box.join(played.select(*by, "game_id"), [*by, "game_id"], "left_semi")
    return mvp(player_totals(rows, by, parts=parts), series_results(games, by), bars, size, by)


def stat_leaders(totals: DataFrame, bars: DataFrame, stats: Sequence[str] = K.LEADER_STATS,
                 size: int | None = K.RACE_SIZE, by: Sequence[str] = BY) -> DataFrame:
    """Per-game leaders of every stat with the full line; long form, one window for all stats."""
    ok = qualified(totals, bars, by)
    line = {"mpg": "minutes", "ppg": "pts", "rpg": "reb", "apg": "ast", "spg": "stl", "bpg": "blk"}
    long = ok.select(
        *by, "player_id", "player_name", "team_abbrev", "gp",
        *[S.per_game(s).alias(n) for n, s in line.items()],
        *[nz(c).alias(c) for c in ("fgm", "fga", "fg3m", "fg3a")],
        *[c.alias(n) for n, c in S.efficiency().items()],
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("stat"), nz(s).cast("bigint").alias("total"),
                     S.per_game(s).alias("per_game")) for s in stats])).alias("_s"),
    ).select("*", "_s.*").drop("_s")
    order = [F.desc("per_game"), F.desc("total"), F.asc(F.coalesce("player_name", F.lit(""))),
             F.asc("player_id")]
    return ranked(long, [*by, "stat"], order, size)


def season_races(totals: DataFrame, records: DataFrame, debuts: DataFrame | None = None,
                 size: int = K.RACE_SIZE) -> DataFrame:
    """The five races of every season in one long table (four without a debut table).

    One pass over the totals: every player-season carries all its race scores, the races it is
    eligible for are exploded, and a single ranked window serves all of them.
    """
    rec = records.select(*BY, "team_abbrev", "win_pct").join(
        defence_share(records), [*BY, "team_abbrev"], "left")
    df = qualified(totals, qualifiers(records)).join(rec, [*BY, "team_abbrev"], "left").select(
        *BY, "player_id", "player_name", "team_abbrev", "gp", "starts", "minutes", "win_pct", "defence",
        S.per_game("pts").alias("ppg"), S.game_score().alias("gs"), S.game_score_per36().alias("per36"),
        ratio(F.col("stl") + F.col("blk"), "gp").alias("stocks"),
        ratio(F.col("pts") + F.lit(0.5) * F.col("ast") + F.lit(0.25) * F.col("reb"), "gp").alias("bench"))
    timed = F.col("minutes") > 0
    career = Window.partitionBy("league", "player_id", timed).orderBy("season_start")
    last = timed & (F.lag("season_start").over(career) == F.col("season_start") - 1)
    df = df.select("*", F.coalesce(last, F.lit(False)).alias("has_prev"),
                   F.lag("per36").over(career).alias("per36_prev"), F.lag("ppg").over(career).alias("ppg_prev"))

    def entry(race: str, eligible: Column, score: Column, tie: Column) -> Column:
        return F.when(eligible, F.struct(F.lit(race).alias("race"), half_up(score, 2).alias("score"),
                                         tie.alias("tie")))

    ppg = F.col("ppg")
    entries = [
        entry("mvp", F.lit(True), F.col("gs") * S.team_multiplier(F.coalesce("win_pct", F.lit(0.5))), ppg),
        entry("dpoy", F.lit(True), F.col("stocks") * S.team_multiplier(F.coalesce("defence", F.lit(0.5))),
              half_up("stocks", 1)),
        entry("sixth_man", ratio("starts", "gp") <= F.lit(K.BENCH_MAX_START_SHARE), F.col("bench"), ppg),
        entry("mip", F.col("has_prev"), F.col("per36") - F.col("per36_prev"),
              half_up(ppg - F.col("ppg_prev"), 1)),
    ]
    if debuts is not None:
        first = debuts.select("league", "player_id", F.col("debut").alias("season_start"),
                              F.lit(True).alias("rookie")).distinct()
        df = df.join(first, ["league", "player_id", "season_start"], "left")
        entries.append(entry("roy", F.coalesce("rookie", F.lit(False)), F.col("gs"), ppg))
    long = df.select(*BY, "player_id", "player_name", "team_abbrev", "gp",
                     F.explode(F.array_compact(F.array(*entries))).alias("e")).select("*", "e.*").drop("e")
    return ranked(long, [*BY, "race"], board_order("score", "tie"), size).drop("tie")


# --- live races ------------------------------------------------------------------------

def live_lines(candidates: DataFrame, lines: DataFrame, teams: DataFrame) -> DataFrame:
    """Leader-board candidates with their season totals; starts and minutes unknown (0)."""
    t = teams.select("league", "team_id", F.col("abbrev").alias("team_abbrev"))
    return (candidates.join(lines, ["league", "player_id"]).filter(F.col("gp") > 0)
            .join(t, ["league", "team_id"], "left")
            .withColumn("team_abbrev", F.coalesce("team_abbrev", F.lit("")))
            .withColumn("starts", F.lit(0)).withColumn("minutes", F.lit(0)))


def live_bars(lines: DataFrame, by: Sequence[str] = ("league",)) -> DataFrame:
    return lines.groupBy(*by).agg(F.max("gp").alias("max_games")).withColumn(
        "min_gp", in_season_bar(F.col("max_games")))


def live_records(standings: DataFrame, teams: DataFrame) -> DataFrame:
    """Records by abbreviation from a standings table; nobody played yet is 0.5."""
    t = teams.select("league", "team_id", F.col("abbrev").alias("team_abbrev"))
    w, lo = nz("wins"), nz("losses")
    return standings.join(t, ["league", "team_id"]).filter(F.col("team_abbrev") != "").select(
        "league", "team_abbrev", w.alias("wins"), lo.alias("losses"),
        F.coalesce(ratio(w, w + lo), F.lit(0.5)).alias("win_pct"))


def live_mvp(candidates: DataFrame, lines: DataFrame, teams: DataFrame,
             standings: DataFrame | None, size: int | None = K.RACE_SIZE) -> DataFrame:
    """In-season MVP race: no standings table holds every team at 0.5."""
    rows = live_lines(candidates, lines, teams)
    if standings is None:
        rec = teams.limit(0).select("league", F.col("abbrev").alias("team_abbrev"),
                                    F.lit(0).alias("wins"), F.lit(0).alias("losses"),
                                    F.lit(0.5).alias("win_pct"))
    else:
        rec = live_records(standings, teams)
    return mvp(rows, rec, live_bars(rows), size, by=("league",))


def draft_class(candidates: DataFrame, profiles: DataFrame, season_start: int) -> DataFrame:
    """Candidates drafted in the season's start year; an unknown draft year never counts."""
    cls = profiles.filter(F.col("draft_year") == season_start).select("league", "player_id")
    return candidates.join(cls, ["league", "player_id"], "left_semi")


def unknown_draft(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Candidates per league left out because their profile has no draft year."""
    return candidates.join(profiles.filter(F.col("draft_year").isNull()).select("league", "player_id"),
                           ["league", "player_id"], "left_semi").groupBy("league").agg(F.count(F.lit(1)).alias("undrafted"))


def live_roy(candidates: DataFrame, profiles: DataFrame, lines: DataFrame, teams: DataFrame,
             season_start: int, size: int | None = K.RACE_SIZE) -> DataFrame:
    """In-season rookie race over the draft class of the season's start year."""
    rows = live_lines(draft_class(candidates, profiles, season_start), lines, teams)
    named = rows.drop("player_name").join(
        profiles.select("league", "player_id", "player_name"), ["league", "player_id"], "left")
    df = qualified(named, live_bars(named), ("league",)).select(
        "league", "player_id", "player_name", "team_abbrev", "gp", *_rates(),
        S.pct("fgm", "fga").alias("fgp"), half_up(S.game_score(), 2).alias("score"))
    return ranked(df, ("league",), board_order("score", "ppg"), size)


# --- reports ----------------------------------------------------------------------------

def score_trend(rows: DataFrame, by: Sequence[str] = BY, score: str = "fantasy_points") -> DataFrame:
    """Mean score per season over rows with minutes."""
    return rows.filter(F.col("min") > 0).groupBy(*by).agg(F.avg(score).alias("mean_score"))


def rest_effect(features: DataFrame, score: str = "fantasy_points") -> DataFrame:
    """Mean score per rest group over rows with minutes."""
    return (features.filter((F.col("min") > 0) & F.col("back_to_back").isNotNull())
            .groupBy(S.rest_group().alias("rest_group")).agg(F.avg(score).alias("mean_score")))


def score_quantiles(rows: DataFrame, group: str = "position", score: str = "fantasy_points",
                    approx: bool = False) -> DataFrame:
    """Five-number summary per group.

    Exact form: counts per score, running counts over ranges of scores, and the ranks picked from
    them; no group's scores meet in one place. ``approx`` switches to a fixed-size sketch.
    """
    shares = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    base = rows.filter(F.col("min") > 0)
    if not approx:
        return quantiles(base, [group], score, shares)
    out = base.groupBy(group).agg(F.percentile_approx(score, F.array(*[F.lit(x) for x in shares.values()])).alias("q"))
    return out.select(group, *[F.col("q")[i].alias(n) for i, n in enumerate(shares)])


def minutes_fit(rows: DataFrame, score: str = "fantasy_points", by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of score on minutes."""
    ok = rows.filter((F.col("min") > 0) & F.col(score).isNotNull())
    return ok.groupBy(*by).agg(
        F.regr_slope(score, "min").alias("slope"), F.regr_intercept(score, "min").alias("intercept"),
        F.regr_r2(score, "min").alias("r2"), F.count(F.lit(1)).alias("n"))


def dataset_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, seasons, distinct games and share of rows with minutes."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("season").alias("n_seasons"),
        F.countDistinct("game_id").alias("n_games"),
        half_up(F.avg(F.when(F.col("min") > 0, 1.0).otherwise(0.0)), 6).alias("share_played"))


def kpi_strip(box: DataFrame, games: DataFrame, totals: DataFrame, bars: DataFrame, today: str,
              zone: str = "UTC", by: Sequence[str] = BY) -> DataFrame:
    """Games collected, next tip-off (local day not before ``today``) and qualified top scorer."""
    collected = box.groupBy(*by).agg(F.countDistinct("game_id").alias("games_collected"))
    nxt = games.filter((F.col("status") != K.FINAL) & (local_date("ts", zone) >= today)).groupBy(
        *by).agg(F.min("ts").alias("next_tip"))
    top = stat_leaders(totals, bars, ("pts",), 1, by).select(
        *by, F.col("player_id").alias("top_player_id"), F.col("player_name").alias("top_player_name"),
        F.col("per_game").alias("top_ppg"))
    return collected.join(nxt, list(by), "left").join(top, list(by), "left")
