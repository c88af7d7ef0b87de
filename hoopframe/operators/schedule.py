"""Schedules, standings, injuries, rounds, and keeping them current.

A game row is (league, season, season_start, game_id, ts, home_*, away_*, status, neutral, round?).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as X
from ..functions.core import first_by, nz, ranked
from ..functions.seasons import current_season_label, latest_completed_season
from .ordering import number_rows

ALL_TEAMS = "All teams"
GAME = ("league", "season", "game_id")


# --- filters and splits -----------------------------------------------------------------------

def filter_schedule(games: DataFrame, team: str = ALL_TEAMS, venue: str | None = None) -> DataFrame:
    """One team's games (either side), then home, away or neutral-site games only."""
    one = bool(team) and team != ALL_TEAMS and {"home_abbrev", "away_abbrev"} <= set(games.columns)
    out = games.filter((F.col("home_abbrev") == team) | (F.col("away_abbrev") == team)) if one else games
    if venue == "Neutral":
        return out.filter(X.is_neutral("neutral")) if "neutral" in games.columns else out.filter(F.lit(False))
    if one and venue in ("Home", "Away"):
        return out.filter(F.col(f"{venue.lower()}_abbrev") == team)
    return out


def with_state(games: DataFrame, today: str, zone: str = "UTC") -> DataFrame:
    """``state``: final, upcoming (local day today or later) or stale; plus the local ``day``."""
    day = X.local_date("ts", zone)
    return games.withColumn("day", day).withColumn("state", F.when(F.col("status") == K.FINAL, "final").when(
        F.col("day") >= today, "upcoming").otherwise("stale"))


def schedule_counts(games: DataFrame, today: str, zone: str = "UTC",
                    by: Sequence[str] = ("league", "season")) -> DataFrame:
    """Final, upcoming and stale rows and distinct games."""
    s = with_state(games, today, zone)
    return s.groupBy(*by).agg(*[F.count_if(F.col("state") == n).alias(n) for n in ("final", "upcoming", "stale")],
                              F.countDistinct("game_id").alias("games"))


def local_day_games(games: DataFrame, start: str, end: str, zone: str = "UTC") -> DataFrame:
    """Games tipping in [start, end) (UTC times), each once, with local time, earliest first."""
    ts = F.col("ts")
    inside = games.filter((ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp")))
    once = first_by(inside, ["league", "game_id"], ["ts"])
    return once.withColumn("time", X.local_stamp("ts", zone)).orderBy("ts", "game_id")


def recent_results(games: DataFrame, size: int | None = K.RECENT_RESULTS) -> DataFrame:
    """The newest finished games of each league, newest first (all of them without a size)."""
    done = games.filter(F.col("status") == K.FINAL)
    if size is not None:
        done = ranked(done, ["league"], [F.desc("ts"), F.desc("game_id")], size, "_n").drop("_n")
    return done.orderBy("league", F.desc("ts"), F.desc("game_id"))


def next_fixtures(games: DataFrame, today: str, zone: str = "UTC", size: int | None = K.NEXT_FIXTURES) -> DataFrame:
    """The next games of each league, earliest first (all of them without a size)."""
    ahead = with_state(games, today, zone).filter(F.col("state") == "upcoming")
    if size is not None:
        ahead = ranked(ahead, ["league"], [F.asc("ts"), F.asc("game_id")], size, "_n").drop("_n")
    return ahead.orderBy("league", "ts", "game_id")


def schedule_order(games: DataFrame) -> DataFrame:
    """By date, undated first, then id."""
    return games.orderBy(F.asc_nulls_first("ts"), "game_id")


def schedule_places(games: DataFrame) -> DataFrame:
    """Each game's ``place`` in that order, for a schedule of any length."""
    return number_rows(games, [F.asc_nulls_first("ts"), "game_id"], "place")


# --- standings and injuries ----------------------------------------------------------------------

def standings_view(standings: DataFrame) -> DataFrame:
    """Conference and seed order with zone, numeric games behind and win share."""
    by = ["league", "season"]
    played = standings.groupBy(*by).agg((F.sum(nz("wins") + nz("losses")) > 0).alias("_played"))
    return (standings.join(played, by, "left")
            .withColumn("zone", X.seed_zone(F.col("league"), F.col("playoff_seed"), F.coalesce("_played", F.lit(False))))
            .withColumn("games_behind", X.games_behind("games_behind"))
            .withColumn("win_percent", X.to_double("win_percent")).drop("_played")
            .orderBy("league", "season", F.asc_nulls_last("conference"), F.asc_nulls_last("playoff_seed"), "team_id"))


def first_with_results(standings: DataFrame, order: DataFrame) -> DataFrame:
    """Standings of the first season in a try-order (league, season, priority) anybody has played in."""
    by = ["league", "season"]
    have = standings.groupBy(*by).agg(F.sum(nz("wins") + nz("losses")).alias("_n")).filter(F.col("_n") > 0)
    pick = have.join(order, by).groupBy("league").agg(F.min_by("season", "priority").alias("season"))
    return standings.join(pick, by, "left_semi")


def zero_table(teams: DataFrame, season: str) -> DataFrame:
    """0-0 standings of every team, for a season nobody has played in."""
    return teams.select("league", F.lit(season).alias("season"), "team_id", F.col("display_name").alias("team"),
                        F.lit(0).alias("wins"), F.lit(0).alias("losses"))


def injury_report(injuries: DataFrame) -> DataFrame:
    """Out, Doubtful, Questionable, Day-To-Day, others; then team and player, missing last."""
    from ..functions.core import case_map
    rank = case_map(F.col("status"), K.INJURY_ORDER, F.lit(4))
    return injuries.withColumn("severity", rank).orderBy(
        "severity", F.asc_nulls_last("team"), F.asc_nulls_last("player_name"))


def numbered_report(injuries: DataFrame) -> DataFrame:
    """The report with ``severity`` and each row's ``position`` in it, for a report of any size."""
    return number_rows(injury_report(injuries), ["severity", F.asc_nulls_last("team"), F.asc_nulls_last("player_name")], "position")


def current_only(rows: DataFrame, today: str) -> DataFrame:
    """Reports that only make sense for the season being played."""
    return rows.filter(F.col("season") == current_season_label(F.lit(today).cast("date"), F.col("league")))


def injury_counts(injuries: DataFrame, by: Sequence[str] = ("league",)) -> DataFrame:
    return injuries.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "Out").alias("out"))


def enough_teams(teams: DataFrame) -> DataFrame:
    """Per league: distinct teams and whether the list is complete enough to use."""
    need = F.lit(None).cast("int")
    for lg, cfg in K.LEAGUES.items():
        need = F.when(F.col("league") == lg, cfg["min_teams"]).otherwise(need)
    return teams.groupBy("league").agg(F.countDistinct("team_id").alias("teams")).withColumn("ok", F.col("teams") >= need)


# --- rounds ------------------------------------------------------------------------------------------

def with_rounds(games: DataFrame) -> DataFrame:
    """Bracket position and display text of every game; blank rounds come last under their own label."""
    ok = X.has_round("round")
    return games.withColumn("round_rank", F.when(ok, X.round_rank("round")).otherwise(9)).withColumn(
        "round_text", F.when(ok, X.round_display("round")).otherwise(K.NO_ROUND))


def bracket_order(games: DataFrame) -> DataFrame:
    return with_rounds(games).orderBy("round_rank", "round_text", "ts", "game_id")


def fill_rounds(games: DataFrame, labels: DataFrame) -> DataFrame:
    """Label rows without a round from (league, game_id, round), one label a game; existing labels stay."""
    one = labels.groupBy("league", "game_id").agg(F.min(F.nullif("round", F.lit(""))).alias("_label"))
    return games.join(one, ["league", "game_id"], "left").withColumn(
        "round", F.coalesce(F.when(F.trim("round") != "", F.col("round")), "_label", "round")).drop("_label")


# --- keeping a schedule current ------------------------------------------------------------------------

def quality() -> Column:
    """How complete a copy of a game is: final, both scores, a date."""
    has = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    return F.struct(F.coalesce(F.col("status") == K.FINAL, F.lit(False)).cast("int").alias("final"),
                    (has("home_score") & has("away_score")).cast("int").alias("scores"),
                    F.col("ts").isNotNull().cast("int").alias("dated"))


def best_copy(games: DataFrame, source_order: str) -> DataFrame:
    """One row per game: the most complete copy, the earlier source on a tie."""
    q = quality()
    return first_by(games.withColumn("_q", q), ["league", "season", "game_id"], [
        -F.col("_q.final"), -F.col("_q.scores"), -F.col("_q.dated"), F.col(source_order)]).drop("_q")


def upsert_schedule(existing: DataFrame, fresh: DataFrame, source_order: str, failed_calls: DataFrame) -> DataFrame:
    """Season by season the fresh games replace the stored ones, except when the fresh set is empty,
    or smaller while some calls failed; then the stored season stays.

    ``failed_calls`` is (league, season, failures).
    """
    by = ["league", "season"]
    new = best_copy(fresh, source_order).drop(source_order)
    n_new = new.groupBy(*by).agg(F.count(F.lit(1)).alias("_new"))
    n_old = existing.groupBy(*by).agg(F.count(F.lit(1)).alias("_old"))
    choice = n_old.join(n_new, by, "full_outer").join(failed_calls, by, "left").select(
        *by, (nz("_new") > 0).alias("_any"), ((nz("_old") > nz("_new")) & (nz("failures") > 0)).alias("_shrunk"))
    take_new = F.col("_any") & ~F.col("_shrunk")
    fresh_seasons = choice.filter(take_new).select(*by)
    kept_seasons = choice.filter(~take_new).select(*by)
    return existing.join(kept_seasons, by, "left_semi").unionByName(
        new.join(fresh_seasons, by, "left_semi"), allowMissingColumns=True)


def pending_games(games: DataFrame, stored: DataFrame) -> DataFrame:
    """Finished games without a valid stored box score."""
    return games.filter(F.col("status") == K.FINAL).join(stored.select(*GAME), list(GAME), "left_anti")


def gap_spans(regular: DataFrame, post: DataFrame, by: Sequence[str] = ("league", "season")) -> DataFrame:
    """Days between the last regular and the first postseason game of a season, one row per day."""
    last = regular.filter(F.col("ts").isNotNull()).groupBy(*by).agg(F.max("ts").alias("_last"))
    first = post.filter(F.col("ts").isNotNull()).groupBy(*by).agg(F.min("ts").alias("_first"))
    return last.join(first, list(by)).select(*by, F.explode(X.gap_days("_last", "_first")).alias("day"))


def gap_games(found: DataFrame, post: DataFrame) -> DataFrame:
    """Games seen on gap days that the postseason table does not have yet."""
    return found.join(post.select(*GAME), list(GAME), "left_anti").dropDuplicates(list(GAME))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of tables with differing headers."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def refresh_positions(existing: DataFrame, fresh: DataFrame, failed_teams: DataFrame) -> DataFrame:
    """Fresh roster rows plus the stored rows of teams whose call failed."""
    return union_all([fresh, existing.join(failed_teams.select("league", "team_id"), ["league", "team_id"], "left_semi")])


# --- seasons ------------------------------------------------------------------------------------------

def available_seasons(games: DataFrame, first_year: int | None = None) -> DataFrame:
    """Season labels with at least one game (since ``first_year``, if given)."""
    since = games if first_year is None else games.filter(F.col("season_start") >= first_year)
    return since.select("league", "season", "season_start").distinct()


def latest_season(games: DataFrame) -> DataFrame:
    """Newest season with games and newest with finished games per league."""
    done = F.when(F.col("status") == K.FINAL, F.col("season_start"))
    return games.groupBy("league").agg(F.max_by("season", "season_start").alias("latest"),
                                       F.max_by("season", done).alias("latest_played"))


def games_by_season(box: DataFrame, spine: DataFrame) -> DataFrame:
    """Stored games per season of a spine, 0 where nothing is stored."""
    n = box.groupBy("league", "season").agg(F.countDistinct("game_id").alias("games"))
    return spine.select("league", "season").join(n, ["league", "season"], "left").withColumn("games", nz("games"))


def season_options(spine: DataFrame, seen: DataFrame) -> DataFrame:
    """Generated seasons plus every label seen, newest first."""
    return spine.select("league", "season").unionByName(seen.select("league", "season")).distinct().orderBy(
        "league", F.desc("season"))


def season_counts(games: DataFrame) -> DataFrame:
    return games.groupBy("league", "season").agg(F.count(F.lit(1)).alias("games"))


def try_order(seasons: DataFrame, today: str, current_first: bool = False) -> DataFrame:
    """(league, season, priority): completed season, current season, then the stored ones newest
    first; ``current_first`` swaps the first two.  Every label once, at its best place."""
    d = F.lit(today).cast("date")
    leagues = seasons.select("league").distinct()
    done, now = latest_completed_season(d, F.col("league")), current_season_label(d, F.col("league"))
    head = leagues.select("league", done.alias("season"), F.lit(1 if current_first else 0).alias("priority")).unionByName(
        leagues.select("league", now.alias("season"), F.lit(0 if current_first else 1).alias("priority")))
    stored = ranked(seasons.select("league", "season").distinct(), ["league"], [F.desc("season")], None, "priority").withColumn(
        "priority", F.col("priority") + 1)
    return head.unionByName(stored).groupBy("league", "season").agg(F.min("priority").alias("priority"))


def merge_seasons(committed: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rebuilt seasons replace the committed ones; all other seasons stay."""
    keys = rebuilt.select("league", "season").distinct()
    return committed.join(keys, ["league", "season"], "left_anti").unionByName(rebuilt, allowMissingColumns=True)


def resolve_debuts(*sources: DataFrame) -> DataFrame:
    """(league, player_id, debut): the first source that knows a debut wins."""
    parts = [s.select("league", "player_id", "debut").filter(F.col("debut").isNotNull()).withColumn("_p", F.lit(i))
             for i, s in enumerate(sources)]
    return first_by(union_all(parts), ["league", "player_id"], ["_p", "debut"]).select("league", "player_id", "debut")


def team_lookup(rows: DataFrame, teams: DataFrame) -> DataFrame:
    """Abbreviation and name of a team id."""
    t = teams.select("league", "team_id", F.col("abbrev").alias("team_abbrev"), F.col("display_name").alias("team_name"))
    return rows.join(t, ["league", "team_id"], "left")


def stale_entries(bundles: DataFrame, pool: DataFrame, now: Column, current_end_year: int) -> DataFrame:
    """Players whose stored history must be fetched again: absent, incomplete or past its age limit."""
    years = F.array_max(F.transform("rows", lambda r: r["year"]))
    ttl = F.when(years < current_end_year - 1, K.STATIC_TTL_DAYS).otherwise(K.ACTIVE_TTL_DAYS)
    ok = F.col("complete") & F.col("debut").isNotNull() & X.is_fresh("fetched", ttl, now)
    fresh = bundles.filter(F.coalesce(ok, F.lit(False))).select("league", "player_id")
    return pool.select("league", "player_id").join(fresh, ["league", "player_id"], "left_anti")


def refresh_work(bundles: DataFrame, pool: DataFrame, now: Column, current_end_year: int) -> DataFrame:
    """(league, player_id, reason, place): the histories to fetch again, in the order to fetch them.

    Absent ones first, then incomplete ones, then those past their age limit (longer for careers that
    are over), oldest first. Numbered over ranges, so the list may be of any length.
    """
    years = F.array_max(F.transform("rows", lambda r: r["year"]))
    ttl = F.when(years < current_end_year - 1, K.STATIC_TTL_DAYS).otherwise(K.ACTIVE_TTL_DAYS)
    whole = F.coalesce(F.col("complete") & F.col("debut").isNotNull(), F.lit(False))
    state = bundles.select("league", "player_id", "fetched", F.when(~whole, "incomplete").when(~X.is_fresh("fetched", ttl, now), "expired").otherwise("fresh").alias("reason"))
    listed = (pool.select("league", "player_id").distinct().join(state, ["league", "player_id"], "left")
              .withColumn("reason", F.coalesce("reason", F.lit("absent"))).where("reason <> 'fresh'"))
    first = F.array_position(F.array(*[F.lit(x) for x in ("absent", "incomplete", "expired")]), F.col("reason"))
    ordered = listed.withColumn("_first", first)
    return number_rows(ordered, ["_first", F.asc_nulls_first("fetched"), "league", "player_id"], "place").drop("_first", "fetched")


def content_hash(df: DataFrame, keys: Sequence[str], ignore: Sequence[str] = K.STAMP_COLUMNS) -> DataFrame:
    """Order-free fingerprint per key (a sum of row hashes, so copies count), stamps left out."""
    cols = sorted(c for c in df.columns if c not in ignore)
    row = F.xxhash64(*[x for c in cols for x in (F.col(c), F.col(c).isNull())])  # nulls alone hash to nothing
    return df.groupBy(*keys).agg(F.sum(row.cast("decimal(28,0)")).alias("hash"), F.count(F.lit(1)).alias("n"))


def changed_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``new`` whose content differs from ``old`` (or that ``old`` lacks)."""
    o = content_hash(old, keys).withColumnsRenamed({"hash": "_h", "n": "_n"})
    n = content_hash(new, keys)
    same = F.col("hash").eqNullSafe(F.col("_h")) & F.col("n").eqNullSafe(F.col("_n"))
    return n.join(o, list(keys), "left").filter(~same).select(*keys)


def same_content(old: DataFrame, new: DataFrame, ignore: Sequence[str] = K.STAMP_COLUMNS) -> bool:
    """Whether two tables hold the same rows, stamps aside."""
    cols = sorted(c for c in new.columns if c not in ignore)
    if cols != sorted(c for c in old.columns if c not in ignore):
        return False
    mark = lambda df: content_hash(df.select(*cols), [], ignore).first()
    a, b = mark(old), mark(new)
    return (a["hash"], a["n"]) == (b["hash"], b["n"])
