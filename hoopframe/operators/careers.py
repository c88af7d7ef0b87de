"""Careers: totals over seasons, all-time boards, honours, titles, the ladder and the player index.

Table shapes: ``careers`` has one row per (league, player_id); ``honours`` is long
(league, player_id, name, wins); ``bundles`` is one row per player with ``line`` (a struct of
career totals or null) and ``rows`` (season averages, one struct per season of the career).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import overlays as V
from ..functions import scoring as S
from ..functions.core import board_order, half_up, nz, ranked, ratio
from ..functions.seasons import season_label
from .boards import attempt_floor

PID = ("league", "player_id")
LINE = ("gp", "starts", "minutes", *K.LINE_STATS)


# --- totals and boards ---------------------------------------------------------------------

def career_totals(totals: DataFrame) -> DataFrame:
    """Sum of all seasons, latest known team, first name, best season's impact."""
    named = F.coalesce(F.col("team_abbrev") != "", F.lit(False))
    return totals.withColumn("_impact", S.impact()).groupBy(*PID).agg(
        F.min_by("player_name", "season_start").alias("player_name"),
        F.max_by("team_abbrev", F.when(named, F.col("season_start"))).alias("team_abbrev"),
        F.count(F.lit(1)).alias("seasons"),
        *[F.sum(nz(c)).alias(c) for c in ("gp", "starts", "minutes", *K.CAREER_STATS)],
        F.greatest(F.max("_impact"), F.lit(0.0)).alias("peak_impact"))


def career_row() -> list[Column]:
    """Every counting total, split and efficiency of a career line."""
    return ([S.per_game("pts").alias("ppg"), S.per_game("reb").alias("rpg"), S.per_game("ast").alias("apg")]
            + [nz(c).alias(c) for c in K.LINE_STATS] + [F.col("plus_minus")]
            + [c.alias(n) for n, c in S.efficiency().items()])


def alltime_boards(careers: DataFrame, size: int = K.ALLTIME_SIZE, min_gp: int = K.ALLTIME_MIN_GP) -> DataFrame:
    """All-time boards in one long table: 7 by career total, 5 by percentage.

    A career without any covered game has no plus_minus and is absent from that board only.
    """
    base = careers.filter(F.col("gp") >= min_gp).select(
        *PID, "player_name", "team_abbrev", "seasons", "gp", "minutes", *career_row())
    counting = [F.struct(F.lit(s).alias("category"), F.col(s).cast("double").alias("value"),
                         F.col("ppg").alias("tie")) for s in K.LEADER_STATS]
    rates = [F.when(attempt_floor(c), F.struct(F.lit(c).alias("category"), F.col(c).alias("value"),
                                               nz(K.ATTEMPT_FLOORS[c][0]).cast("double").alias("tie")))
             for c in K.ATTEMPT_FLOORS]
    long = base.withColumn("_e", F.explode(F.array_compact(F.array(*counting, *rates)))).select(
        "*", "_e.*").drop("_e").filter(F.col("value").isNotNull())
    return ranked(long, ["league", "category"], board_order("value", "tie"), size).drop("tie")


# --- honours ----------------------------------------------------------------------------------

def honour_table(spark: SparkSession, points: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """(league, name, points): the fixed award weights as a small table."""
    points = K.HONOUR_POINTS if points is None else points
    rows = [(lg, n, float(p)) for lg, names in points.items() for n, p in names.items()]
    return spark.createDataFrame(rows, "league string, name string, points double")


def honours_per_player(wins: DataFrame) -> DataFrame:
    """Wins per player and award name."""
    return wins.groupBy(*PID, "name").agg(F.count(F.lit(1)).alias("wins"))


def honour_points(honours: DataFrame, table: DataFrame) -> DataFrame:
    """Points and number of wins per player; unknown awards score 0."""
    return honours.join(table, ["league", "name"], "left").groupBy(*PID).agg(
        F.sum(nz("points") * F.col("wins")).alias("points"), F.sum("wins").alias("honours_total"))


def honours_map(honours: DataFrame) -> DataFrame:
    """Per player a map award name -> wins (one entry per award type)."""
    return honours.groupBy(*PID).agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("name", "wins")))).alias("honours"))


def accolades_pivot(honours: DataFrame, names: DataFrame, players: Sequence[str], table: DataFrame) -> DataFrame:
    """Award x selected players, blank where never won, heaviest award first."""
    picked = honours.join(names.select(*PID, "player_name").filter(F.col("player_name").isin(*players)), list(PID))
    wide = picked.groupBy("league", "name").pivot("player_name", list(players)).agg(F.sum("wins"))
    return wide.join(table, ["league", "name"], "left").withColumn(
        "points", nz("points")).orderBy("league", F.desc("points"), "name")


def official_winners(wins: DataFrame) -> DataFrame:
    """Winners of the five races' official awards: (league, year, race, player_id)."""
    out = F.lit(None).cast("string")
    for race, name in K.RACE_AWARDS.items():
        out = F.when(F.col("name") == name, race).otherwise(out)
    for lg, cfg in K.LEAGUES.items():
        out = F.when((F.col("league") == lg) & (F.col("name") == cfg["sixth_award"]), "sixth_man").otherwise(out)
    return wins.withColumn("race", out).filter(F.col("race").isNotNull()).select(
        "league", "year", "race", "player_id")


def fill_champions(champions: DataFrame, verified: DataFrame) -> DataFrame:
    """Verified champions fill only the years without one."""
    gaps = verified.join(champions.select("league", "year"), ["league", "year"], "left_anti")
    return champions.select("league", "year", "team_id").unionByName(gaps.select("league", "year", "team_id"))


def verified_champions(spark: SparkSession) -> DataFrame:
    rows = [(lg, y, t) for lg, c in K.LEAGUES.items() for y, t in c["verified_champions"].items()]
    return spark.createDataFrame(rows, "league string, year int, team_id bigint")


# --- history bundles -------------------------------------------------------------------------

def first_year() -> Column:
    return F.array_min(F.transform("rows", lambda r: r["year"]))


def trusted() -> Column:
    """Season rows reach back to the start of the career (debut + 1 at the latest)."""
    return F.coalesce(first_year() <= F.col("debut") + 1, F.lit(False))


def debut_year() -> Column:
    """Stated debut, else the year of the first season row (end years: minus 1 for split labels)."""
    split = [k for k, v in K.LEAGUES.items() if v["label"] == "split"]
    return F.coalesce("debut", first_year() - F.when(F.col("league").isin(*split), 1).otherwise(0))


def peak_from_rows(rows: str = "rows") -> Column:
    """Best season's pts + 0.75 reb + ast over seasons with games, one decimal, 0 -> null."""
    value = F.transform(F.filter(rows, lambda r: r["gp"] > 0), lambda r: F.coalesce(
        r["pts"], F.lit(0.0)) + F.lit(0.75) * F.coalesce(r["reb"], F.lit(0.0)) + F.coalesce(r["ast"], F.lit(0.0)))
    return F.nullif(half_up(F.greatest(F.array_max(value), F.lit(0.0)), 1), F.lit(0.0))


def season_log(rows: str = "rows", league: Column | str = "league") -> Column:
    """Season rows as records with a season label, for the progression view."""
    lg = F.col(league) if isinstance(league, str) else league
    fields = ("team", "gp", "min", "pts", "reb", "ast", "stl", "blk", "fg_pct", "fg3_pct")
    return F.transform(rows, lambda r: F.struct(
        season_label(r["year"], lg).alias("season"), *[r[f].alias(f) for f in fields]))


def overlay_season_rebounds(bundles: DataFrame, official: DataFrame | None) -> DataFrame:
    """Official rebounds (league, player_id, year, reb) where a season row carries 0."""
    if official is None:
        return bundles
    fix = official.groupBy(*PID).agg(F.map_from_entries(F.collect_list(F.struct("year", "reb"))).alias("_fix"))
    fields = ("year", "team_id", "team", "gp", "min", "pts", "reb", "ast", "stl", "blk", "fg_pct", "fg3_pct")
    value = lambda r: F.when(nzc(r["reb"]) == 0, F.coalesce(F.col("_fix")[r["year"]], r["reb"])).otherwise(r["reb"])
    return bundles.join(fix, list(PID), "left").withColumn("rows", F.when(F.col("_fix").isNull(), F.col("rows")).otherwise(
        F.transform("rows", lambda r: F.struct(*[
            (value(r) if f == "reb" else r[f]).alias(f) for f in fields])))).drop("_fix")


def nzc(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def titles(bundles: DataFrame, champions: DataFrame, current_end_year: int,
           override: DataFrame | None = None) -> DataFrame:
    """(league, player_id, championships).

    Counted from season rows against the champion of the year; null unless the career is
    trusted, starts within the champion index and every completed year has a champion.  An
    override table (league, player_id, titles) wins.
    """
    seasons = bundles.filter(trusted()).select(*PID, F.explode("rows").alias("r")).select(
        *PID, F.col("r.year").alias("year"), F.col("r.team_id").alias("team_id"))
    champ = champions.select("league", "year", F.col("team_id").alias("_champ"))
    done = F.col("year") < current_end_year
    start = F.lit(None).cast("int")
    for lg, cfg in K.LEAGUES.items():
        start = F.when(F.col("league") == lg, cfg["champion_first_year"]).otherwise(start)
    per = seasons.join(champ, ["league", "year"], "left").groupBy(*PID).agg(
        F.min("year").alias("_first"), F.count_if(done).alias("_done"),
        F.count_if(done & F.col("_champ").isNull()).alias("_open"),
        F.count_if(F.col("_champ") == F.col("team_id")).alias("_won"))
    ok = (F.col("_first") >= start) & (F.col("_done") > 0) & (F.col("_open") == 0)
    out = bundles.select(*PID).join(per.select(*PID, F.when(ok, F.col("_won")).alias("championships")), list(PID), "left")
    if override is None:
        return out
    o = override.select(*PID, F.col("titles").alias("_official"))
    return out.join(o, list(PID), "full_outer").withColumn(
        "championships", F.coalesce("_official", "championships")).drop("_official")


def pool(leaders: DataFrame | None, honours: DataFrame, window: DataFrame, min_gp: int = K.ALLTIME_MIN_GP) -> DataFrame:
    """Players worth a history entry: board leaders, honoured players, window players with games."""
    out = honours.select(*PID).unionByName(window.filter(F.col("gp") >= min_gp).select(*PID))
    if leaders is not None:
        out = out.unionByName(leaders.select(*PID))
    return out.distinct()


def career_entries(pool_ids: DataFrame, bundles: DataFrame, window: DataFrame, champions: DataFrame,
                   current_end_year: int, official_titles: DataFrame | None = None,
                   official_rebounds: DataFrame | None = None, official_season_rebounds: DataFrame | None = None,
                   source: str = "history") -> DataFrame:
    """One career entry per pool player: the history line, else the window line, with a source tag.

    The window's plus_minus is added to either; official rebounds fill a 0; peak and season
    count come from trusted season rows, else from the window; entries without a name or games
    are dropped.
    """
    b = overlay_season_rebounds(bundles, official_season_rebounds)
    won = titles(b, champions, current_end_year, official_titles)
    w = window.select(*PID, F.struct("player_name", "team_abbrev", "seasons", "peak_impact", "plus_minus", *LINE).alias("w"))
    j = pool_ids.select(*PID).join(b, list(PID), "left").join(w, list(PID), "left").join(won, list(PID), "left")
    from_history = F.col("line").isNotNull()
    line = {c: F.when(from_history, F.coalesce(F.col(f"line.{c}"), F.lit(0))).otherwise(
        F.coalesce(F.col(f"w.{c}"), F.lit(0))).cast("bigint") for c in LINE}
    if official_rebounds is not None:
        j = j.join(official_rebounds.select(*PID, F.col("reb").alias("_reb")), list(PID), "left")
        line["reb"] = F.when(line["reb"] == 0, F.coalesce(F.col("_reb"), line["reb"])).otherwise(line["reb"])
    has_rows = F.coalesce(F.size("rows"), F.lit(0)) > 0
    row_peak = F.when(trusted(), peak_from_rows())
    out = j.filter(from_history | F.col("w").isNotNull()).select(
        *PID, F.coalesce("name", "w.player_name").alias("player_name"),
        F.coalesce("w.team_abbrev", "team").alias("team_abbrev"),
        F.when(trusted(), F.size("rows")).when(has_rows, F.lit(None)).otherwise(F.col("w.seasons")).cast("bigint").alias("seasons"),
        *[c.alias(n) for n, c in line.items()], F.col("w.plus_minus").alias("plus_minus"),
        F.coalesce(row_peak, "w.peak_impact").alias("peak_impact"), "championships",
        F.when(from_history, source).otherwise("window").alias("line_source"),
        "debut", "position", "jersey", F.when(has_rows, season_log()).alias("seasons_log"))
    return out.filter((F.coalesce("player_name", F.lit("")) != "") & (F.col("gp") > 0))


def merge_history(entries: DataFrame, window: DataFrame, optional: Sequence[str] = ("plus_minus",)) -> DataFrame:
    """History over window, column by column and nulls included.

    A player with a history entry keeps that entry's values as they are; only columns the entry
    never has (absent, or ``optional`` and not set) come from the window.
    """
    h = entries.select(*PID, F.struct(*[c for c in entries.columns if c not in PID]).alias("h"))
    w = window.select(*PID, F.struct(*[c for c in window.columns if c not in PID]).alias("w"))
    j = h.join(w, list(PID), "full_outer")
    cols = []
    for c in dict.fromkeys([*entries.columns, *window.columns]):
        if c in PID:
            continue
        in_h, in_w = c in entries.columns, c in window.columns
        if in_h and in_w:
            over = F.coalesce(f"h.{c}", f"w.{c}") if c in optional else F.col(f"h.{c}")
            cols.append(F.when(F.col("h").isNotNull(), over).otherwise(F.col(f"w.{c}")).alias(c))
        else:
            cols.append(F.col(f"{'h' if in_h else 'w'}.{c}").alias(c))
    out = j.select(*PID, *cols)
    return out.withColumn("line_source", F.coalesce("line_source", F.lit("window"))) if "line_source" in out.columns else out


def history_meta(entries: DataFrame, pool_ids: DataFrame, wins: DataFrame, champions: DataFrame) -> DataFrame:
    """Counters per league: pool, lines by source, honoured players, wins, award types and seasons,
    champion years."""
    lines = entries.groupBy("league").agg(
        F.count_if(F.col("line_source") != "window").alias("history_lines"),
        F.count_if(F.col("line_source") == "window").alias("window_lines"))
    awards = wins.groupBy("league").agg(
        F.countDistinct("player_id").alias("honoured_players"), F.count(F.lit(1)).alias("honour_wins"),
        F.countDistinct("name").alias("award_types"), F.countDistinct("name", "year").alias("award_seasons"))
    years = champions.groupBy("league").agg(F.countDistinct("year").alias("champion_years"))
    p = pool_ids.groupBy("league").agg(F.count(F.lit(1)).alias("pool"))
    out = p.join(lines, "league", "left").join(awards, "league", "left").join(years, "league", "left")
    return out.na.fill(0)


# --- the ladder ------------------------------------------------------------------------------------

def ladder(careers: DataFrame, honours: DataFrame | None, table: DataFrame, size: int | None = K.LADDER_SIZE,
           min_gp: int = K.LADDER_MIN_GP) -> DataFrame:
    """All-time ladder: 35 % production, 30 % honours, 25 % peak, 10 % titles, each 0-100 against the
    best qualified career of the league.

    What a career cannot have is dropped and the other weights are rescaled; ``data_gaps`` lists
    it.  The pool's ceilings are one row per league, joined on the league.
    """
    stats = list(K.PRODUCTION_WEIGHTS)
    pool_ = careers.filter(F.col("gp") >= min_gp)
    if "championships" not in careers.columns:
        pool_ = pool_.withColumn("championships", F.lit(None).cast("bigint"))
    if honours is None:
        pool_ = pool_.withColumn("points", F.lit(0.0)).withColumn("honours_total", F.lit(0))
    else:
        pool_ = pool_.join(honour_points(honours, table), list(PID), "left")
    pool_ = pool_.withColumn("points", nz("points")).withColumn("honours_total", nz("honours_total"))
    value = {s: F.greatest(nz(s).cast("double"), F.lit(0.0)) for s in stats}
    top = pool_.groupBy("league").agg(
        *[F.max(value[s]).alias(f"_t_{s}") for s in stats],
        *[F.max(ratio(value[s], "gp")).alias(f"_r_{s}") for s in stats],
        F.max("points").alias("_points"), F.max(nz("peak_impact")).alias("_peak"),
        F.max("championships").alias("_titles"))
    j = pool_.join(F.broadcast(top), "league")

    long_career = F.col("gp") >= K.ALLTIME_MIN_GP
    gap = {}
    for s in stats:
        none = (value[s] == 0) & long_career
        if s == "plus_minus":
            gap[s] = F.col(s).isNull()
        elif s in ("pts", "reb", "ast"):
            gap[s] = none
        else:
            gap[s] = none & (nz("fg3a") == 0)
    kept = {s: ~gap[s] & (F.col(f"_t_{s}") > 0) & (F.col(f"_r_{s}") > 0) for s in stats}
    blend = {s: F.lit(K.PRODUCTION_WEIGHTS[s]) * (
        F.lit(K.PRODUCTION_BLEND) * value[s] / F.col(f"_t_{s}")
        + F.lit(1 - K.PRODUCTION_BLEND) * (value[s] / F.col("gp")) / F.col(f"_r_{s}")) for s in stats}
    add = lambda cols: reduce(lambda a, b: a + b, cols, F.lit(0.0))
    num = add([F.when(kept[s], blend[s]).otherwise(0.0) for s in stats])
    den = add([F.when(kept[s], F.lit(K.PRODUCTION_WEIGHTS[s])).otherwise(0.0) for s in stats])
    j = j.withColumn("_production", F.coalesce(ratio(F.lit(100.0) * num, den), F.lit(0.0)))
    tracked = F.lit(honours is not None) & (F.col("_points") > 0)
    j = j.withColumn("_honours", F.when(tracked, F.lit(100.0) * F.col("points") / F.col("_points")))
    j = j.withColumn("_peak_score", F.when(nz("peak_impact") != 0, F.lit(100.0) * F.col("peak_impact") / F.col("_peak")))
    j = j.withColumn("_titles_score", F.when((nz("_titles") > 0) & F.col("championships").isNotNull(),
                                             F.lit(100.0) * F.col("championships") / F.col("_titles")))
    parts = {"production": "_production", "honours": "_honours", "peak": "_peak_score", "championships": "_titles_score"}
    top_sum = add([F.coalesce(F.lit(K.LADDER_WEIGHTS[k]) * F.col(c), F.lit(0.0)) for k, c in parts.items()])
    low_sum = add([F.when(F.col(c).isNotNull(), F.lit(K.LADDER_WEIGHTS[k])).otherwise(0.0) for k, c in parts.items()])
    gaps = F.array_compact(F.array(
        *[F.when(gap[s], F.lit(s)) for s in stats],
        *[F.when(F.col(parts[k]).isNull(), F.lit(k)) for k in ("honours", "peak", "championships")]))
    out = j.select(
        *PID, "player_name", "team_abbrev", F.coalesce("seasons", F.lit(0)).alias("seasons"), "gp",
        nz("pts").alias("pts"), nz("reb").alias("reb"), nz("ast").alias("ast"), "plus_minus",
        S.per_game("pts").alias("ppg"), half_up("points", 1).alias("honour_points"),
        half_up("_honours", 1).alias("honours_score"), "honours_total", "championships",
        half_up("_titles_score", 1).alias("championships_score"), half_up("_production", 1).alias("production"),
        half_up("_peak_score", 1).alias("peak_score"), half_up(nz("peak_impact"), 1).alias("peak_impact"),
        gaps.alias("data_gaps"), half_up(top_sum / low_sum, 1).alias("score"))
    return ranked(out, ["league"], board_order("score", "production"), size)


# --- index and views ---------------------------------------------------------------------------------

def player_index(entries: DataFrame, honours: DataFrame, table: DataFrame, board: DataFrame,
                 min_gp: int = K.ALLTIME_MIN_GP) -> DataFrame:
    """Profile index: entries with enough games or any honour, honour points, ladder place."""
    pts = honour_points(honours, table)
    placed = board.select(*PID, F.col("rank").alias("ladder_rank"), F.col("score").alias("ladder_score"))
    j = entries.join(pts, list(PID), "left").join(placed, list(PID), "left")
    return j.filter((F.col("gp") >= min_gp) | F.col("honours_total").isNotNull()).withColumn(
        "honour_points", half_up(nz("points"), 1)).withColumn("honours_total", nz("honours_total")).drop("points")


def career_sections(totals: DataFrame, careers: DataFrame, honours: DataFrame | None, table: DataFrame) -> dict[str, DataFrame]:
    """Window metadata, all-time boards and ladder of a league's history."""
    window = totals.groupBy("league").agg(
        F.min_by("season", "season_start").alias("first"), F.max_by("season", "season_start").alias("last"),
        F.countDistinct("season").alias("seasons"), F.countDistinct("player_id").alias("players"))
    return {"window": window, "alltime": alltime_boards(careers), "ladder": ladder(careers, honours, table)}


def career_teams(season_rows: DataFrame, show: int = 3) -> DataFrame:
    """Distinct teams in season order, the first ``show`` and '+N' for the rest."""
    first = season_rows.filter(F.coalesce(F.col("team_abbrev") != "", F.lit(False))).groupBy(*PID, "team_abbrev").agg(
        F.min("season_start").alias("since"))
    lists = first.groupBy(*PID).agg(F.array_sort(F.collect_list(F.struct("since", "team_abbrev"))).alias("_t"))
    names = F.transform("_t", lambda t: t["team_abbrev"])
    more = F.size("_t") - show
    return lists.select(*PID, F.concat(F.array_join(F.slice(names, 1, show), " · "), F.when(
        more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise("")).alias("teams"))


def progression_rows(log: DataFrame, metric: str, totals_mode: bool = False) -> DataFrame:
    """Rows that can be plotted: metric and season known, and games for totals."""
    out = log.filter(F.col(metric).isNotNull() & (F.coalesce("season", F.lit("")) != ""))
    return out.filter(nz("gp") != 0) if totals_mode and metric not in K.PERCENT_METRICS else out


def progression(log: DataFrame, metric: str, totals_mode: bool = False) -> DataFrame:
    """Value per season and its career year (1, 2, ... over plotted rows); totals are average x games."""
    rows = progression_rows(log, metric, totals_mode)
    value = F.col(metric).cast("double")
    if totals_mode and metric not in K.PERCENT_METRICS:
        value = half_up(value * F.col("gp"), 0)
    rows = rows.withColumn("value", value)
    return ranked(rows, PID, [F.asc("season"), F.asc("team")], None, "career_year").select(
        *PID, "season", "team", "gp", "value", "career_year")


# --- verified overlays as tables ---

def official_titles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("nba", p, t) for p, t in V.TITLES.items()],
                                 "league string, player_id bigint, titles bigint")


def official_rebounds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("nba", p, r) for p, r in V.CAREER_REBOUNDS.items()],
                                 "league string, player_id bigint, reb bigint")


def official_season_rebounds(spark: SparkSession) -> DataFrame:
    rows = [("nba", p, y, r) for p, years in V.SEASON_REBOUNDS.items() for y, r in years.items()]
    return spark.createDataFrame(rows, "league string, player_id bigint, year int, reb double")
