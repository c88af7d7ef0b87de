"""Season boards on the derived player-game table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scoring as S
from ..functions.core import half_up
from ..operators import boards as B
from ..operators import features as X
from ..sources.staging import partial_keys, stage
from . import bindings as D
from . import sqlparts as Q
from .registry import query

hu, pg = Q.hu, Q.pg
BY = "league, season, season_start"


def totals(spark, d):
    return B.player_totals(D.box(spark, d), parts=D.line_parts(spark, d))


def season_inputs(spark, d):
    t, r = totals(spark, d), B.team_records(D.games(spark, d))
    return t, r, B.qualifiers(r)


def rank_sql(src: str, by: str, order: str, k: int) -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank FROM ({src}) x_ "
            f"QUALIFY rank <= {k}")


_TOTAL_COLS = ", ".join(f'"{s}"' for s in K.SEASON_STATS)


@query("player_season_totals", f"""WITH {Q.BOX}, {Q.TOTALS}
SELECT {BY}, player_id, player_name, team_abbrev, gp, starts, minutes, {_TOTAL_COLS},
  {', '.join(f'{e} AS {n}' for n, e in Q.EFF.items())} FROM totals""")
def player_season_totals(spark, d):
    t = totals(spark, d)
    return t.select("*", *[c.alias(n) for n, c in S.efficiency().items()])


@query("team_records", f"WITH {Q.BOX}, {Q.GAMES}, {Q.RECORDS} SELECT * FROM records")
def team_records(spark, d):
    return B.team_records(D.games(spark, d))


@query("qualifiers", f"WITH {Q.SEASON} SELECT {BY}, max_games, min_gp FROM bars")
def qualifiers(spark, d):
    return B.qualifiers(B.team_records(D.games(spark, d)))


_EFFS = ", ".join(f"{e} AS {n}" for n, e in Q.EFF.items())
_LEAD = " UNION ALL ".join(
    f"""SELECT {BY}, player_id, player_name, team_abbrev, gp, {pg('minutes')} AS mpg, {pg('pts')} AS ppg,
  {pg('reb')} AS rpg, {pg('ast')} AS apg, {pg('stl')} AS spg, {pg('blk')} AS bpg, fgm, fga, fg3m, fg3a,
  {_EFFS}, '{s}' AS stat, "{s}" AS total, {pg(s)} AS per_game FROM qual""" for s in K.LEADER_STATS)


@query("season_leaders", f"WITH {Q.SEASON} " + rank_sql(
    _LEAD, f"{BY}, stat", "per_game DESC, total DESC, player_name, player_id", 10))
def season_leaders(spark, d):
    t, _, bars = season_inputs(spark, d)
    return B.stat_leaders(t, bars)


_MVP = f"""SELECT {BY}, player_id, player_name, team_abbrev, gp, {pg('pts')} AS ppg, {pg('reb')} AS rpg,
  {pg('ast')} AS apg, wins, losses, {hu('coalesce(win_pct,5e-1)', 3)} AS win_pct, {Q.EFF['fgp']} AS fgp,
  {hu(f'{Q.GS}/gp*(6e-1+4e-1*coalesce(win_pct,5e-1))', 2)} AS score
  FROM qual LEFT JOIN (SELECT {BY}, team_abbrev, wins, losses, win_pct FROM records) r
  USING ({BY}, team_abbrev)"""
_RANK_PPG = "score DESC, ppg DESC, player_name, player_id"
MVP_SQL = rank_sql(_MVP, BY, _RANK_PPG, 10)


@query("race_mvp", f"WITH {Q.SEASON} {MVP_SQL}")
def race_mvp(spark, d):
    return B.mvp(*season_inputs(spark, d))


_ROY = f"""SELECT {BY}, player_id, player_name, team_abbrev, gp, {pg('pts')} AS ppg, {pg('reb')} AS rpg,
  {pg('ast')} AS apg, {Q.EFF['fgp']} AS fgp, {hu(f'{Q.GS}/gp', 2)} AS score FROM qual
  WHERE season_start = 1995 + player_id % 7"""


@query("race_roy", f"WITH {Q.SEASON} " + rank_sql(_ROY, BY, _RANK_PPG, 10))
def race_roy(spark, d):
    t, _, bars = season_inputs(spark, d)
    return B.roy(t, bars, D.players(spark, d))


_DPOY = f"""SELECT {BY}, player_id, player_name, team_abbrev, gp, {pg('stl')} AS spg, {pg('blk')} AS bpg,
  {hu('(stl+blk)::DOUBLE/gp', 1)} AS stocks_pg, opp_pg,
  {hu('(stl+blk)::DOUBLE/gp*(6e-1+4e-1*coalesce(defence,5e-1))', 2)} AS score
  FROM qual LEFT JOIN (SELECT {BY}, team_abbrev, opp_pg,
    (count(*) OVER (PARTITION BY {BY}) - row_number() OVER (PARTITION BY {BY} ORDER BY opp_pg, team_abbrev) + 1)::DOUBLE
    / count(*) OVER (PARTITION BY {BY}) AS defence FROM records) r USING ({BY}, team_abbrev)"""
DPOY_SQL = rank_sql(_DPOY, BY, "score DESC, stocks_pg DESC, player_name, player_id", 10)


@query("race_dpoy", f"WITH {Q.SEASON} {DPOY_SQL}")
def race_dpoy(spark, d):
    return B.dpoy(*season_inputs(spark, d))


_SIXTH = f"""SELECT {BY}, player_id, player_name, team_abbrev, gp, starts, {hu('starts::DOUBLE/gp', 3)} AS start_pct,
  {pg('pts')} AS ppg, {pg('reb')} AS rpg, {pg('ast')} AS apg,
  {hu('(pts+5e-1*ast+25e-2*reb)/gp', 2)} AS score FROM qual WHERE starts::DOUBLE/gp <= 4e-1"""
SIXTH_SQL = rank_sql(_SIXTH, BY, _RANK_PPG, 10)


@query("race_sixth", f"WITH {Q.SEASON} {SIXTH_SQL}")
def race_sixth(spark, d):
    t, _, bars = season_inputs(spark, d)
    return B.sixth_man(t, bars)


_P36 = f"(CASE WHEN minutes<>0 THEN {Q.GS}*36e0/minutes ELSE 0e0 END)"
_MIP = f"""SELECT *, {hu('ppg-ppg_prev', 1)} AS delta_ppg FROM (SELECT n.league, n.season, n.season_start, n.player_id, n.player_name,
  n.team_abbrev, n.gp, p.gp AS gp_prev, n.ppg, n.rpg, n.apg, p.ppg AS ppg_prev, p.rpg AS rpg_prev,
  p.apg AS apg_prev, {hu('n.p36-p.p36', 2)} AS score
  FROM rates n JOIN rates p ON n.league=p.league AND n.player_id=p.player_id AND n.season_start=p.season_start+1)"""
MIP_CTE = f"""rates AS (SELECT *, {pg('pts')} AS ppg, {pg('reb')} AS rpg, {pg('ast')} AS apg, {_P36} AS p36
  FROM qual WHERE minutes>0)"""
MIP_SQL = rank_sql(_MIP, BY, "score DESC, delta_ppg DESC, player_name, player_id", 10)


@query("race_mip", f"WITH {Q.SEASON}, {MIP_CTE} {MIP_SQL}")
def race_mip(spark, d):
    t, _, bars = season_inputs(spark, d)
    return B.mip(t, bars)


_SER_BY = "league, season, series"
_SER = f"""
sgames AS (SELECT *, least(home_abbrev,away_abbrev)||'-'||greatest(home_abbrev,away_abbrev) AS series
  FROM games WHERE home_score<>0 AND away_score<>0),
sbox AS (SELECT b.*, g.series FROM box b JOIN sgames g USING (game_id)),
{Q.totals('sbox', _SER_BY, 'stot')},
srec AS (SELECT {_SER_BY}, team_abbrev, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses,
  {hu('(count(*) FILTER (won))::DOUBLE/count(*)', 3)} AS win_pct FROM (
   SELECT {_SER_BY}, home_abbrev AS team_abbrev, home_score>away_score AS won FROM sgames UNION ALL
   SELECT {_SER_BY}, away_abbrev, away_score>home_score FROM sgames) GROUP BY ALL),
sbar AS (SELECT {_SER_BY}, greatest(1,(count(*)+1)//2) AS min_gp FROM sgames GROUP BY ALL)"""
_SMVP = f"""SELECT {_SER_BY}, player_id, player_name, team_abbrev, gp, {pg('pts')} AS ppg, {pg('reb')} AS rpg,
  {pg('ast')} AS apg, wins, losses, {hu('coalesce(win_pct,5e-1)', 3)} AS win_pct, {Q.EFF['fgp']} AS fgp,
  {hu(f'{Q.GS}/gp*(6e-1+4e-1*coalesce(win_pct,5e-1))', 2)} AS score
  FROM stot JOIN sbar USING ({_SER_BY}) LEFT JOIN srec USING ({_SER_BY}, team_abbrev) WHERE gp>=min_gp"""


@query("series_mvp", f"WITH {Q.BOX}, {Q.GAMES}, {_SER} " + rank_sql(_SMVP, _SER_BY, _RANK_PPG, 10))
def series_mvp(spark, d):
    g = D.series_games(D.games(spark, d))
    by = ("league", "season", "series")
    b = D.box(spark, d).join(g.select("league", "season", "game_id", "series"), ["league", "season", "game_id"])
    with partial_keys(spark):  # rows and games lie by game
        return stage(B.series_mvp(b, g, by, parts=D.line_parts(spark, d)), "series_mvp")


@query("leaderboard", f"""WITH {Q.BOX}, {Q.TOTALS}, pick AS (SELECT max(season_start) AS s FROM totals),
opening AS (SELECT season_start AS s0, player_id AS p0, arg_min(team_abbrev, game_id::VARCHAR) AS first_team FROM box WHERE NOT did_not_play GROUP BY ALL)
SELECT {BY}, player_id, player_name, first_team AS team_abbrev, gp, starts, minutes,
  {', '.join(f'"{s}"' for s in K.CAREER_STATS)}, {Q.wsum(K.FANTASY_WEIGHTS)} AS fantasy_points, {_EFFS}
  FROM totals JOIN opening ON season_start=s0 AND player_id=p0, pick WHERE season_start = s""")
def leaderboard(spark, d):
    """Totals of the newest season that has games (try-order: newest first)."""
    box = D.box(spark, d)
    orders = D.table(spark, d, "orders").select(
        F.lit(D.LEAGUE).alias("league"), F.year("o_orderdate").cast("string").alias("season"),
        (-F.year("o_orderdate")).alias("priority")).distinct()
    return B.season_leaderboard(B.first_season_with_rows(box, orders), parts=D.line_parts(spark, d))


_RACES = {
    "mvp": (MVP_SQL), "dpoy": DPOY_SQL, "sixth_man": SIXTH_SQL, "mip": MIP_SQL,
    "roy": rank_sql(_ROY, BY, _RANK_PPG, 10)}
RACES_SQL = " UNION ALL ".join(
    f"SELECT {BY}, '{r}' AS race, rank, player_id, player_name, team_abbrev, gp, score FROM ({s}) r_{r}"
    for r, s in _RACES.items())


@query("season_races", f"WITH {Q.SEASON}, {MIP_CTE} {RACES_SQL}")
def season_races(spark, d):
    t, r, _ = season_inputs(spark, d)
    return B.season_races(t, r, D.players(spark, d))


_FP = Q.wsum(K.FANTASY_WEIGHTS)


def fact(spark, d):
    """The player-game fact, written once per query: several branches read it."""
    with partial_keys(spark):  # both sides lie by game
        return stage(X.player_games(D.box(spark, d), D.games(spark, d), D.players(spark, d)), "player_games")


def scored(spark, d):
    return S.fantasy_points(D.box(spark, d))


@query("score_trend", f"""WITH {Q.BOX} SELECT {BY}, {hu(f'avg({_FP})', 6)} AS mean_score
FROM box WHERE "min">0 GROUP BY ALL""")
def score_trend(spark, d):
    return B.score_trend(scored(spark, d)).withColumn("mean_score", half_up("mean_score", 6))


@query("position_quantiles", f"""WITH {Q.BOX}, p AS (SELECT
  CASE player_id%4 WHEN 0 THEN 'G' WHEN 1 THEN 'F' WHEN 2 THEN 'C' END AS position, {_FP} AS v
  FROM box WHERE "min">0)
SELECT position, min(v) AS low, quantile_cont(v,0.25) AS q1, quantile_cont(v,0.5) AS median,
  quantile_cont(v,0.75) AS q3, max(v) AS high FROM p WHERE position IS NOT NULL GROUP BY ALL""")
def position_quantiles(spark, d):
    rows = X.with_positions(scored(spark, d), D.players(spark, d))
    return B.score_quantiles(rows.filter(F.col("position").isin("G", "F", "C")))


@query("minutes_fit", f"""WITH {Q.BOX}, p AS (SELECT "min"::DOUBLE AS x, {_FP} AS y FROM box WHERE "min">0)
SELECT {hu('regr_slope(y,x)', 6)} AS slope, {hu('regr_intercept(y,x)', 6)} AS intercept,
  {hu('regr_r2(y,x)', 6)} AS r2, count(*) AS n FROM p""")
def minutes_fit(spark, d):
    fit = B.minutes_fit(scored(spark, d))
    return fit.select(*[half_up(c, 6).alias(c) for c in ("slope", "intercept", "r2")], "n")


@query("dataset_summary", f"""WITH {Q.BOX} SELECT count(*) AS n_rows, count(DISTINCT season) AS n_seasons,
  count(DISTINCT game_id) AS n_games, {hu('avg(CASE WHEN "min">0 THEN 1e0 ELSE 0e0 END)', 6)} AS share_played FROM box""")
def dataset_summary(spark, d):
    return B.dataset_summary(D.box(spark, d))


@query("kpi_strip", f"""WITH {Q.SEASON},
c AS (SELECT {BY}, count(DISTINCT game_id) AS games_collected FROM box GROUP BY ALL),
n AS (SELECT {BY}, min(ts)::DATE AS next_tip FROM games WHERE status<>'STATUS_FINAL' AND ts>=TIMESTAMP '1999-07-01' GROUP BY ALL),
t AS (SELECT {BY}, player_id AS top_player_id, player_name AS top_player_name, {pg('pts')} AS top_ppg FROM qual
  QUALIFY row_number() OVER (PARTITION BY {BY} ORDER BY {pg('pts')} DESC, pts DESC, player_name, player_id)=1)
SELECT * FROM c LEFT JOIN n USING ({BY}) LEFT JOIN t USING ({BY})""")
def kpi_strip(spark, d):
    t, _, bars = season_inputs(spark, d)
    out = B.kpi_strip(D.box(spark, d), D.games(spark, d), t, bars, "1999-07-01")
    return out.withColumn("next_tip", F.to_date("next_tip"))
