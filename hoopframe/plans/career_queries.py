"""Careers on the derived tables.

The 'history' input is derived too: every player id with id % 3 != 2 has season rows, every
id % 3 = 0 a full career line; the collected window is the seasons from 1998 on.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.core import half_up, ratio
from ..operators import boards as B
from ..operators import careers as C
from ..sources.staging import stage
from . import bindings as D
from . import sqlparts as Q
from .board_queries import totals
from .registry import query

hu, pg = Q.hu, Q.pg
WINDOW_FROM = 1998
END_YEAR = 2002
STATS = K.CAREER_STATS


def points_table(spark):
    return C.honour_table(spark, {D.LEAGUE: D.AWARD_POINTS})


def staged_totals(spark, d):
    """Player-season totals, written once: careers read them from several branches."""
    return stage(totals(spark, d), "totals")


def window_careers(t):
    return C.career_totals(t.filter(F.col("season_start") >= WINDOW_FROM))


def champions(spark, d):
    """Team with most wins per season (end year), numbered by its abbreviation."""
    r = B.team_records(D.games(spark, d))
    best = r.groupBy("league", "season_start").agg(
        F.min_by("team_abbrev", F.struct(-F.col("wins"), "team_abbrev")).alias("team_abbrev"))
    return best.select("league", (F.col("season_start") + 1).alias("year"), team_number().alias("team_id"))


def team_number():
    return F.substring("team_abbrev", 2, 9).cast("bigint")


def bundles(t, spark, d, fields=None):
    """History documents per player (a career has one struct per season).

    ``fields`` names what the reader takes of a season row; the career line, which needs every stat, is then left out.
    """
    k = F.col("player_id")
    avg = lambda s: half_up(ratio(s, "gp"), 1)
    pct = lambda m, a: F.coalesce(half_up(ratio(F.lit(100.0) * F.col(m), a), 1), F.lit(0.0))
    row = {"year": lambda: F.col("season_start") + 1, "team_id": team_number, "team": lambda: F.col("team_abbrev"),
           "gp": lambda: F.col("gp"), "min": lambda: avg("minutes"),
           **{s: (lambda s=s: avg(s)) for s in ("pts", "reb", "ast", "stl", "blk")},
           "fg_pct": lambda: pct("fgm", "fga"), "fg3_pct": lambda: pct("fg3m", "fg3a")}
    rows = F.array_sort(F.collect_list(F.struct(*[row[f]().alias(f) for f in fields or row])))
    per = t.groupBy("league", "player_id").agg(rows.alias("rows"), *[F.sum(c).alias(c) for c in C.LINE if not fields])
    p = D.players(spark, d).select("league", "player_id", F.col("player_name").alias("name"),
                                   (F.col("debut") - 2).alias("debut"), "position")
    line = [] if fields else [F.when(k % 3 == 0, F.struct(*C.LINE)).alias("line")]
    return per.filter(k % 3 != 2).join(p, ["league", "player_id"]).select(
        "league", "player_id", "name", "debut", "position", F.lit(None).cast("string").alias("jersey"),
        F.lit(None).cast("string").alias("team"), "rows", *line)


def entries(spark, d, t=None):
    t = staged_totals(spark, d) if t is None else t
    h = C.honours_per_player(D.award_wins(spark, d))
    w = window_careers(t)
    ids = C.pool(None, h, w)
    return C.career_entries(ids, bundles(t, spark, d), w, champions(spark, d), END_YEAR)


def merged(spark, d):
    t = staged_totals(spark, d)
    return stage(C.merge_history(entries(spark, d, t).drop("seasons_log"), window_careers(t)), "careers")


# --- SQL ---------------------------------------------------------------------------------------

def careers_sql(name: str, where: str) -> str:
    sums = ", ".join(f'sum("{s}")::BIGINT AS "{s}"' for s in ("gp", "starts", "minutes", *STATS))
    return f"""{name} AS (SELECT league, player_id, arg_min(player_name, season_start) AS player_name,
      arg_max(team_abbrev, season_start) AS team_abbrev, count(*) AS seasons, {sums},
      greatest(max((pts+75e-2*reb+ast)/gp), 0e0) AS peak_impact FROM totals WHERE {where} GROUP BY ALL)"""


AW = """aw AS (SELECT 'nba' AS league, year(l_shipdate) AS year, p_type AS name, l_suppkey AS player_id FROM lineitem
  JOIN part ON l_partkey=p_partkey WHERE l_quantity=50 AND floor(l_discount*100+5e-1)=10),
hw AS (SELECT league, player_id, name, count(*) AS wins FROM aw GROUP BY ALL),
ptab AS (SELECT * FROM (VALUES """ + ", ".join(f"('{n}', {Q.num(p)})" for n, p in D.AWARD_POINTS.items()) + """) v(name, pts_each)),
hp AS (SELECT league, player_id, sum(coalesce(pts_each,0e0)*wins) AS points, sum(wins)::BIGINT AS honours_total FROM hw LEFT JOIN ptab USING (name) GROUP BY ALL)"""
CHAMP = """champ AS (SELECT league, season_start+1 AS year, substr(team_abbrev,2)::BIGINT AS team_id FROM records
  QUALIFY row_number() OVER (PARTITION BY league, season_start ORDER BY wins DESC, team_abbrev)=1)"""
_avg = lambda s: hu(f'"{s}"::DOUBLE/gp', 1)
HROWS = f"""hr AS (SELECT league, player_id, season_start+1 AS year, season_start, substr(team_abbrev,2)::BIGINT AS team_id, team_abbrev AS team, gp,
  {_avg('minutes')} AS min_pg, {', '.join(f'{_avg(s)} AS {s}' for s in ('pts', 'reb', 'ast', 'stl', 'blk'))} FROM totals WHERE player_id%3<>2),
ht AS (SELECT h.league, h.player_id, min(h.year) AS first_year, count(*) AS n_rows,
  count(*) FILTER (h.year<{END_YEAR}) AS done, count(*) FILTER (h.year<{END_YEAR} AND c.team_id IS NULL) AS open_years,
  count(*) FILTER (c.team_id=h.team_id) AS won, max(pts+75e-2*reb+ast) AS peak
  FROM hr h LEFT JOIN champ c ON c.year=h.year GROUP BY ALL),
bu AS (SELECT *, 1993+player_id%7 AS debut, first_year <= 1993+player_id%7+1 AS ok FROM ht)"""
_lsum = ", ".join(f'sum("{c}")::BIGINT AS "{c}"' for c in C.LINE)
ENTRIES = f"""{careers_sql('win', f'season_start>={WINDOW_FROM}')},
hline AS (SELECT league, player_id, {_lsum} FROM totals WHERE player_id%3=0 GROUP BY ALL),
pool AS (SELECT league, player_id FROM hw UNION SELECT league, player_id FROM win WHERE gp>=41),
ent AS (SELECT p.league, p.player_id, coalesce(s.s_name, w.player_name) AS player_name, w.team_abbrev,
  CASE WHEN b.ok THEN b.n_rows WHEN b.n_rows>0 THEN NULL ELSE w.seasons END AS seasons,
  {', '.join(f'CASE WHEN h.player_id IS NOT NULL THEN h."{c}" ELSE w."{c}" END AS "{c}"' for c in C.LINE)}, w.plus_minus,
  coalesce(CASE WHEN b.ok THEN nullif({hu('b.peak', 1)},0) END, w.peak_impact) AS peak_impact,
  CASE WHEN b.ok AND b.first_year>=1970 AND b.done>0 AND b.open_years=0 THEN b.won END AS championships,
  CASE WHEN h.player_id IS NOT NULL THEN 'history' ELSE 'window' END AS line_source,
  b.debut, CASE WHEN b.player_id IS NOT NULL THEN CASE p.player_id%4 WHEN 0 THEN 'G' WHEN 1 THEN 'F' WHEN 2 THEN 'C' END END AS position
  FROM pool p LEFT JOIN bu b USING (league, player_id) LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey%3<>2) s ON s.s_suppkey=p.player_id
  LEFT JOIN hline h ON h.player_id=p.player_id LEFT JOIN win w ON w.player_id=p.player_id WHERE h.player_id IS NOT NULL OR w.player_id IS NOT NULL)"""
HIST = f"{Q.BOX}, {Q.GAMES}, {Q.TOTALS}, {Q.RECORDS}, {AW}, {CHAMP}, {HROWS}, {ENTRIES}"
ECOLS = (*C.LINE, "plus_minus", "championships")
MERGED = f"""mer AS (SELECT * FROM ent UNION ALL BY NAME SELECT league, player_id, player_name, team_abbrev, seasons,
  {', '.join(f'"{c}"' for c in (*C.LINE, 'plus_minus'))}, peak_impact, 'window' AS line_source FROM win WHERE player_id NOT IN (SELECT player_id FROM ent))"""


@query("career_totals", f"WITH {Q.BOX}, {Q.TOTALS}, {careers_sql('car', 'TRUE')} SELECT * FROM car")
def career_totals(spark, d):
    return C.career_totals(totals(spark, d))


_CR = f"""cr AS (SELECT league, player_id, player_name, team_abbrev, seasons, gp, minutes, {pg('pts')} AS ppg, {pg('reb')} AS rpg, {pg('ast')} AS apg,
  {', '.join(f'"{s}"' for s in K.LINE_STATS)}, plus_minus, {', '.join(f'{e} AS {n}' for n, e in Q.EFF.items())} FROM car WHERE gp>=41)"""
_ALL = " UNION ALL ".join(
    [f"SELECT *, '{s}' AS category, \"{s}\"::DOUBLE AS value, ppg AS tie FROM cr WHERE \"{s}\" IS NOT NULL" for s in K.LEADER_STATS]
    + [f"SELECT *, '{c}' AS category, {c} AS value, {a}::DOUBLE AS tie FROM cr WHERE {a}::DOUBLE/gp >= {Q.num(f)} AND {c} IS NOT NULL"
       for c, (a, f) in K.ATTEMPT_FLOORS.items()])


@query("alltime_boards", f"""WITH {Q.BOX}, {Q.TOTALS}, {careers_sql('car', 'TRUE')}, {_CR},
r AS (SELECT *, row_number() OVER (PARTITION BY league, category ORDER BY value DESC, tie DESC, player_name, player_id) AS rank FROM ({_ALL}) q_)
SELECT * EXCLUDE (tie) FROM r WHERE rank<=25""")
def alltime_boards(spark, d):
    return C.alltime_boards(C.career_totals(totals(spark, d)))


@query("honours", f"WITH {AW} SELECT league, player_id, {hu('points', 1)} AS points, honours_total FROM hp")
def honours(spark, d):
    h = C.honours_per_player(D.award_wins(spark, d))
    return C.honour_points(h, points_table(spark)).withColumn("points", half_up("points", 1))


@query("titles", f"""WITH {Q.BOX}, {Q.GAMES}, {Q.TOTALS}, {Q.RECORDS}, {CHAMP}, {HROWS}
SELECT league, player_id, CASE WHEN ok AND first_year>=1970 AND done>0 AND open_years=0 THEN won END AS championships FROM bu""")
def titles(spark, d):
    t = stage(totals(spark, d).select("league", "player_id", "season_start", "team_abbrev"), "totals")
    return C.titles(bundles(t, spark, d, ("year", "team_id")), champions(spark, d), END_YEAR)


_EOUT = f"""league, player_id, player_name, team_abbrev, seasons, {', '.join(f'"{c}"' for c in ECOLS)}, {hu('peak_impact', 4)} AS peak_impact, line_source, debut, position"""


def _entry_cols(df):
    return df.select("league", "player_id", "player_name", "team_abbrev", "seasons", *ECOLS,
                     half_up("peak_impact", 4).alias("peak_impact"), "line_source", "debut", "position")


@query("career_entries", f"WITH {HIST} SELECT {_EOUT} FROM ent")
def career_entries(spark, d):
    return _entry_cols(entries(spark, d))


@query("career_overlay", f"WITH {HIST}, {MERGED} SELECT {_EOUT} FROM mer")
def career_overlay(spark, d):
    return _entry_cols(merged(spark, d))


_ps = list(K.PRODUCTION_WEIGHTS)
_v = lambda s: f'greatest(coalesce("{s}",0)::DOUBLE,0e0)'


def _gap(s: str) -> str:
    if s == "plus_minus":
        return "plus_minus IS NULL"
    return f"({_v(s)}=0 AND gp>=41" + (")" if s in ("pts", "reb", "ast") else " AND coalesce(fg3a,0)=0)")


_kept = lambda s: f"(NOT ({_gap(s)}) AND t_{s}>0 AND r_{s}>0)"
_blend = lambda s: f"({Q.num(K.PRODUCTION_WEIGHTS[s])}*(5e-1*{_v(s)}/t_{s}+5e-1*({_v(s)}/gp)/r_{s}))"
_parts = {"production": "p0", "honours": "h0", "peak": "k0", "championships": "c0"}
LADDER = f"""lq AS (SELECT m.*, coalesce(points,0e0) AS points, coalesce(honours_total,0) AS honours_total FROM mer m LEFT JOIN hp USING (league, player_id) WHERE gp>=82),
lt AS (SELECT league, {', '.join(f'max({_v(s)}) AS t_{s}, max({_v(s)}/gp) AS r_{s}' for s in _ps)}, max(points) AS mp, max(coalesce(peak_impact,0)) AS mk, max(championships) AS mt FROM lq GROUP BY ALL),
l1 AS (SELECT *, coalesce(100e0*({'+'.join(f'CASE WHEN {_kept(s)} THEN {_blend(s)} ELSE 0e0 END' for s in _ps)})/nullif({'+'.join(f'CASE WHEN {_kept(s)} THEN {Q.num(K.PRODUCTION_WEIGHTS[s])} ELSE 0e0 END' for s in _ps)},0),0e0) AS p0,
  CASE WHEN mp>0 THEN 100e0*points/mp END AS h0, CASE WHEN coalesce(peak_impact,0)<>0 THEN 100e0*peak_impact/mk END AS k0,
  CASE WHEN coalesce(mt,0)>0 AND championships IS NOT NULL THEN 100e0*championships/mt END AS c0 FROM lq JOIN lt USING (league)),
l2 AS (SELECT league, player_id, player_name, team_abbrev, coalesce(seasons,0) AS seasons, gp, pts, reb, ast, plus_minus, {pg('pts')} AS ppg, {hu('points', 1)} AS honour_points,
  {hu('h0', 1)} AS honours_score, honours_total, championships, {hu('c0', 1)} AS championships_score, {hu('p0', 1)} AS production, {hu('k0', 1)} AS peak_score,
  {hu('coalesce(peak_impact,0)', 1)} AS peak_impact,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {_gap(s)} THEN '{s}' END" for s in _ps)}, {', '.join(f"CASE WHEN {_parts[k]} IS NULL THEN '{k}' END" for k in ('honours', 'peak', 'championships'))}], lambda x: x IS NOT NULL), ',') AS data_gaps,
  {hu('(' + '+'.join(f'coalesce({Q.num(K.LADDER_WEIGHTS[k])}*{c},0e0)' for k, c in _parts.items()) + ')/(' + '+'.join(f'CASE WHEN {c} IS NOT NULL THEN {Q.num(K.LADDER_WEIGHTS[k])} ELSE 0e0 END' for k, c in _parts.items()) + ')', 1)} AS score FROM l1),
lad AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY score DESC, production DESC, player_name, player_id) AS rank FROM l2 QUALIFY rank<=25)"""


def ladder_of(careers, spark, d):
    h = C.honours_per_player(D.award_wins(spark, d))
    return C.ladder(careers, h, points_table(spark))


@query("ladder", f"WITH {HIST}, {MERGED}, {LADDER} SELECT * FROM lad")
def ladder(spark, d):
    return ladder_of(merged(spark, d), spark, d).withColumn("data_gaps", F.array_join("data_gaps", ","))


@query("player_index", f"""WITH {HIST}, {MERGED}, {LADDER}
SELECT e.league, e.player_id, e.player_name, e.gp, e.championships, {hu('coalesce(points,0)', 1)} AS honour_points, coalesce(p.honours_total,0) AS honours_total,
  l.rank AS ladder_rank, l.score AS ladder_score FROM ent e LEFT JOIN hp p ON p.player_id=e.player_id LEFT JOIN lad l ON l.player_id=e.player_id
  WHERE e.gp>=41 OR p.player_id IS NOT NULL""")
def player_index(spark, d):
    t = staged_totals(spark, d)
    e = stage(entries(spark, d, t), "entries")
    m = C.merge_history(e.drop("seasons_log"), window_careers(t))
    h = C.honours_per_player(D.award_wins(spark, d))
    out = C.player_index(e, h, points_table(spark), ladder_of(m, spark, d))
    return out.select("league", "player_id", "player_name", "gp", "championships", "honour_points",
                      "honours_total", "ladder_rank", "ladder_score")


_PICK = ("Supplier#000000003", "Supplier#000000005", "Supplier#000000008")


@query("accolades_pivot", f"""WITH {AW}, n AS (SELECT s_suppkey AS player_id, s_name FROM supplier)
SELECT h.league, h.name, coalesce(max(pts_each),0e0) AS points, {', '.join(f"sum(wins) FILTER (s_name='{p}')::BIGINT AS \"{p}\"" for p in _PICK)}
FROM hw h JOIN n USING (player_id) LEFT JOIN ptab USING (name) WHERE s_name IN ({', '.join(f"'{p}'" for p in _PICK)}) GROUP BY ALL""")
def accolades_pivot(spark, d):
    h = C.honours_per_player(D.award_wins(spark, d))
    return C.accolades_pivot(h, D.players(spark, d), _PICK, points_table(spark))


@query("progression", f"""WITH {Q.BOX}, {Q.TOTALS}, p AS (SELECT league, player_id, season, team_abbrev AS team, gp, {hu('pts::DOUBLE/gp', 1)} AS v FROM totals)
SELECT league, player_id, season, team, gp, floor(v*gp+5e-1) AS value, row_number() OVER (PARTITION BY league, player_id ORDER BY season, team) AS career_year FROM p""")
def progression(spark, d):
    log = totals(spark, d).select("league", "player_id", "season", F.col("team_abbrev").alias("team"), "gp",
                                  half_up(ratio("pts", "gp"), 1).alias("pts"))
    return C.progression(log, "pts", totals_mode=True)


@query("career_teams", f"""WITH {Q.BOX}, {Q.TOTALS}, f AS (SELECT league, player_id, team_abbrev, min(season_start) AS since FROM totals GROUP BY ALL),
g AS (SELECT league, player_id, list(team_abbrev ORDER BY since, team_abbrev) AS t FROM f GROUP BY ALL)
SELECT league, player_id, array_to_string(t[1:3], ' · ') || CASE WHEN len(t)>3 THEN ' +'||(len(t)-3)::VARCHAR ELSE '' END AS teams FROM g""")
def career_teams(spark, d):
    return C.career_teams(totals(spark, d))


@query("history_meta", f"""WITH {HIST} SELECT 'nba' AS league, (SELECT count(*) FROM pool) AS pool,
 (SELECT count(*) FROM ent WHERE line_source='history') AS history_lines, (SELECT count(*) FROM ent WHERE line_source='window') AS window_lines,
 count(DISTINCT player_id) AS honoured_players, count(*) AS honour_wins, count(DISTINCT name) AS award_types, count(DISTINCT (name, year)) AS award_seasons,
 (SELECT count(*) FROM champ) AS champion_years FROM aw""")
def history_meta(spark, d):
    t = staged_totals(spark, d)
    wins = D.award_wins(spark, d)
    ids = C.pool(None, C.honours_per_player(wins), window_careers(t))
    return C.history_meta(entries(spark, d, t), ids, wins, champions(spark, d))


@query("career_window", f"""WITH {Q.BOX}, {Q.TOTALS} SELECT league, arg_min(season, season_start) AS first, arg_max(season, season_start) AS last,
 count(DISTINCT season) AS seasons, count(DISTINCT player_id) AS players FROM totals GROUP BY ALL""")
def career_window(spark, d):
    t = totals(spark, d)
    return C.career_sections(t, C.career_totals(t), None, points_table(spark))["window"]


# --- verified overlays and board leaders -------------------------------------------------------------------------

def replaced(sql: str, *pairs: tuple[str, str]) -> str:
    """SQL with parts replaced; each must be there."""
    for old, new in pairs:
        if old not in sql:
            raise ValueError(f"not in the SQL: {old}")
        sql = sql.replace(old, new)
    return sql


_TOPS = f"""{careers_sql('car', 'TRUE')}, {_CR}, tops AS (SELECT DISTINCT league, player_id FROM (SELECT *, row_number() OVER
  (PARTITION BY league, category ORDER BY value DESC, tie DESC, player_name, player_id) AS rank FROM ({_ALL}) q_) b_ WHERE rank<=25)"""
_VROWS = replaced(HROWS, (f"{_avg('reb')} AS reb", f"CASE WHEN player_id%6=0 THEN 55e-1 ELSE {_avg('reb')} END AS reb"))
_VENTRIES = replaced(ENTRIES, ("FROM win WHERE gp>=41)", "FROM win WHERE gp>=41 UNION SELECT league, player_id FROM tops)"),
                     ('THEN h."reb" ELSE', 'THEN CASE WHEN p.player_id%9=0 THEN 1000+p.player_id ELSE h."reb" END ELSE'),
                     ("CASE WHEN b.ok AND b.first_year>=1970", "CASE WHEN p.player_id%10=3 THEN p.player_id%4 WHEN b.ok AND b.first_year>=1970"))
_VERIFIED = f"{Q.BOX}, {Q.GAMES}, {Q.TOTALS}, {Q.RECORDS}, {AW}, {CHAMP}, {_VROWS}, {_TOPS}, {_VENTRIES}"


def verified_entries(spark, d, t):
    """Entries of honoured, window and board-leading players; careers whose rebounds are 0 (every ninth line, every
    sixth player's seasons) take the official ones, every tenth player the official titles."""
    k = F.col("player_id")
    b = bundles(t, spark, d)
    b = b.withColumns({"rows": F.transform("rows", lambda r: r.withField("reb", F.when(k % 6 == 0, 0.0).otherwise(r["reb"]))),
                       "line": F.when(F.col("line").isNotNull(), F.col("line").withField("reb", F.when(k % 9 == 0, 0).otherwise(F.col("line.reb"))))})
    p = D.players(spark, d).select("league", "player_id")
    titles_ = p.where(k % 10 == 3).withColumn("titles", k % 4)
    rebounds = p.where(k % 9 == 0).withColumn("reb", 1000 + k)
    seasons = t.where(k % 6 == 0).select("league", "player_id", (F.col("season_start") + 1).alias("year"), F.lit(5.5).alias("reb"))
    w = window_careers(t)
    leaders = C.alltime_boards(C.career_totals(t)).select("league", "player_id").distinct()
    ids = C.pool(leaders, C.honours_per_player(D.award_wins(spark, d)), w)
    return stage(C.career_entries(ids, b, w, champions(spark, d), END_YEAR, titles_, rebounds, seasons), "entries")


@query("career_entries_verified", f"WITH {_VERIFIED} SELECT {_EOUT} FROM ent")
def career_entries_verified(spark, d):
    return _entry_cols(verified_entries(spark, d, staged_totals(spark, d)))


@query("ladder_verified", f"WITH {_VERIFIED}, {MERGED}, {LADDER} SELECT * FROM lad")
def ladder_verified(spark, d):
    t = staged_totals(spark, d)
    m = C.merge_history(verified_entries(spark, d, t).drop("seasons_log"), window_careers(t))
    return ladder_of(m, spark, d).withColumn("data_gaps", F.array_join("data_gaps", ","))
