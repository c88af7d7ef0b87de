"""Features, projections, line-ups and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.core import first_by, half_up
from ..operators import boards as B
from ..operators import features as X
from ..operators import lineup as L
from ..operators import projections as P
from ..sources.staging import stage
from . import bindings as D
from . import sqlparts as Q
from .board_queries import fact, season_inputs, totals
from .registry import query

hu, pg = Q.hu, Q.pg
FP = Q.wsum(K.FANTASY_WEIGHTS)
ORD = "season_start, ts, game_id"
WP = f"PARTITION BY league, player_id ORDER BY {ORD}"
KEYS = "game_id, player_id"

FACT = f"""
fact AS (SELECT b.*, CASE WHEN b.is_home THEN g.home_score ELSE g.away_score END::DOUBLE AS team_score,
  CASE WHEN b.is_home THEN g.away_score ELSE g.home_score END::DOUBLE AS opp_score,
  {FP} AS fantasy_points, (coalesce("min",0)>0)::INT AS played
  FROM box b JOIN games g USING (league, season, season_start, game_id, ts))"""
_ROLL = [(f"{s}_avg_last_{n}", s, n) for n in K.ROLLING_WINDOWS for s in K.ROLLING_STATS]
_ROLL_SQL = ", ".join(
    f'{hu(f"""avg("{s}") OVER ({WP} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)""", 6)} AS "{c}"' for c, s, n in _ROLL)
_AVAIL_SQL = f"""lag("min") OVER ({WP}) AS minutes_last_game,
  (coalesce(lag("min") OVER ({WP}),0)>0)::INT AS played_last_game,
  sum(CASE WHEN "min" IS NOT NULL THEN ("min">0)::INT::DOUBLE END) OVER ({WP} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS games_played_last_5,
  greatest(floor((epoch(ts)-epoch(lag(ts) OVER ({WP})))/86400)::BIGINT-1, 0) AS rest_days_,
  coalesce((floor((epoch(ts)-epoch(lag(ts) OVER ({WP})))/86400)=1)::INT,0) AS back_to_back,
  lag(ts) OVER ({WP}) AS prev_ts"""
_COUNTS_SQL = f"""row_number() OVER ({WP})-1 AS career_game_count,
  row_number() OVER (PARTITION BY league, player_id, season_start ORDER BY ts, game_id)-1 AS season_game_count"""
_REST = "CASE WHEN prev_ts IS NOT NULL THEN rest_days_ END AS rest_days"
ROLL_COLS = [c for c, _, _ in _ROLL]
AVAIL_COLS = ["minutes_last_game", "played_last_game", "games_played_last_5", "rest_days", "back_to_back"]


def six(df, cols):
    """Rounded copies of float columns, for comparison with another engine."""
    return df.select(*[half_up(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def form(spark, d):
    return X.player_form(fact(spark, d))


@query("rolling_form", f"""WITH {Q.BOX}, {Q.GAMES}, {FACT}
SELECT {KEYS}, {_ROLL_SQL}, {_COUNTS_SQL} FROM fact""")
def rolling_form(spark, d):
    return six(form(spark, d).select("game_id", "player_id", *ROLL_COLS, "career_game_count", "season_game_count"), ROLL_COLS)


@query("availability", f"""WITH {Q.BOX}, {Q.GAMES}, {FACT}, a AS (SELECT {KEYS}, {_AVAIL_SQL} FROM fact)
SELECT {KEYS}, minutes_last_game, played_last_game, games_played_last_5, back_to_back, {_REST} FROM a""")
def availability(spark, d):
    return form(spark, d).select("game_id", "player_id", *AVAIL_COLS)


TEAMFORM = f"""
tg AS (SELECT league, season, season_start, game_id, team_id, min(ts) AS ts, min(team_score) AS team_score, min(opp_score) AS opp_score
  FROM fact GROUP BY ALL HAVING min(is_home)=max(is_home)),
tf AS (SELECT *, {hu(f'avg(team_score) OVER (PARTITION BY league, team_id ORDER BY {ORD} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)', 6)} AS pf,
  {hu(f'avg(opp_score) OVER (PARTITION BY league, team_id ORDER BY {ORD} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)', 6)} AS pa FROM tg)"""
_TF_JOIN = """LEFT JOIN tf o ON o.league=f.league AND o.season=f.season AND o.game_id=f.game_id AND o.team_id=f.team_id
  LEFT JOIN tf p ON p.league=f.league AND p.season=f.season AND p.game_id=f.game_id AND p.team_id=f.opponent_id"""
TF_COLS = ["team_form_pf", "team_form_pa", "opp_form_pf", "opp_form_pa"]
_TF_SQL = "o.pf AS team_form_pf, o.pa AS team_form_pa, p.pf AS opp_form_pf, p.pa AS opp_form_pa"


@query("team_form", f"WITH {Q.BOX}, {Q.GAMES}, {FACT}, {TEAMFORM} SELECT f.game_id, f.player_id, {_TF_SQL} FROM fact f {_TF_JOIN}")
def team_form(spark, d):
    return six(X.with_team_form(fact(spark, d)).select("game_id", "player_id", *TF_COLS), TF_COLS)


BASE = f"""
dm AS (SELECT league, season, season_start, ts::DATE AS slot, avg(fantasy_points) AS m FROM fact GROUP BY ALL),
bl AS (SELECT league, season, slot, {hu('avg(m) OVER (PARTITION BY league ORDER BY season_start, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 6)} AS new_player_baseline FROM dm)"""


@query("entity_baseline", f"WITH {Q.BOX}, {Q.GAMES}, {FACT}, {BASE} SELECT * FROM bl")
def entity_baseline(spark, d):
    return six(X.baseline(fact(spark, d)), ["new_player_baseline"])


@query("entity_baseline_instant", f"""WITH ev AS (SELECT 'wnba' AS league, year(ts)::VARCHAR AS season, year(ts) AS season_start, ts,
    CASE WHEN event_type='error' THEN 0 ELSE floor(value+5e-1) END AS score FROM events),
  dm AS (SELECT league, season, season_start, ts AS slot, avg(score) AS m FROM ev GROUP BY ALL)
SELECT league, season, epoch_us(slot) AS slot_us, {hu('avg(m) OVER (PARTITION BY league ORDER BY season_start, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 6)} AS new_player_baseline FROM dm""")
def entity_baseline_instant(spark, d):
    """The instant grain: every tip-off time is its own slot."""
    b = six(X.baseline(D.event_log(spark, d), "score", "instant"), ["new_player_baseline"])
    return b.select("league", "season", F.unix_micros("slot").alias("slot_us"), "new_player_baseline")


@query("feature_table", f"""WITH {Q.BOX}, {Q.GAMES}, {FACT}, {TEAMFORM}, {BASE},
w AS (SELECT *, {_ROLL_SQL}, {_COUNTS_SQL}, {_AVAIL_SQL} FROM fact)
SELECT f.game_id, f.player_id, f.fantasy_points, f.is_home::INT AS is_home, {_REST.replace('prev_ts', 'f.prev_ts')},
  {', '.join(f'f."{c}"' for c in K.FEATURE_COLUMNS if c in ROLL_COLS + AVAIL_COLS + ['career_game_count', 'season_game_count'] and c != 'rest_days')},
  {_TF_SQL}, new_player_baseline
FROM w f {_TF_JOIN} LEFT JOIN bl ON bl.league=f.league AND bl.season=f.season AND bl.slot=f.ts::DATE""")
def feature_table(spark, d):
    f = X.feature_table(fact(spark, d))
    out = X.model_inputs(f, ("game_id", "player_id", "fantasy_points")).withColumn("is_home", F.col("is_home").cast("int"))
    return six(out, ROLL_COLS + TF_COLS + ["new_player_baseline"])


_W_REST = f"""w AS (SELECT *, {_AVAIL_SQL} FROM fact), r AS (SELECT *, {_REST} FROM w WHERE "min">0)"""


@query("rest_effect", f"""WITH {Q.BOX}, {Q.GAMES}, {FACT}, {_W_REST}
SELECT CASE WHEN back_to_back=1 THEN 'Back-to-back' WHEN rest_days<=1 THEN '1 day rest' WHEN rest_days>1 THEN '2+ days rest' END AS rest_group,
  {hu('avg(fantasy_points)', 6)} AS mean_score FROM r GROUP BY ALL""")
def rest_effect(spark, d):
    return six(B.rest_effect(form(spark, d)), ["mean_score"])


@query("naive_metrics", f"""WITH {Q.BOX}, {Q.GAMES}, {FACT},
p AS (SELECT season, season_start, fantasy_points AS y, played, greatest(coalesce(avg(fantasy_points) OVER ({WP} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),0e0),0e0) AS yh FROM fact),
v AS (SELECT *, yh-y AS e FROM p WHERE season='2000')
SELECT season, count(*) AS n, {hu('avg(abs(e))', 6)} AS mae, {hu('sqrt(avg(e*e))', 6)} AS rmse,
 count(*) FILTER (played=1) AS played_n, {hu('avg(abs(e)) FILTER (played=1)', 6)} AS played_mae, {hu('sqrt(avg(e*e) FILTER (played=1))', 6)} AS played_rmse,
 count(*) FILTER (played=0) AS dnp_n, {hu('avg(abs(e)) FILTER (played=0)', 6)} AS dnp_mae, {hu('sqrt(avg(e*e) FILTER (played=0))', 6)} AS dnp_rmse
FROM v GROUP BY ALL""")
def naive_metrics(spark, d):
    """The last-5 average as prediction for one validation season."""
    f = X.naive_projection(form(spark, d).filter(F.col("season") == "2000"))
    return X.regression_metrics(f, "fantasy_points", "naive", ("season",))


# History up to a cut-over date, everything later is upcoming.
CUT = "2001-07-01"


def split_history(spark, d):
    f = fact(spark, d)
    history = f.filter(F.col("ts") < CUT)
    up = D.games(spark, d).filter(F.col("ts") >= CUT).withColumn("status", F.lit("STATUS_SCHEDULED"))
    return history, up, D.players(spark, d)


_S = f"PARTITION BY league, player_id ORDER BY {ORD}"
_STATE = ", ".join(f'{hu(f"""avg("{s}") OVER ({_S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)""", 6)} AS "{c}"' for c, s, n in _ROLL)
_ASOF_CTE = f"""{Q.BOX}, {Q.GAMES}, {FACT}, h AS (SELECT * FROM fact WHERE ts < '{CUT}'),
roster AS (SELECT s_suppkey AS player_id, s_suppkey % t AS team_id,
  CASE s_suppkey%4 WHEN 0 THEN 'G' WHEN 1 THEN 'F' WHEN 2 THEN 'C' END AS position FROM supplier, teamcount),
up AS (SELECT * FROM games WHERE ts >= '{CUT}'),
ph AS (SELECT u.game_id, u.season, u.season_start, u.ts, u.ts::DATE AS day, r.player_id, r.team_id, r.position,
   s.opponent_id, s.is_home FROM (SELECT *, home_id AS team_id, away_id AS opponent_id, TRUE AS is_home FROM up
   UNION ALL SELECT *, away_id, home_id, FALSE FROM up) s JOIN up u USING (game_id) JOIN roster r ON r.team_id=s.team_id),
st AS (SELECT *, ts::DATE AS hday, {_STATE}, row_number() OVER ({_S}) AS career,
  row_number() OVER (PARTITION BY league, player_id, season_start ORDER BY ts, game_id) AS in_season,
  sum(CASE WHEN "min" IS NOT NULL THEN ("min">0)::INT::DOUBLE END) OVER ({_S} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS gp5 FROM h),
dst AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY player_id, hday ORDER BY season_start DESC, ts DESC, game_id DESC)=1),
tg AS (SELECT league, season_start, game_id, team_id, min(ts) AS ts, min(team_score) AS team_score, min(opp_score) AS opp_score
  FROM h GROUP BY ALL HAVING min(is_home)=max(is_home)),
ts0 AS (SELECT *, ts::DATE AS hday, {hu(f'avg(team_score) OVER (PARTITION BY team_id ORDER BY {ORD} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 6)} AS pf,
  {hu(f'avg(opp_score) OVER (PARTITION BY team_id ORDER BY {ORD} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 6)} AS pa FROM tg),
dts AS (SELECT * FROM ts0 QUALIFY row_number() OVER (PARTITION BY team_id, hday ORDER BY season_start DESC, ts DESC, game_id DESC)=1),
dm AS (SELECT season_start, ts::DATE AS slot, avg(fantasy_points) AS m FROM h GROUP BY ALL),
dbl AS (SELECT slot, {hu('avg(m) OVER (ORDER BY season_start, slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 6)} AS v FROM dm),
x AS (SELECT ph.*, s.* EXCLUDE (game_id, season, season_start, ts, player_id, team_id, opponent_id, is_home), s.season AS s_season, s.ts AS s_ts,
   t.pf AS team_form_pf, t.pa AS team_form_pa, o.pa AS opp_form_pa, o.pf AS opp_form_pf, b.v AS new_player_baseline
  FROM ph ASOF LEFT JOIN dst s ON ph.player_id=s.player_id AND ph.day > s.hday
  ASOF LEFT JOIN dts t ON ph.team_id=t.team_id AND ph.day > t.hday
  ASOF LEFT JOIN dts o ON ph.opponent_id=o.team_id AND ph.day > o.hday
  ASOF LEFT JOIN dbl b ON ph.day > b.slot)"""


@query("asof_projection", f"""WITH {_ASOF_CTE}
SELECT game_id, player_id, team_id, opponent_id, is_home, position, {', '.join(f'"{c}"' for c in ROLL_COLS)},
  coalesce(career,0) AS career_game_count, CASE WHEN s_season=season THEN in_season ELSE 0 END AS season_game_count,
  "min" AS minutes_last_game, (coalesce("min",0)>0)::INT AS played_last_game, gp5 AS games_played_last_5,
  CASE WHEN s_ts IS NOT NULL THEN greatest(floor((epoch(ts)-epoch(s_ts))/86400)::BIGINT-1,0) END AS rest_days,
  coalesce((floor((epoch(ts)-epoch(s_ts))/86400)=1)::INT,0) AS back_to_back,
  team_form_pf, team_form_pa, opp_form_pa, opp_form_pf, new_player_baseline FROM x""")
def asof_projection(spark, d):
    rows = P.projection_rows(*split_history(spark, d)).drop("league", "season", "season_start", "ts")
    return six(rows, ROLL_COLS + TF_COLS + ["new_player_baseline"])


_PROJ = f"""proj AS (SELECT game_id, ts, player_id, position,
  greatest(coalesce(fantasy_points_avg_last_5,0e0),0e0) AS projected_points FROM x)"""


def projections(spark, d):
    return P.project_upcoming(*split_history(spark, d), lambda rows: six(P.naive_score(rows), ["projected_points"]))


@query("naive_projection", f"WITH {_ASOF_CTE}, {_PROJ} SELECT game_id, player_id, position, {hu('projected_points', 6)} AS projected_points FROM proj")
def naive_projection(spark, d):
    return projections(spark, d).select("game_id", "player_id", "position", "projected_points")


_POOL = f"""pool AS (SELECT *, ts::DATE AS slate, {hu('projected_points', 6)} AS pp, CASE WHEN position IS NULL THEN '' ELSE position END AS bucket FROM proj),
 best1 AS (SELECT slate, player_id, game_id, bucket, pp FROM pool QUALIFY row_number() OVER (PARTITION BY slate, player_id ORDER BY pp DESC, game_id)=1),
 r1 AS (SELECT *, row_number() OVER (PARTITION BY slate, bucket ORDER BY pp DESC, player_id) AS rb FROM best1),
 r2 AS (SELECT *, CASE WHEN rb <= CASE bucket WHEN 'G' THEN 2 WHEN 'F' THEN 2 WHEN 'C' THEN 1 ELSE 0 END THEN bucket END AS sp FROM r1),
 r3 AS (SELECT *, row_number() OVER (PARTITION BY slate, sp IS NULL ORDER BY pp DESC, player_id) AS ru FROM r2),
 fe AS (SELECT slate FROM best1 GROUP BY slate HAVING count(*) FILTER (bucket='G')>=2 AND count(*) FILTER (bucket='F')>=2
   AND count(*) FILTER (bucket='C')>=1 AND count(*)>=7)"""


def slate_pool(spark, d):
    """Each player once per day, with the better of two games."""
    p = projections(spark, d).withColumn("slate", F.to_date("ts"))
    best = first_by(p.select("slate", "player_id", "game_id", "position", "projected_points"),
                    ["slate", "player_id"], [-F.col("projected_points"), F.col("game_id")])
    return stage(best, "slates")  # the line-up reads its pool more than once


@query("best_lineup", f"""WITH {_ASOF_CTE}, {_PROJ}, {_POOL}
SELECT slate, player_id, game_id, pp AS projected_points, coalesce(sp,'UTIL') AS slot FROM r3 WHERE (sp IS NOT NULL OR ru<=2)
AND slate IN (SELECT slate FROM fe)""")
def best_lineup(spark, d):
    return L.best_lineup(slate_pool(spark, d), ["slate"]).select("slate", "player_id", "game_id", "projected_points", "slot")


@query("lineup_status", f"""WITH {_ASOF_CTE}, {_PROJ}, {_POOL}
SELECT slate, count(*) AS players, (slate IN (SELECT slate FROM fe)) AS feasible FROM best1 GROUP BY slate""")
def lineup_status(spark, d):
    return L.lineup_status(slate_pool(spark, d), ["slate"]).select("slate", "players", "feasible")


@query("formation", f"""WITH {Q.SEASON}, b AS (SELECT league, season, season_start, player_id, row_number() OVER (PARTITION BY league, season ORDER BY {pg('pts')} DESC, pts DESC, player_name, player_id) AS rank FROM qual QUALIFY rank<=10),
p AS (SELECT *, CASE player_id%4 WHEN 0 THEN 'G' WHEN 1 THEN 'F' WHEN 2 THEN 'C' END AS bucket FROM b)
SELECT league, season, player_id, rank, CASE WHEN row_number() OVER (PARTITION BY league, season, bucket ORDER BY rank) <= CASE bucket WHEN 'G' THEN 2 WHEN 'F' THEN 2 WHEN 'C' THEN 1 ELSE 0 END THEN bucket END AS slot FROM p""")
def formation(spark, d):
    t, _, bars = season_inputs(spark, d)
    board = B.stat_leaders(t, bars, ("pts",))
    return L.formation(board, D.players(spark, d), B.BY).select("league", "season", "player_id", "rank", "slot")


_EV = """ev AS (SELECT event_id AS game_id, ts, user_id AS player_id, CASE WHEN event_type='error' THEN 0 ELSE floor(value+5e-1) END::BIGINT AS score,
  CASE WHEN event_type='error' THEN 0 ELSE 30 END AS "min" FROM events)"""
_EW = "PARTITION BY player_id ORDER BY ts, game_id"


@query("event_form", f"""WITH {_EV} SELECT game_id, player_id, {hu(f'avg(score) OVER ({_EW} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)', 6)} AS score_avg_last_3,
 {hu(f'avg(score) OVER ({_EW} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)', 6)} AS score_avg_last_10,
 row_number() OVER ({_EW})-1 AS career_game_count,
 sum(("min">0)::INT::DOUBLE) OVER ({_EW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS games_played_last_5 FROM ev""")
def event_form(spark, d):
    """The same windows on a second log, in many ranges."""
    f = X.player_form(D.event_log(spark, d), ("score",), (3, 10), parts=64)
    cols = ["score_avg_last_3", "score_avg_last_10"]
    return six(f.select("game_id", "player_id", *cols, "career_game_count", "games_played_last_5"), cols)


@query("props_json", """SELECT user_id AS player_id, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, count(*) AS n,
 max((props->>'$.k')::BIGINT) AS k_max FROM events GROUP BY user_id""")
def props_json(spark, d):
    """Numbers inside a JSON column, parsed with a fixed schema."""
    e = D.event_log(spark, d).withColumn("k", F.from_json("props", "k BIGINT")["k"])
    return e.groupBy("player_id").agg(F.sum("k").alias("k_sum"), F.count(F.lit(1)).alias("n"), F.max("k").alias("k_max"))
