"""Filters, gates, listings and small expressions on the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as X
from ..functions import scoring as S
from ..functions import seasons as Y
from ..operators import boosting as G
from ..operators import careers as R
from ..operators import features as FX
from ..operators import lineup as L
from ..operators import models as M
from ..operators import projections as P
from ..operators import schedule as C
from ..operators import snapshots as N
from ..sources import sinks as W
from ..sources.payloads import filter_plays
from ..sources.staging import fresh_path, stage
from . import bindings as D
from . import sqlparts as Q
from .board_queries import fact
from .career_queries import CHAMP, HIST, HROWS, LADDER, MERGED, bundles, ladder_of, merged, staged_totals
from .feature_queries import _ASOF_CTE, _POOL, _PROJ, slate_pool
from .payload_queries import flatten_plays
from .registry import query
from .schedule_queries import _SNAP, arrivals

hu = Q.hu


@query("upcoming_horizon", f"""WITH {Q.BOX}, {Q.GAMES},
g AS (SELECT *, CASE WHEN game_id%17<>0 THEN ts END AS t FROM games)
SELECT 'horizon' AS kind, game_id FROM games WHERE status<>'STATUS_FINAL' AND ts::DATE BETWEEN DATE '1995-06-01' AND DATE '1995-06-01' + {K.PROJECTION_HORIZON_DAYS}
UNION ALL SELECT 'dated', game_id FROM g WHERE t IS NOT NULL
UNION ALL SELECT 'listed', game_id FROM games WHERE game_id%9=0""")
def upcoming_horizon(spark, d):
    """Unfinished games of the days ahead, games with a date, and games of a list (another league's equal ids aside)."""
    g = stage(D.games(spark, d), "games")
    k = F.col("game_id")
    listed = g.select(F.when(k % 9 == 0, "nba").otherwise("wnba").alias("league"), "game_id")
    parts = {"horizon": P.horizon(g, "1995-06-01"), "dated": P.drop_null_rows(g.withColumn("ts", F.when(k % 17 != 0, F.col("ts"))), ["ts"]),
             "listed": P.only_games(g, listed)}
    return C.union_all([v.select(F.lit(n).alias("kind"), "game_id") for n, v in parts.items()])


@query("training_rows", f"""WITH {Q.BOX} SELECT CASE WHEN season<'1999' THEN 'train' ELSE 'validation' END AS part, season, count(*) AS n FROM box
WHERE season<='1999' AND season<>'1997' GROUP BY ALL""")
def training_rows(spark, d):
    """Rows of the two parts of a chronological split without the held-out season; later seasons are in neither."""
    parts = M.chronological_split(M.drop_holdout(D.box(spark, d), ("1997",)), "1999")
    return C.union_all([p.groupBy(F.lit(n).alias("part"), "season").agg(F.count(F.lit(1)).alias("n")) for n, p in zip(("train", "validation"), parts)])


@query("current_season_rows", """SELECT o_orderkey AS game_id FROM orders WHERE o_orderdate >= DATE '1996-08-01' AND o_orderdate < DATE '1997-08-01'""")
def current_season_rows(spark, d):
    """Games of the season that is being played on a day, by the league's split label."""
    o = D.table(spark, d, "orders").select(F.lit("nba").alias("league"), F.col("o_orderkey").alias("game_id"), Y.season_label_from_date("o_orderdate", "nba").alias("season"))
    return C.current_only(o, "1997-03-01").select("game_id")


@query("snapshot_part", f"WITH {_SNAP} SELECT league, season, snap_date, arrival, race, rank, player_id, player_name, score FROM snap_days, (VALUES (0),(1)) a(arrival) WHERE rank<=10".replace(
    "(DATE '2024-01-01' + (step*3)::INT) AS snap_date", "(DATE '2024-01-01' + (step*3+o.o)::INT) AS snap_date").replace("snap AS (", "snap_days AS (").replace(
        "score FROM top)", "score FROM top, (VALUES (0),(1),(2)) o(o))"))
def snapshot_part(spark, d):
    """The part of every race that a snapshot stores, with the pull it came from."""
    rows = arrivals(spark, d)
    kept = N.snapshot_rows(rows, 10)
    return rows.join(kept.select("league", "season", "race", "player_id", "rank").distinct(), ["league", "season", "race", "player_id", "rank"], "left_semi").select(
        "league", "season", "snap_date", "arrival", *N.ROW)


@query("play_feed", """SELECT event_id AS game_id, 'Q'||(event_id%4+1) AS period, event_type AS description, event_type='purchase' AS scoring,
 event_type='purchase' AND event_id%4=1 AS shown FROM events WHERE event_type<>'error'""")
def play_feed(spark, d):
    """All plays, and which of them the second quarter's scoring view shows."""
    plays = stage(flatten_plays(spark, d), "plays")
    shown = filter_plays(plays, "Q2", scoring_only=True).select("game_id", F.lit(True).alias("shown"))
    return plays.join(shown, "game_id", "left").select("game_id", "period", "description", "scoring", F.coalesce("shown", F.lit(False)).alias("shown"))


@query("team_names", """SELECT c_custkey AS player_id, c_nationkey AS team_id, CASE WHEN c_nationkey<20 THEN 'T'||c_nationkey END AS team_abbrev,
 CASE WHEN c_nationkey<20 THEN n_name END AS team_name, (SELECT count(*) FROM nation WHERE n_nationkey<20)>=30 AS complete FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey""")
def team_names(spark, d):
    """Names of team ids, null for teams the list lacks, and whether the list has enough teams for its league."""
    n = D.table(spark, d, "nation").where("n_nationkey < 20")
    teams = n.select(F.lit("nba").alias("league"), F.col("n_nationkey").alias("team_id"), F.concat(F.lit("T"), "n_nationkey").alias("abbrev"), F.col("n_name").alias("display_name"))
    rows = D.table(spark, d, "customer").select(F.lit("nba").alias("league"), F.col("c_custkey").alias("player_id"), F.col("c_nationkey").alias("team_id"))
    ok = C.enough_teams(teams).select("league", F.col("ok").alias("complete"))
    return C.team_lookup(rows, teams).join(ok, "league").select("player_id", "team_id", "team_abbrev", "team_name", "complete")


@query("schedule_places", f"""WITH {Q.BOX}, {Q.GAMES}, g AS (SELECT *, CASE WHEN game_id%17<>0 THEN ts END AS t FROM games)
SELECT game_id, row_number() OVER (ORDER BY t NULLS FIRST, game_id) AS place FROM g""")
def schedule_places(spark, d):
    """Every game's place in the schedule, undated ones first."""
    g = D.games(spark, d).withColumn("ts", F.when(F.col("game_id") % 17 != 0, F.col("ts")))
    return C.schedule_places(g).select("game_id", "place")


@query("lineup_display", f"""WITH {_ASOF_CTE}, {_PROJ}, {_POOL}, l AS (SELECT slate, player_id, pp, coalesce(sp,'UTIL') AS slot FROM r3 WHERE (sp IS NOT NULL OR ru<=2) AND slate IN (SELECT slate FROM fe))
SELECT slate, player_id, slot, row_number() OVER (PARTITION BY slate ORDER BY list_position(['G','F','C','UTIL'], slot), pp DESC, player_id) AS line,
 {hu('sum(pp) OVER (PARTITION BY slate)', 6)} AS total FROM l""")
def lineup_display(spark, d):
    """Best line-ups as they are shown: slots in order, best player first, with the slate's points."""
    best = stage(L.best_lineup(slate_pool(spark, d), ["slate"]), "lineups")
    total = L.total_points(best, ["slate"]).select("slate", (F.floor(F.col("total_points") * 1e6 + 0.5) / 1e6).alias("total"))
    return L.display_lines(best, ["slate"]).join(total, "slate").select("slate", "player_id", "slot", "line", "total")


@query("best_profiles", f"WITH {HIST}, {MERGED}, {LADDER} SELECT league, player_id, rank FROM lad WHERE rank<=4")
def best_profiles(spark, d):
    """The default profile selection: the four best ladder ranks of each league."""
    return N.best_profiles(ladder_of(merged(spark, d), spark, d)).select("league", "player_id", "rank")


@query("other_finals", f"""WITH {Q.BOX}, {Q.GAMES}, {Q.RECORDS}, {CHAMP},
t AS (SELECT league, (year-1)||'-'||lpad((year%100)::VARCHAR,2,'0') AS season, year%7+1 AS player_id, team_id, FALSE AS pending FROM champ WHERE year<2002
  UNION ALL SELECT 'nba', '2001-02', NULL, NULL, TRUE)
SELECT league, season, player_id, team_id, pending FROM t WHERE season<>'1996-97' ORDER BY season DESC LIMIT 5""")
def other_finals(spark, d):
    """Newest finals besides the selected season; the season that is being played is pending."""
    from .career_queries import champions
    c = stage(champions(spark, d), "champions")
    winners = c.select("league", "year", (F.col("year") % 7 + 1).alias("player_id"))
    return N.other_seasons(N.finals_tracker(winners.where("year < 2002"), c, "2002-03-01"), "1996-97", 5).select("league", "season", "player_id", "team_id", "pending")


@query("positions_refresh", """SELECT 'nba' AS league, s_suppkey AS player_id, s_suppkey%10 AS team_id, CASE WHEN s_suppkey%10 IN (3,7) THEN 'old' ELSE 'new' END AS position FROM supplier""")
def positions_refresh(spark, d):
    """Rosters pulled again: teams whose call failed keep the stored rows, the same team ids of another league don't count."""
    rows = D.table(spark, d, "supplier").select(F.lit("nba").alias("league"), F.col("s_suppkey").alias("player_id"), (F.col("s_suppkey") % 10).alias("team_id"))
    team = F.col("team_id")
    failed = rows.select(F.when(team.isin(3, 7), "nba").otherwise("wnba").alias("league"), "team_id").distinct()
    return C.refresh_positions(rows.withColumn("position", F.lit("old")), rows.where(~team.isin(3, 7)).withColumn("position", F.lit("new")), failed)


@query("exported_csv", """SELECT s_suppkey::VARCHAR AS "Id", s_name AS "Player" FROM supplier""")
def exported_csv(spark, d):
    """An export read back: renamed columns, those the table lacks left out."""
    path = fresh_path(spark, "export")
    W.export_csv(D.players(spark, d), path, {"player_id": "Id", "player_name": "Player", "nothing": "Nothing"})
    return spark.read.option("header", True).csv(path)


@query("model_importance", "SELECT 'play' AS model, f AS feature, TRUE AS in_range FROM (SELECT unnest([" + ", ".join(
    f"'{c}'" for c in K.FEATURE_COLUMNS) + "]) AS f) u")
def model_importance(spark, d):
    """Every input's importance for the chance to play lies between 0 and 1; the model is stored and read back."""
    rows = M.chronological_split(FX.feature_table(fact(spark, d)).withColumn("is_home", F.col("is_home").cast("int")), "2000")[0]
    rows = stage(rows.select("league", "game_id", "player_id", "played", *K.FEATURE_COLUMNS), "features")
    held = G.train(rows, {"play": G.projection_tasks()["play"]}, K.FEATURE_COLUMNS, ["league", "game_id", "player_id"])
    path = fresh_path(spark, "stored-models")
    held.write.parquet(path)
    shares = G.importances(spark.read.schema(held.schema).parquet(path), K.FEATURE_COLUMNS)
    return shares.select("model", "feature", F.col("importance").between(0, 1).alias("in_range"))


@query("age_notes", """SELECT event_id AS game_id, CASE WHEN event_id%10=0 THEN '' ELSE (SELECT CASE WHEN s<60 THEN ' (just now)' WHEN s<3600 THEN ' ('||(s//60)||' min ago)'
  WHEN s<172800 THEN ' ('||(s//3600)||' h ago)' ELSE ' ('||(s//86400)||' d ago)' END FROM (SELECT greatest(date_diff('second', date_trunc('minute', ts), TIMESTAMP '2024-01-20 00:00:00'), 0) AS s)) END AS age,
  greatest(value-50, 0)::DOUBLE AS clipped, floor(value-50+5e-1)*25e-2 AS expected FROM events""")
def age_notes(spark, d):
    """Ages of notes, values clipped at zero, and chance times points."""
    e = D.table(spark, d, "events")
    note = F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("updated "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'")))
    return e.select(F.col("event_id").alias("game_id"), X.age_text(note, F.lit("2024-01-20").cast("timestamp")).alias("age"),
                    X.clip_zero(F.col("value") - 50).alias("clipped"), S.expected_points(F.lit(0.25), F.floor(F.col("value") - 50 + 0.5)).alias("expected"))


@query("season_logs", f"""WITH {Q.BOX}, {Q.GAMES}, {Q.TOTALS}, {Q.RECORDS}, {CHAMP}, {HROWS}
SELECT h.league, h.player_id, (h.year-1)||'-'||lpad((h.year%100)::VARCHAR,2,'0') AS season, h.team, h.gp, h.pts, b.ok AS trusted FROM hr h JOIN bu b USING (league, player_id)""")
def season_logs(spark, d):
    """Season rows of history documents as records, and whether they reach back to the career's start."""
    t = staged_totals(spark, d)
    b = bundles(t, spark, d).select("league", "player_id", R.trusted().alias("trusted"), F.explode(R.season_log()).alias("r"))
    return b.select("league", "player_id", "r.season", "r.team", "r.gp", "r.pts", "trusted")
