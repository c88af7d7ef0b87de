"""Schedule, standings, rounds, snapshots on the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as X
from ..functions import seasons as Y
from ..operators import boards as B
from ..operators import schedule as C
from ..operators import snapshots as N
from ..sources.staging import stage
from . import bindings as D
from . import sqlparts as Q
from .board_queries import BY, RACES_SQL, MIP_CTE, season_inputs, totals
from .registry import query

hu, pg = Q.hu, Q.pg
TODAY = "2000-03-15"
GAMES = f"WITH {Q.BOX}, {Q.GAMES}"
ZONE = "Pacific/Auckland"
_LOCAL = f"(timezone('{ZONE}', timezone('UTC', ts)))"


def plain(df, *cols):
    """Times as dates, for comparison."""
    return df.select(*[F.to_date(c).alias(c) if c == "ts" else F.col(c) for c in (cols or df.columns)])


@query("schedule_filter", f"""{GAMES}, f AS (
 SELECT 'all' AS view, * FROM games WHERE home_abbrev='T0007' OR away_abbrev='T0007' UNION ALL
 SELECT 'home', * FROM games WHERE home_abbrev='T0007' UNION ALL SELECT 'away', * FROM games WHERE away_abbrev='T0007' UNION ALL
 SELECT 'neutral', * FROM games WHERE neutral='True') SELECT view, season, game_id, home_abbrev, away_abbrev FROM f""")
def schedule_filter(spark, d):
    g = stage(D.games(spark, d), "games")
    views = {"all": C.filter_schedule(g, "T0007"), "home": C.filter_schedule(g, "T0007", "Home"),
             "away": C.filter_schedule(g, "T0007", "Away"), "neutral": C.filter_schedule(g, venue="Neutral")}
    return C.union_all([v.select(F.lit(n).alias("view"), "season", "game_id", "home_abbrev", "away_abbrev") for n, v in views.items()])


@query("schedule_split", f"""{GAMES}, s AS (SELECT *, CASE WHEN status='STATUS_FINAL' THEN 'final' WHEN {_LOCAL}::DATE >= DATE '{TODAY}' THEN 'upcoming' ELSE 'stale' END AS state FROM games)
SELECT league, season, count(*) FILTER (state='final') AS final, count(*) FILTER (state='upcoming') AS upcoming, count(*) FILTER (state='stale') AS stale, count(DISTINCT game_id) AS games FROM s GROUP BY ALL""")
def schedule_split(spark, d):
    return C.schedule_counts(D.games(spark, d), TODAY, ZONE)


def two_leagues(games):
    """Every third game once more in another league, under the same id."""
    return games.unionByName(games.filter(F.col("game_id") % 3 == 0).withColumn("league", F.lit("wnba")))


@query("recent_upcoming", f"""{GAMES}, two AS (SELECT league, game_id, ts, status FROM games UNION ALL SELECT 'wnba', game_id, ts, status FROM games WHERE game_id%3=0),
r AS (SELECT 'recent' AS view, league, game_id FROM two WHERE status='STATUS_FINAL' QUALIFY row_number() OVER (PARTITION BY league ORDER BY ts DESC, game_id DESC)<=15),
n AS (SELECT 'next' AS view, league, game_id FROM two WHERE status<>'STATUS_FINAL' AND ts::DATE >= DATE '{TODAY}' QUALIFY row_number() OVER (PARTITION BY league ORDER BY ts, game_id)<=25) SELECT * FROM r UNION ALL SELECT * FROM n""")
def recent_upcoming(spark, d):
    """Two leagues with the same game ids; each has its own newest and next games."""
    g = two_leagues(D.games(spark, d))
    return C.recent_results(g).select(F.lit("recent").alias("view"), "league", "game_id").unionByName(
        C.next_fixtures(g, TODAY).select(F.lit("next").alias("view"), "league", "game_id"))


@query("local_day", f"""WITH e AS (SELECT 'wnba' AS league, event_id AS game_id, ts, timezone('{ZONE}', timezone('UTC', ts)) AS lt FROM events)
SELECT game_id, strftime(lt, '%Y-%m-%d %H:%M') AS time FROM e WHERE ts >= TIMESTAMP '2024-01-10 11:00:00' AND ts < TIMESTAMP '2024-01-11 11:00:00'""")
def local_day(spark, d):
    """One local day of a feed whose covering day buckets overlap (every event arrives twice)."""
    e = D.event_log(spark, d).select("league", "game_id", "ts")
    return C.local_day_games(e.unionByName(e), "2024-01-10 11:00:00", "2024-01-11 11:00:00", ZONE).select("game_id", "time")


@query("day_buckets", """WITH e AS (SELECT event_id AS game_id, ts::DATE AS dd FROM events)
SELECT game_id, strftime(dd-1,'%Y%m%d')||','||strftime(dd,'%Y%m%d')||','||strftime(dd+1,'%Y%m%d') AS day_buckets,
 strftime(dd-1,'%Y%m%d')||','||strftime(dd,'%Y%m%d') AS game_buckets FROM e""")
def day_buckets(spark, d):
    return D.event_log(spark, d).select("game_id", F.array_join(X.day_buckets("ts"), ",").alias("day_buckets"),
                                        F.array_join(X.game_buckets("ts"), ",").alias("game_buckets"))


def two_feeds(spark, d):
    """Every game as both teams' schedules carry it; the away copy is less complete."""
    g = D.games(spark, d).select("league", "season", "season_start", "game_id", "ts", "home_abbrev", "home_score",
                                 "away_abbrev", "away_score", "status")
    k = F.col("game_id")
    home = g.withColumn("ts", F.when(k % 7 != 0, F.col("ts"))).withColumn(
        "status", F.when(k % 5 == 0, "STATUS_SCHEDULED").otherwise(F.col("status"))).withColumn("feed", F.lit(0))
    away = g.withColumn("home_score", F.when(k % 3 != 0, F.col("home_score"))).withColumn("feed", F.lit(1))
    return home.unionByName(away)


@query("best_copy", f"""{GAMES}, f AS (
 SELECT league, season, game_id, CASE WHEN game_id%7<>0 THEN ts END AS ts, home_score, away_score, CASE WHEN game_id%5=0 THEN 'STATUS_SCHEDULED' ELSE status END AS status, 0 AS feed FROM games
 UNION ALL SELECT league, season, game_id, ts, CASE WHEN game_id%3<>0 THEN home_score END, away_score, status, 1 FROM games)
SELECT league, season, game_id, ts::DATE AS ts, home_score, away_score, status, feed FROM f QUALIFY row_number() OVER (PARTITION BY game_id
 ORDER BY (status='STATUS_FINAL')::INT DESC, (home_score IS NOT NULL AND away_score IS NOT NULL)::INT DESC, (ts IS NOT NULL)::INT DESC, feed)=1""")
def best_copy(spark, d):
    return plain(C.best_copy(two_feeds(spark, d), "feed"), "league", "season", "game_id", "ts", "home_score", "away_score", "status", "feed")


@query("upsert_schedule", f"""{GAMES}, old AS (SELECT * FROM games WHERE season<>'2001'),
new AS (SELECT * FROM games WHERE season IN ('1999','2001') OR (season='1997' AND game_id%2=0) OR (season='1998' AND game_id%2=0)),
fail AS (SELECT '1997' AS season UNION ALL SELECT '1999'),
pick AS (SELECT season, count(*) FILTER (w='o') AS o, count(*) FILTER (w='n') AS n FROM (SELECT season,'o' AS w FROM old UNION ALL SELECT season,'n' FROM new) GROUP BY ALL),
ch AS (SELECT season, n>0 AND NOT (o>n AND season IN (SELECT season FROM fail)) AS take FROM pick)
SELECT season, game_id, home_score FROM old WHERE season IN (SELECT season FROM ch WHERE NOT take) UNION ALL SELECT season, game_id, home_score FROM new WHERE season IN (SELECT season FROM ch WHERE take)""")
def upsert_schedule(spark, d):
    """Stored seasons to 2000; a fresh pull of four seasons, two of them half, one with failed calls."""
    g = stage(D.games(spark, d), "games")
    s, half = F.col("season"), F.col("game_id") % 2 == 0
    fresh = g.filter(s.isin("1999", "2001") | (s.isin("1997", "1998") & half)).withColumn("feed", F.lit(0))
    failed = g.filter(s.isin("1997", "1999")).groupBy("league", "season").agg(F.lit(1).alias("failures"))
    return C.upsert_schedule(g.filter(s != "2001"), fresh, "feed", failed).select("season", "game_id", "home_score")


@query("pending_games", f"""{GAMES}, two AS (SELECT league, season, game_id, status FROM games UNION ALL SELECT 'wnba', season, game_id, status FROM games WHERE game_id%3=0),
ok AS (SELECT league, season, game_id FROM box GROUP BY ALL HAVING count(DISTINCT team_id)>=2)
SELECT league, season, game_id FROM two ANTI JOIN ok USING (league, season, game_id) WHERE status='STATUS_FINAL'""")
def pending_games(spark, d):
    """Finished games whose stored box score is missing a team."""
    from ..streaming.incremental import valid_games
    return C.pending_games(two_leagues(D.games(spark, d)), valid_games(D.box(spark, d))).select("league", "season", "game_id")


@query("gap_days", f"""{GAMES}, m AS (SELECT season, month(ts)>=5 AS post, ts::DATE + CASE WHEN month(ts)>=5 THEN (9+season_start%7)::INT ELSE 0 END AS day FROM games),
r AS (SELECT season, max(day) AS l FROM m WHERE NOT post GROUP BY ALL), p AS (SELECT season, min(day) AS f FROM m WHERE post GROUP BY ALL)
SELECT season, unnest(generate_series(l+1, f-1, INTERVAL 1 DAY))::DATE AS day FROM r JOIN p USING (season)""")
def gap_days(spark, d):
    """Days between a season's last regular game and its first postseason game: games from May on are
    the postseason, moved 9 to 15 days later, so that every season has a gap."""
    later = F.col("ts") + F.make_dt_interval(F.when(F.month("ts") >= 5, F.lit(9) + F.col("season_start") % 7).otherwise(0).cast("int"))
    g = stage(D.games(spark, d).withColumns({"post": F.month("ts") >= 5, "ts": later}), "games")
    return C.gap_spans(g.filter("NOT post"), g.filter("post")).select("season", "day")


@query("gap_games", f"""{GAMES} SELECT league, game_id FROM games WHERE game_id%3<>0 UNION ALL SELECT 'wnba', game_id FROM games WHERE game_id%3=0""")
def gap_games(spark, d):
    g = stage(D.games(spark, d), "games")
    return C.gap_games(two_leagues(g), g.filter(F.col("game_id") % 3 == 0)).select("league", "game_id")


HEADLINES = {"1-URGENT": "EASTERN CONFERENCE 1st ROUND - GAME 1", "2-HIGH": "West Semifinals – Game 1",
             "3-MEDIUM": "NBA Finals - Game 5", "4-NOT SPECIFIED": "NBA Play-In - East - 7th Place vs 8th Place"}
_HEAD_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HEADLINES.items()) + " ELSE '' END"
_ROUND_SQL = f"nullif(trim(regexp_split_to_array(trim({_HEAD_SQL}), '\\s+[-–—]\\s+')[1]),'')"
_DISP = {"EASTERN CONFERENCE 1st ROUND": "Eastern Conference 1st Round", "West Semifinals": "West Semifinals",
         "NBA Finals": "NBA Finals", "NBA Play-In": "NBA Play-In"}
_RANKS = {"EASTERN CONFERENCE 1st ROUND": 1, "West Semifinals": 2, "NBA Finals": 4, "NBA Play-In": 0}


def headlines(spark, d):
    from ..functions.core import case_map
    o = D.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
                    case_map(F.col("o_orderpriority"), HEADLINES, F.lit("")).alias("headline"))


@query("rounds", f"""SELECT o_orderkey AS game_id, {_ROUND_SQL} AS round,
 CASE {_ROUND_SQL} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _RANKS.items())} ELSE 9 END AS round_rank,
 coalesce(CASE {_ROUND_SQL} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _DISP.items())} END, '{K.NO_ROUND}') AS round_text FROM orders""")
def rounds(spark, d):
    g = headlines(spark, d).withColumn("round", X.round_label("headline"))
    return C.bracket_order(g).select("game_id", "round", "round_rank", "round_text")


@query("fill_rounds", f"""SELECT o_orderkey AS game_id, CASE WHEN o_orderkey%4=0 THEN 'Stored Round' WHEN {_ROUND_SQL} IS NOT NULL THEN {_ROUND_SQL} WHEN o_orderkey%4=1 THEN '' END AS round FROM orders""")
def fill_rounds(spark, d):
    h = headlines(spark, d)
    k = F.col("game_id")
    rows = h.withColumn("round", F.when(k % 4 == 0, "Stored Round").when(k % 4 == 1, ""))
    labels = h.select(F.lit(D.LEAGUE).alias("league"), "game_id", X.round_label("headline").alias("round"))
    again = labels.filter(F.col("game_id") % 5 == 0)  # seen in two day buckets
    other = labels.withColumn("league", F.lit("wnba")).withColumn("round", F.lit("Other League"))
    rows = rows.withColumn("league", F.lit(D.LEAGUE))
    return C.fill_rounds(rows, labels.unionByName(again).unionByName(other)).select("game_id", "round")


def win_text(share):
    """Three decimals, without the leading zero: '.682', '1.000'."""
    return F.regexp_replace(F.format_string("%.3f", F.floor(share * 1000 + 0.5) / 1000), "^0", "")


def standings(spark, d):
    """A standings table of every season from the team records."""
    from pyspark.sql import Window
    r = B.team_records(D.games(spark, d))
    tid = F.substring("team_abbrev", 2, 9).cast("bigint")
    conf = F.when(tid % 2 == 0, "Eastern Conference").otherwise("Western Conference")
    w = Window.partitionBy("league", "season", conf).orderBy(F.desc("wins"), "team_abbrev")
    seed = F.row_number().over(w)
    return r.select("league", "season", tid.alias("team_id"), F.col("team_abbrev").alias("team"), conf.alias("conference"),
                    "wins", "losses", win_text(F.col("win_pct")).alias("win_percent"),
                    seed.alias("playoff_seed"), F.when(seed == 1, "-").otherwise(seed.cast("string")).alias("games_behind"))


@query("standings_view", f"""WITH {Q.BOX}, {Q.GAMES}, {Q.RECORDS}, s AS (SELECT league, season, substr(team_abbrev,2)::BIGINT AS team_id, team_abbrev AS team, wins, losses,
 CASE WHEN substr(team_abbrev,2)::BIGINT%2=0 THEN 'Eastern Conference' ELSE 'Western Conference' END AS conference, win_pct FROM records),
 r AS (SELECT *, row_number() OVER (PARTITION BY league, season, conference ORDER BY wins DESC, team) AS playoff_seed FROM s)
SELECT league, season, team_id, team, conference, wins, losses, floor(win_pct*1000+5e-1)/1000e0 AS win_percent, playoff_seed,
 CASE WHEN playoff_seed=1 THEN 0e0 ELSE playoff_seed::DOUBLE END AS games_behind, CASE WHEN playoff_seed<=6 THEN 'playoff' WHEN playoff_seed<=10 THEN 'play_in' ELSE '' END AS zone FROM r""")
def standings_view(spark, d):
    return C.standings_view(standings(spark, d))


@query("standings_season", f"""WITH {Q.BOX}, {Q.GAMES}, {Q.RECORDS} SELECT league, season, substr(team_abbrev,2)::BIGINT AS team_id, wins FROM records WHERE season='2000'""")
def standings_season(spark, d):
    """First season of the try-order 2003, 2002, 2000, 1999 that has results."""
    s = standings(spark, d)
    future = s.filter(F.col("season") == "2001").withColumns({"season": F.lit("2002"), "wins": F.lit(0), "losses": F.lit(0)})
    order = s.select("league").distinct().select("league", F.posexplode(F.array(*[F.lit(x) for x in ("2003", "2002", "2000", "1999")])).alias("priority", "season"))
    return C.first_with_results(s.unionByName(future), order).select("league", "season", "team_id", "wins")


def injuries(spark, d):
    c = D.table(spark, d, "customer")
    n = D.table(spark, d, "nation")
    names = F.element_at(F.array(*[F.lit(x) for x in (*K.INJURY_ORDER, "Probable")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.lit("nba").alias("league"), F.col("c_name").alias("player_name"),
        F.when(F.col("c_custkey") % 11 != 0, F.col("n_name")).alias("team"), names.alias("status"))


_INJ = """inj AS (SELECT c_name AS player_name, CASE WHEN c_custkey%11<>0 THEN n_name END AS team, c_custkey%5 AS severity,
 (['Out','Doubtful','Questionable','Day-To-Day','Probable'])[c_custkey%5+1] AS status FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey)"""


@query("injury_order", f"""WITH {_INJ} SELECT player_name, team, status, severity, row_number() OVER (ORDER BY severity, team NULLS LAST, player_name) AS position FROM inj""")
def injury_order(spark, d):
    """The report with each row's place in it, numbered over ranges of the report's order."""
    return C.numbered_report(injuries(spark, d)).select("player_name", "team", "status", "severity", "position")


@query("injury_counts", f"WITH {_INJ} SELECT 'nba' AS league, count(*) AS total, count(*) FILTER (status='Out') AS out FROM inj")
def injury_counts(spark, d):
    return C.injury_counts(injuries(spark, d))


@query("season_spine", f"""WITH {Q.BOX}, sp AS (SELECT 'nba' AS league, y::VARCHAR AS season FROM generate_series(1990, 2005) t(y)), n AS (SELECT league, season, count(DISTINCT game_id) AS games FROM box GROUP BY ALL)
SELECT league, season, coalesce(games,0) AS games FROM (SELECT * FROM sp UNION SELECT league, season FROM n) LEFT JOIN n USING (league, season)""")
def season_spine(spark, d):
    """Stored games per season over a generated range united with every label seen."""
    b = D.box(spark, d)
    spine = Y.season_spine(spark, "wnba", 1990, 2005).withColumn("league", F.lit("nba"))
    seen = D.table(spark, d, "orders").select(F.lit("nba").alias("league"), F.year("o_orderdate").cast("string").alias("season")).distinct()
    return C.games_by_season(b, C.season_options(spine, seen))


@query("season_labels", """SELECT DISTINCT o_orderdate::DATE AS day, CASE WHEN month(o_orderdate)>=8 THEN year(o_orderdate)||'-'||lpad(((year(o_orderdate)+1)%100)::VARCHAR,2,'0')
  ELSE (year(o_orderdate)-1)||'-'||lpad((year(o_orderdate)%100)::VARCHAR,2,'0') END AS split_label, year(o_orderdate)::VARCHAR AS single_label,
 CASE WHEN month(o_orderdate)>=7 THEN year(o_orderdate)||'-'||lpad(((year(o_orderdate)+1)%100)::VARCHAR,2,'0') ELSE (year(o_orderdate)-1)||'-'||lpad((year(o_orderdate)%100)::VARCHAR,2,'0') END AS current_label,
 (year(o_orderdate)-1)||'-'||lpad((year(o_orderdate)%100)::VARCHAR,2,'0') AS completed_label FROM orders""")
def season_labels(spark, d):
    o = D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return o.select("day", Y.season_label_from_date("day", "nba").alias("split_label"),
                    Y.season_label_from_date("day", "wnba").alias("single_label"),
                    Y.current_season_label("day", "nba").alias("current_label"),
                    Y.latest_completed_season("day", "nba").alias("completed_label"))


@query("latest_season", f"{GAMES} SELECT league, max(season) AS latest, max(season) FILTER (status='STATUS_FINAL') AS latest_played FROM games GROUP BY ALL")
def latest_season(spark, d):
    return C.latest_season(D.games(spark, d))


@query("merge_seasons", f"""{GAMES} SELECT season, game_id, home_score + CASE WHEN season IN ('1996','2001') THEN 1 ELSE 0 END AS home_score FROM games WHERE season<>'2001' OR game_id%2=0""")
def merge_seasons(spark, d):
    g = stage(D.games(spark, d), "games").select("league", "season", "game_id", "home_score")
    rebuilt = g.filter((F.col("season") == "1996") | ((F.col("season") == "2001") & (F.col("game_id") % 2 == 0))).withColumn(
        "home_score", F.col("home_score") + 1)
    return C.merge_seasons(g.filter(F.col("season") != "2001"), rebuilt).select("season", "game_id", "home_score")


@query("content_diff", f"""{GAMES} SELECT DISTINCT league, season FROM games WHERE game_id%997=0 OR season='2001'""")
def content_diff(spark, d):
    """Seasons whose rows changed between two versions (a score here and there, a season is new)."""
    g = stage(D.games(spark, d), "games").select("league", "season", "game_id", "home_score", F.lit("x").alias("stamp"))
    new = g.withColumn("home_score", F.when(F.col("game_id") % 997 == 0, -1).otherwise(F.col("home_score"))).withColumn("stamp", F.lit("y"))
    return C.changed_keys(g.filter(F.col("season") != "2001"), new, ["league", "season"])


@query("debuts", """SELECT 'nba' AS league, s_suppkey AS player_id, CASE WHEN s_suppkey%2=0 THEN 1995+s_suppkey%7 ELSE (SELECT min(year(o_orderdate)) FROM orders)::INT END AS debut FROM supplier WHERE s_suppkey%2=0 OR s_suppkey%3=0""")
def debuts(spark, d):
    p = D.players(spark, d)
    first = D.table(spark, d, "orders").agg(F.min(F.year("o_orderdate")).alias("y")).scalar()
    known = p.filter(F.col("player_id") % 2 == 0).select("league", "player_id", "debut")
    late = p.filter(F.col("player_id") % 3 == 0).withColumn("debut", first).select("league", "player_id", "debut")
    return C.resolve_debuts(known, late)


# --- snapshots ---------------------------------------------------------------------------------------

def arrivals(spark, d):
    """Race snapshots of the event log: per day and race the top 25 by points so far; the state only
    moves every third day, and every day arrives twice."""
    e = D.event_log(spark, d).withColumn("day", F.datediff(F.to_date("ts"), F.lit("2024-01-01")))
    per = e.groupBy("league", "season", F.col("event_type").alias("race"), "player_id", "day").agg(F.sum("score").alias("pts"))
    steps = per.select("league", "season", "race", "player_id", "pts", F.explode(F.expr("sequence(cast(ceil(day / 3.0) as int), 10)")).alias("step"))
    state = steps.groupBy("league", "season", "race", "player_id", "step").agg(F.sum("pts").cast("double").alias("score"))
    from ..functions.core import ranked
    top = ranked(state, ["league", "season", "race", "step"], [F.desc("score"), F.asc("player_id")], K.SNAPSHOT_TOP).withColumn(
        "player_name", F.concat(F.lit("P"), F.col("player_id").cast("string")))
    days = top.withColumn("day", F.explode(F.expr("sequence(step * 3, step * 3 + 2)")))
    return days.select("league", "season", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("snap_date"),
                       F.explode(F.array(F.lit(0), F.lit(1))).alias("arrival"), *N.ROW)


_SNAP = """per AS (SELECT event_type AS race, user_id AS player_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS day,
  sum(CASE WHEN event_type='error' THEN 0 ELSE floor(value+5e-1) END) AS pts FROM events GROUP BY ALL),
steps AS (SELECT race, player_id, pts, unnest(generate_series(ceil(day/3e0)::BIGINT, 10)) AS step FROM per),
st AS (SELECT race, player_id, step, sum(pts)::DOUBLE AS score FROM steps GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY race, step ORDER BY score DESC, player_id) AS rank FROM st QUALIFY rank<=25),
snap AS (SELECT 'wnba' AS league, '2024' AS season, (DATE '2024-01-01' + (step*3)::INT) AS snap_date, race, rank, player_id, 'P'||player_id AS player_name, score FROM top)"""


@query("race_snapshots", f"WITH {_SNAP} SELECT * FROM snap")
def race_snapshots(spark, d):
    return N.keep_changed(arrivals(spark, d))


def snapshots(spark, d):
    return stage(N.keep_changed(arrivals(spark, d)), "snapshots")


@query("race_movement", f"""WITH {_SNAP}, dd AS (SELECT DISTINCT snap_date, dense_rank() OVER (ORDER BY snap_date DESC) AS age FROM snap),
a AS (SELECT s.*, age FROM snap s JOIN dd USING (snap_date) WHERE age<=2)
SELECT n.league, n.season, n.race, n.player_id, p.rank-n.rank AS delta FROM a n JOIN a p ON n.race=p.race AND n.player_id=p.player_id AND n.age=1 AND p.age=2""")
def race_movement(spark, d):
    return N.race_movement(snapshots(spark, d))


@query("race_trend", f"""WITH {_SNAP}, l AS (SELECT race, player_id, player_name, rank AS latest_rank FROM snap WHERE snap_date=(SELECT max(snap_date) FROM snap) AND rank<=6),
dts AS (SELECT DISTINCT league, season, race, snap_date FROM snap)
SELECT t.league, t.season, t.race, t.snap_date, l.player_id, l.player_name, l.latest_rank, s.score FROM dts t JOIN l USING (race) LEFT JOIN snap s ON s.race=t.race AND s.snap_date=t.snap_date AND s.player_id=l.player_id""")
def race_trend(spark, d):
    return N.race_trend(snapshots(spark, d))


def official_names(t):
    """Stand-in official awards: most points and most steals plus blocks per season."""
    best = lambda race, c: t.groupBy("league", "season").agg(
        F.min_by("player_name", F.struct(-c, F.col("player_id"))).alias("player_name")).withColumn("race", F.lit(race))
    return best("mvp", F.col("pts")).unionByName(best("dpoy", F.col("stl") + F.col("blk")))


@query("official_vs_top", f"""WITH {Q.SEASON}, {MIP_CTE}, races AS ({RACES_SQL}), o AS (
 SELECT league, season, 'mvp' AS race, player_name FROM totals QUALIFY row_number() OVER (PARTITION BY season ORDER BY pts DESC, player_id)=1 UNION ALL
 SELECT league, season, 'dpoy', player_name FROM totals QUALIFY row_number() OVER (PARTITION BY season ORDER BY stl+blk DESC, player_id)=1),
t AS (SELECT league, season, race, player_name AS top FROM races WHERE rank=1)
SELECT league, season, race, top, o.player_name AS official, CASE WHEN top IS NULL OR o.player_name IS NULL THEN NULL WHEN top=o.player_name THEN 'agree' ELSE 'differs' END AS verdict
FROM t FULL JOIN o USING (league, season, race)""")
def official_vs_top(spark, d):
    t = stage(totals(spark, d), "totals")
    races = B.season_races(t, B.team_records(D.games(spark, d)), D.players(spark, d))
    return N.official_vs_top(races, official_names(t))


@query("finals_tracker", f"""WITH {Q.BOX}, {Q.GAMES}, {Q.RECORDS}, w AS (SELECT DISTINCT year(l_shipdate) AS year, l_suppkey AS player_id FROM lineitem JOIN part ON l_partkey=p_partkey
  WHERE l_quantity=50 AND floor(l_discount*100+5e-1)=10 AND p_type='ECONOMY'),
c AS (SELECT season_start+1 AS year, substr(team_abbrev,2)::BIGINT AS team_id FROM records QUALIFY row_number() OVER (PARTITION BY season_start ORDER BY wins DESC, team_abbrev)=1),
r AS (SELECT 'nba' AS league, (w.year-1)||'-'||lpad((w.year%100)::VARCHAR,2,'0') AS season, player_id, team_id, FALSE AS pending FROM w LEFT JOIN c USING (year))
SELECT * FROM r UNION ALL SELECT 'nba', '2003-04', NULL, NULL, TRUE WHERE '2003-04' NOT IN (SELECT season FROM r)""")
def finals_tracker(spark, d):
    from .career_queries import champions
    wins = D.award_wins(spark, d).filter(F.col("name") == "ECONOMY").select("league", "year", "player_id").distinct()
    return N.finals_tracker(wins, champions(spark, d), "2003-11-01")
