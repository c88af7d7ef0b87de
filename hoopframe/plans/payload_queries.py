"""Landed-payload ETL: JSON documents are built from the derived tables and flattened again.

Every document covers one source row (or one bounded list such as a top 40), so building them
never gathers a large group.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.core import half_up, ranked, ratio
from ..operators import boards as B
from ..sources import payloads as P
from ..sources.staging import stage
from . import bindings as D
from . import sqlparts as Q
from .board_queries import season_inputs, totals
from .registry import query
from .schedule_queries import HEADLINES, _HEAD_SQL, _INJ, _ROUND_SQL, headlines, injuries, standings

hu, pg = Q.hu, Q.pg
GAMES = f"WITH {Q.BOX}, {Q.GAMES}"
SPLIT_LABEL = ("CASE WHEN month(ts)>=8 THEN year(ts)||'-'||lpad(((year(ts)+1)%100)::VARCHAR,2,'0') "
               "ELSE (year(ts)-1)||'-'||lpad((year(ts)%100)::VARCHAR,2,'0') END")


def stamp(c="ts"):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm'Z'")


def js(**cols):
    """JSON object from columns, nulls left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in cols.items()]))


def side(own: str):
    """A competitor; the home score is an object, the away score bare text."""
    score = F.col(f"{own}_score").cast("string")
    value = F.concat(F.lit('{"value":'), score, F.lit('.0,"displayValue":"'), score, F.lit('"}')) if own == "home" else F.concat(
        F.lit('"'), score, F.lit('"'))
    return F.concat(F.lit(f'{{"homeAway":"{own}","score":'), value, F.lit(',"team":'),
                    js(id=F.col(f"{own}_id").cast("string"), abbreviation=F.col(f"{own}_abbrev")), F.lit("}"))


def competition(note=None, series=None):
    status = js(type=F.struct(F.col("status").alias("name"), F.col("state").alias("state")), period=F.lit(3), displayClock=F.lit("4:32"))
    parts = [F.lit('{"id":"'), F.col("game_id").cast("string"), F.lit('","date":"'), stamp(), F.lit('","neutralSite":'),
             F.lower("neutral"), F.lit(',"status":'), status, F.lit(',"competitors":['), side("home"), F.lit(","), side("away"), F.lit("]")]
    if note is not None:
        parts += [F.lit(',"notes":['), js(headline=note), F.lit("]")]
    if series is not None:
        parts += [F.lit(',"series":['), series, F.lit("]")]
    return F.concat(*parts, F.lit("}"))


def games_for_docs(spark, d):
    g = D.games(spark, d).join(headlines(spark, d).select("game_id", "headline"), "game_id")
    return g.withColumn("state", F.when(F.col("status") == K.FINAL, "post").otherwise("pre"))


def schedule_payloads(spark, d):
    g = games_for_docs(spark, d)
    doc = F.concat(F.lit('{"events":[{"id":"'), F.col("game_id").cast("string"), F.lit('","date":"'), stamp(), F.lit('","competitions":['),
                   competition(F.col("headline")), F.lit("]},{\"id\":\"0\",\"competitions\":[]}]}"))
    return g.select("league", doc.alias("payload"))


@query("flatten_schedule", f"""{GAMES} SELECT league, game_id, strftime(ts,'%Y-%m-%dT%H:%MZ') AS date, {SPLIT_LABEL} AS season, home_id, home_abbrev, home_score::DOUBLE AS home_score,
 away_id, away_abbrev, away_score::DOUBLE AS away_score, status, neutral='True' AS neutral, {_ROUND_SQL} AS round FROM games JOIN (SELECT o_orderkey, o_orderpriority FROM orders) o ON o_orderkey=game_id""")
def flatten_schedule(spark, d):
    return P.flatten_schedule(schedule_payloads(spark, d))


@query("flatten_scoreboard", f"""{GAMES} SELECT league, game_id::VARCHAR AS game_id, strftime(ts,'%Y-%m-%dT%H:%MZ') AS date, status, '3' AS period, '4:32' AS clock, home_abbrev AS home, away_abbrev AS away,
 CASE WHEN status='STATUS_FINAL' THEN home_score::VARCHAR END AS home_score, CASE WHEN status='STATUS_FINAL' THEN away_score::VARCHAR END AS away_score FROM games""")
def flatten_scoreboard(spark, d):
    return P.flatten_scoreboard(schedule_payloads(spark, d))


@query("flatten_event_rounds", f"""WITH r AS (SELECT 'nba' AS league, o_orderkey AS game_id, {_ROUND_SQL} AS round FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) SELECT * FROM r WHERE round IS NOT NULL""")
def flatten_event_rounds(spark, d):
    return P.flatten_event_rounds(schedule_payloads(spark, d))


LABELS = ("MIN", "FG", "3PT", "FT", "OREB", "DREB", "REB", "AST", "STL", "BLK", "TO", "PF", "+/-", "PTS")


def box_payloads(spark, d):
    """One summary document per player row."""
    b = D.box(spark, d).withColumns({
        "home_id": F.when(F.col("is_home"), F.col("team_id")).otherwise(F.col("opponent_id")),
        "home_abbrev": F.when(F.col("is_home"), F.col("team_abbrev")).otherwise(F.col("opponent_abbrev")),
        "away_id": F.when(F.col("is_home"), F.col("opponent_id")).otherwise(F.col("team_id")),
        "away_abbrev": F.when(F.col("is_home"), F.col("opponent_abbrev")).otherwise(F.col("team_abbrev")),
        "home_score": F.lit(1), "away_score": F.lit(0), "status": F.lit(K.FINAL), "state": F.lit("post"), "neutral": F.lit("False")})
    s = lambda c: F.col(c).cast("string")
    pair = lambda m, a: F.concat(s(m), F.lit("-"), s(a))
    cells = {"MIN": F.coalesce(s("min"), F.lit("--")), "FG": pair("fgm", "fga"), "3PT": pair("fg3m", "fg3a"), "FT": pair("ftm", "fta"),
             "+/-": s("plus_minus"), **{la: s(K.BOX_LABELS[la]) for la in ("OREB", "DREB", "REB", "AST", "STL", "BLK", "TO", "PF", "PTS")}}
    stats = F.when(F.col("did_not_play"), F.array().cast("array<string>")).otherwise(F.array(*[cells[la] for la in LABELS]))
    athlete = F.struct(F.struct(s("player_id").alias("id"), F.col("player_name").alias("displayName")).alias("athlete"),
                       F.col("starter"), F.col("did_not_play").alias("didNotPlay"), stats.alias("stats"))
    block = F.struct(F.struct(s("team_id").alias("id"), F.col("team_abbrev").alias("abbreviation")).alias("team"),
                     F.array(F.struct(F.array(*[F.lit(x) for x in LABELS]).alias("labels"), F.array(athlete).alias("athletes"))).alias("statistics"))
    stray = F.struct(F.struct(F.lit("999999").alias("id"), F.lit("X").alias("abbreviation")).alias("team"), block["statistics"].alias("statistics"))
    doc = F.concat(F.lit('{"header":{"competitions":['), competition(), F.lit(']},"boxscore":{"players":'),
                   F.to_json(F.when(F.col("game_id") % 10 == 0, F.array(block, stray)).otherwise(F.array(block))), F.lit("}}"))
    return b.select("league", doc.alias("payload"))


BOX_OUT = ("game_id", "team_id", "team_abbrev", "opponent_id", "opponent_abbrev", "is_home", "player_id", "player_name", "starter",
           "did_not_play", "min", *D.STATS, "plus_minus")


@query("flatten_box_score", f"""WITH {Q.BOX} SELECT game_id, strftime(ts,'%Y-%m-%dT%H:%MZ') AS date, {SPLIT_LABEL} AS season, team_id, team_abbrev, opponent_id,
 'T'||lpad(opponent_id::VARCHAR,4,'0') AS opponent_abbrev, is_home, player_id, player_name, starter, did_not_play, "min", {', '.join(f'"{s}"' for s in D.STATS)}, plus_minus FROM box""")
def flatten_box_score(spark, d):
    return P.flatten_box_score(box_payloads(spark, d)).drop("league")


@query("flatten_standings", f"""WITH {Q.BOX}, {Q.GAMES}, {Q.RECORDS}, s AS (SELECT season, substr(team_abbrev,2)::BIGINT AS team_id, team_abbrev AS team, wins, losses,
 CASE WHEN substr(team_abbrev,2)::BIGINT%2=0 THEN 'Eastern Conference' ELSE 'Western Conference' END AS conference, win_pct FROM records)
SELECT season, team_id, team, conference, wins, losses, regexp_replace(printf('%.3f', floor(win_pct*1000+5e-1)/1000e0), '^0', '') AS win_percent,
 row_number() OVER (PARTITION BY season, conference ORDER BY wins DESC, team) AS playoff_seed FROM s""")
def flatten_standings(spark, d):
    """Entries at the root, under a conference, under its division and five levels down, by team."""
    s = standings(spark, d)
    stat = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("displayValue"))
    entry = F.struct(F.struct(F.col("team_id").cast("string").alias("id"), F.col("team").alias("displayName")).alias("team"),
                     F.array(stat("wins", "wins"), stat("losses", "losses"), stat("winPercent", "win_percent"),
                             stat("playoffSeed", "playoff_seed"), stat("other", "team")).alias("stats"))
    division = F.struct(F.lit("Division").alias("name"), F.struct(F.array(entry).alias("entries")).alias("standings"))
    deep = division
    for name in ("Section", "Group", "Pool"):
        deep = F.struct(F.lit(name).alias("name"), F.array(deep).alias("children"))
    under = lambda *kids: js(children=F.array(F.struct(F.col("conference").alias("name"), *kids)))
    place = F.col("team_id") % 4
    doc = (F.when(place == 0, under(F.array(division).alias("children"))).when(place == 1, under(F.array(entry).alias("entries")))
           .when(place == 2, under(F.array(deep).alias("children")))
           .otherwise(js(name=F.col("conference"), standings=F.struct(F.array(entry).alias("entries")))))
    return P.flatten_standings(s.select("league", "season", doc.alias("payload"))).select(
        "season", "team_id", "team", "conference", "wins", "losses", "win_percent", "playoff_seed")


@query("flatten_teams", """WITH t AS (SELECT DISTINCT o_custkey//25 AS team_id FROM orders) SELECT team_id, 'T'||lpad(team_id::VARCHAR,4,'0') AS abbrev, 'Team '||team_id AS display_name FROM t""")
def flatten_teams(spark, d):
    t = D.table(spark, d, "orders").select(F.floor(F.col("o_custkey") / 25).alias("id")).distinct()
    team = F.struct(F.struct(F.col("id").cast("string").alias("id"), D.abbrev(F.col("id")).alias("abbreviation"),
                             F.concat(F.lit("Team "), F.col("id").cast("string")).alias("displayName")).alias("team"))
    doc = js(sports=F.array(F.struct(F.array(F.struct(F.array(team).alias("teams"))).alias("leagues"))))
    return P.flatten_teams(t.select(F.lit("nba").alias("league"), doc.alias("payload"))).select("team_id", "abbrev", "display_name")


@query("flatten_injuries", f"WITH {_INJ} SELECT player_name, team, status FROM inj")
def flatten_injuries(spark, d):
    row = F.struct(F.col("status"), F.struct(F.col("player_name").alias("displayName")).alias("athlete"))
    doc = js(injuries=F.array(F.struct(F.col("team").alias("displayName"), F.array(row).alias("injuries"))))
    return P.flatten_injuries(injuries(spark, d).select("league", doc.alias("payload"))).select("player_name", "team", "status")


@query("flatten_roster", """SELECT s_suppkey AS player_id, s_name AS player_name, CASE s_suppkey%4 WHEN 0 THEN 'G' WHEN 1 THEN 'F' WHEN 2 THEN 'C' ELSE 'Bench' END AS position,
 s_suppkey % (SELECT max(o_custkey)//25+1 FROM orders) AS team_id FROM supplier""")
def flatten_roster(spark, d):
    p = D.players(spark, d)
    own = F.when(F.col("position").isNotNull(), F.struct(F.col("position").alias("abbreviation")))
    a = F.struct(F.col("player_id").cast("string").alias("id"), F.col("player_name").alias("displayName"), own.alias("position"))
    doc = js(team=F.struct(F.col("team_id").cast("string").alias("id")), positionGroups=F.array(F.struct(F.lit("Bench").alias("position"), F.array(a).alias("athletes"))))
    return P.flatten_roster(p.select("league", doc.alias("payload"))).drop("league")


#: Ids of players that one document of leaders covers: bounds the group that it gathers.
PLAYERS_A_DOC = 1_000


def leader_payload(spark, d, t):
    """Documents of a season, one for every range of player ids: all players of three categories as links."""
    part = F.floor(F.col("player_id") / PLAYERS_A_DOC).alias("_part")
    long = t.select("season", part, "player_id", F.col("team_abbrev"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("cat"), F.col(c).alias("v")) for i, c in enumerate(("pts", "reb", "ast"))])).alias("s")).select("*", "s.*")
    top = ranked(long, ["season", "_part", "cat"], [F.desc("v"), F.asc("player_id")], None)
    ref = lambda kind, c: F.struct(F.concat(F.lit(f"http://x/{kind}/"), c.cast("string"), F.lit("?lang=en")).alias("$ref"))
    entry = F.struct("rank", ref("athletes", F.col("player_id")).alias("athlete"), ref("teams", F.substring("team_abbrev", 2, 9).cast("bigint")).alias("team"))
    cats = top.groupBy("season", "_part", "cat").agg(F.array_sort(F.collect_list(entry)).alias("leaders"))
    docs = cats.groupBy("season", "_part").agg(F.array_sort(F.collect_list(F.struct("cat", "leaders"))).alias("categories"))
    return docs.select(F.concat(F.lit("nba:"), F.col("season")).alias("league"), js(categories=F.col("categories")).alias("payload"))


_CAND = """long AS (SELECT season, player_id, team_abbrev, 0 AS cat, pts AS v FROM totals UNION ALL SELECT season, player_id, team_abbrev, 1, reb FROM totals UNION ALL SELECT season, player_id, team_abbrev, 2, ast FROM totals),
top AS (SELECT *, row_number() OVER (PARTITION BY season, cat ORDER BY v DESC, player_id) AS rn FROM long),
cand AS (SELECT DISTINCT season, player_id, substr(team_abbrev,2)::BIGINT AS team_id FROM top)"""


@query("leader_candidates", f"WITH {Q.BOX}, {Q.TOTALS}, {_CAND} SELECT 'nba:'||season AS league, player_id, team_id FROM cand")
def leader_candidates(spark, d):
    return P.leader_candidates(leader_payload(spark, d, totals(spark, d)))


def totals_payload(t):
    """Season totals spread over two categories; points appear twice, the first one counts."""
    stat = lambda n, c: F.struct(F.lit(n).alias("name"), c.cast("double").alias("value"))
    names = {v: k for k, v in K.TOTAL_STATS.items()}
    general = [stat(names[c], F.col(c)) for c in ("gp", "reb", "oreb", "dreb", "pf", "to", "stl", "blk")]
    offence = [stat(names[c], F.col(c)) for c in ("pts", "ast", "fgm", "fga", "ftm", "fta")] + [stat(names["pts"], F.lit(-1))]
    cats = F.array(F.struct(F.lit("general").alias("name"), F.array(*general).alias("stats")),
                   F.struct(F.lit("offensive").alias("name"), F.array(*offence).alias("stats")))
    return F.when(F.col("player_id") % 2 == 0, js(splits=F.struct(cats.alias("categories")))).otherwise(
        js(splits=F.array(F.struct(cats.alias("categories")))))


_TS = ", ".join(f'"{c}"' for c in K.TOTAL_STATS.values())


@query("athlete_totals", f"WITH {Q.BOX}, {Q.TOTALS} SELECT season, player_id, {_TS} FROM totals")
def athlete_totals(spark, d):
    t = totals(spark, d)
    return P.flatten_athlete_totals(t.select("season", "player_id", totals_payload(t).alias("payload")))


@query("career_line", f"""WITH {Q.BOX}, {Q.TOTALS} SELECT season, player_id, gp, 0 AS starts, pts+1 AS pts, reb, ast FROM totals""")
def career_line(spark, d):
    """Of a repeated stat the last value counts here, fractions are rounded."""
    t = totals(spark, d)
    stat = lambda n, c: F.struct(F.lit(n).alias("name"), c.cast("double").alias("value"))
    stats = F.array(stat("gamesPlayed", F.col("gp")), stat("points", F.col("pts")), stat("rebounds", F.col("reb") + 0.3),
                    stat("assists", F.col("ast") - 0.3), stat("points", F.col("pts") + 1))
    doc = js(splits=F.struct(F.array(F.struct(F.lit("all").alias("name"), stats.alias("stats"))).alias("categories")))
    return P.flatten_career_line(t.select("season", "player_id", doc.alias("payload"))).select(
        "season", "player_id", "gp", "starts", "pts", "reb", "ast")


@query("season_averages", f"""WITH {Q.BOX}, {Q.TOTALS} SELECT player_id, season_start AS year, team_abbrev AS team, gp, {pg('pts')} AS pts, {hu('fgm::DOUBLE/gp', 1)} AS fg_pct FROM totals""")
def season_averages(spark, d):
    """Labelled positional cells of a career document (one row per season), back to records."""
    t = totals(spark, d)
    made = F.concat(half_up(ratio("fgm", "gp"), 1).cast("string"), F.lit("-"), half_up(ratio("fga", "gp"), 1).cast("string"))
    row = F.struct(F.col("season_start").alias("o"), F.struct(F.col("season_start").alias("year")).alias("season"),
                   F.lower("team_abbrev").alias("teamSlug"), F.substring("team_abbrev", 2, 9).alias("teamId"),
                   F.array(F.col("gp").cast("string"), half_up(ratio("pts", "gp"), 1).cast("string"), made).alias("stats"))
    docs = t.groupBy("league", "player_id").agg(F.sort_array(F.collect_list(row), asc=False).alias("statistics"),
                                                 F.collect_set("team_abbrev").alias("teams"))
    slugs = F.map_from_entries(F.transform("teams", lambda x: F.struct(F.lower(x), F.struct(x.alias("abbreviation")))))
    doc = js(teams=slugs, categories=F.array(F.struct(F.lit("averages").alias("name"), F.array(*[F.lit(x) for x in ("gp", "pts", "fg%")]).alias("labels"), F.col("statistics"))))
    out = P.flatten_season_averages(docs.select("league", "player_id", doc.alias("payload")))
    return out.select("player_id", F.explode("rows").alias("r")).select("player_id", "r.year", "r.team", "r.gp", "r.pts", "r.fg_pct")


@query("flatten_plays", """SELECT event_id AS game_id, 'Q'||(event_id%4+1) AS period, event_type AS description, (event_id%100)||':'||(event_id%90) AS score, event_type='purchase' AS scoring
 FROM events WHERE event_type<>'error'""")
def flatten_plays(spark, d):
    e = D.event_log(spark, d)
    k = F.col("game_id")
    s = lambda c: c.cast("string")
    play = F.struct(F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("text"),
                    F.struct(F.concat(F.lit("Q"), s(k % 4 + 1)).alias("displayValue")).alias("period"),
                    (k % 100).alias("awayScore"), (k % 90).alias("homeScore"), (F.col("event_type") == "purchase").alias("scoringPlay"))
    out = P.flatten_plays(e.select("game_id", js(plays=F.array(play)).alias("payload")))
    return out.select("game_id", "period", "description", "score", "scoring")


_AD = """d AS (SELECT 'nba' AS league, CASE WHEN p_type='ECONOMY' THEN 43 ELSE 33 END AS award_type, year(l_shipdate) AS year, p_type AS name, l_suppkey AS player_id, l_suppkey%30 AS t FROM lineitem
 JOIN part ON l_partkey=p_partkey WHERE l_quantity=50 AND floor(l_discount*100+5e-1)=10)"""


@query("award_detail", f"WITH {_AD} SELECT league, award_type, year, name, player_id, CASE WHEN award_type=43 THEN t END AS champion_team_id FROM d")
def award_detail(spark, d):
    w = D.award_wins(spark, d).withColumn("award_type", F.when(F.col("name") == "ECONOMY", 43).otherwise(33))
    ref = lambda kind, c: F.struct(F.concat(F.lit(f"http://x/seasons/2000/{kind}/"), c.cast("string"), F.lit("?lang=en")).alias("$ref"))
    win = F.struct(ref("athletes", F.col("player_id")).alias("athlete"), ref("teams", F.col("player_id") % 30).alias("team"))
    return P.flatten_award_detail(w.select("league", "award_type", "year", js(name=F.col("name"), winners=F.array(win)).alias("payload")))


@query("award_facts", f"WITH {_AD} SELECT league, award_type, year, name, player_id, t AS champion_team_id FROM d")
def award_facts(spark, d):
    """The cached form: a map '{type}-{year}' -> facts."""
    w = D.award_wins(spark, d).withColumn("award_type", F.when(F.col("name") == "ECONOMY", 43).otherwise(33))
    entry = F.struct("name", F.array("player_id").alias("athletes"), (F.col("player_id") % 30).alias("champion"))
    doc = F.to_json(F.create_map(F.concat_ws("-", "award_type", "year"), entry))
    return P.read_award_facts(w.select("league", doc.alias("payload")))


@query("athlete_bundles", f"""WITH {Q.BOX}, {Q.TOTALS} SELECT player_id, season_start AS year, team_abbrev AS team, gp, {pg('pts')} AS pts FROM totals""")
def athlete_bundles(spark, d):
    """The cached form: a map id -> bundle whose season rows are positional."""
    t = totals(spark, d)
    s = lambda c: F.col(c).cast("string")
    cells = F.array(s("season_start"), F.substring("team_abbrev", 2, 9), F.col("team_abbrev"), s("gp"), F.lit("0"),
                    half_up(ratio("pts", "gp"), 1).cast("string"))
    doc = F.to_json(F.create_map(s("player_id"), F.struct(F.col("player_name").alias("name"), F.array(cells).alias("rows"))))
    b = P.read_bundles(t.select("league", doc.alias("payload")))
    return b.select("player_id", F.explode("rows").alias("r")).select("player_id", "r.year", "r.team", "r.gp", "r.pts")


@query("finals_series", f"""{GAMES}, h AS (SELECT o_orderkey, o_orderpriority FROM orders)
SELECT game_id AS latest_id, unnest(CASE WHEN game_id%2=0 THEN [game_id] ELSE [game_id+1, game_id] END) AS game_id FROM games JOIN h ON o_orderkey=game_id
 WHERE o_orderpriority='3-MEDIUM' OR (o_orderpriority='5-LOW' AND game_id%3=0)""")
def finals_series(spark, d):
    g = games_for_docs(spark, d)
    k = F.col("game_id")
    desc = F.when(F.col("headline").startswith("NBA Finals"), "NBA Finals").when(F.col("headline") == "", "Playoff Series").otherwise("East Conference Finals")
    ev = F.when(k % 2 == 1, F.array(F.struct((k + 1).cast("string").alias("id")))).otherwise(F.array(F.struct(k.cast("string").alias("id"))))
    block = js(type=F.lit("playoff"), description=desc, totalCompetitions=F.when(k % 3 == 0, 7).otherwise(5), events=ev)
    doc = F.concat(F.lit('{"header":{"competitions":['), competition(series=block), F.lit("]}}"))
    return P.finals_series(g.select("league", doc.alias("payload"))).select("latest_id", "game_id")


def live_inputs(spark, d):
    """Candidates, lines, teams and standings of every season, the season inside the league key."""
    t, r, _ = season_inputs(spark, d)
    t = stage(t, "totals")
    lg = F.concat(F.lit("nba:"), F.col("season"))
    cand = P.leader_candidates(leader_payload(spark, d, t))
    lines = P.flatten_athlete_totals(t.select(lg.alias("league"), "player_id", totals_payload(t).alias("payload"))).withColumn(
        "player_name", F.concat(F.lit("Player "), F.col("player_id").cast("string")))
    teams = r.select(lg.alias("league"), F.substring("team_abbrev", 2, 9).cast("bigint").alias("team_id"), F.col("team_abbrev").alias("abbrev"))
    stand = r.select(lg.alias("league"), F.substring("team_abbrev", 2, 9).cast("bigint").alias("team_id"), "wins", "losses")
    return cand, lines, teams, stand


_LIVE = f"""ll AS (SELECT 'nba:'||t.season AS league, t.*  EXCLUDE (league, player_name, minutes, starts), 'Player '||t.player_id AS player_name FROM totals t JOIN cand c ON c.season=t.season AND c.player_id=t.player_id WHERE gp>0),
lb AS (SELECT league, greatest(1,(max(gp)+1)//2) AS min_gp FROM ll GROUP BY ALL),
lr AS (SELECT 'nba:'||season AS league, team_abbrev, wins, losses, CASE WHEN wins+losses>0 THEN wins::DOUBLE/(wins+losses) ELSE 5e-1 END AS win_pct FROM records)"""
_LIVE_MVP = f"""SELECT league, player_id, player_name, team_abbrev, gp, {pg('pts')} AS ppg, wins, losses, {hu('coalesce(win_pct,5e-1)', 3)} AS win_pct,
 {hu(f'{Q.GS}/gp*(6e-1+4e-1*coalesce(win_pct,5e-1))', 2)} AS score FROM ll JOIN lb USING (league) LEFT JOIN lr USING (league, team_abbrev) WHERE gp>=min_gp"""


@query("live_mvp", f"""WITH {Q.BOX}, {Q.GAMES}, {Q.TOTALS}, {Q.RECORDS}, {_CAND}, {_LIVE}
SELECT *, row_number() OVER (PARTITION BY league ORDER BY score DESC, ppg DESC, player_name, player_id) AS rank FROM ({_LIVE_MVP}) QUALIFY rank<=10""")
def live_mvp(spark, d):
    return B.live_mvp(*live_inputs(spark, d)).select("league", "player_id", "player_name", "team_abbrev", "gp", "ppg", "wins", "losses", "win_pct", "score", "rank")


@query("live_roy", f"""WITH {Q.BOX}, {Q.TOTALS}, {_CAND}, ll AS (SELECT 'nba:'||t.season AS league, t.* EXCLUDE (league, player_name), s_name AS player_name FROM totals t JOIN cand c ON c.season=t.season AND c.player_id=t.player_id
  JOIN supplier ON s_suppkey=t.player_id WHERE gp>0 AND t.player_id%7=3 AND t.player_id%5<>0), lb AS (SELECT league, greatest(1,(max(gp)+1)//2) AS min_gp FROM ll GROUP BY ALL)
SELECT league, player_id, player_name, gp, {pg('pts')} AS ppg, {hu(f'{Q.GS}/gp', 2)} AS score, row_number() OVER (PARTITION BY league ORDER BY {hu(f'{Q.GS}/gp', 2)} DESC, {pg('pts')} DESC, player_name, player_id) AS rank
 FROM ll JOIN lb USING (league) WHERE gp>=min_gp QUALIFY rank<=10""")
def live_roy(spark, d):
    """Draft class of 1998; every fifth player has no draft year."""
    cand, lines, teams, _ = live_inputs(spark, d)
    p = D.players(spark, d).select("player_id", "player_name", F.when(F.col("player_id") % 5 != 0, F.col("debut")).alias("draft_year"))
    prof = lines.select("league", "player_id").distinct().join(p, "player_id")
    return B.live_roy(cand, prof, lines, teams, 1998).select("league", "player_id", "player_name", "gp", "ppg", "score", "rank")
