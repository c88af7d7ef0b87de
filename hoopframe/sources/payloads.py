"""Landed JSON payloads to rows.

Input is a table with ``league`` and ``payload`` (JSON text), one document per row.  Every
flattener parses with an explicit schema and explodes; unknown fields are dropped, missing ones
stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as X
from ..functions.core import case_map, first_by
from ..functions.seasons import season_label_from_date
from .staging import stage

_SIDE = "STRUCT<homeAway: STRING, score: STRING, team: STRUCT<id: STRING, abbreviation: STRING>>"
_STATUS = ("STRUCT<period: STRING, clock: STRING, displayClock: STRING, "
           "type: STRUCT<name: STRING, state: STRING>>")
_COMP = (f"STRUCT<id: STRING, date: STRING, competitors: ARRAY<{_SIDE}>, status: {_STATUS}, neutralSite: BOOLEAN, "
         "notes: ARRAY<STRUCT<headline: STRING>>, series: ARRAY<STRUCT<type: STRING, description: STRING, "
         "totalCompetitions: STRING, events: ARRAY<STRUCT<id: STRING>>>>>")
EVENTS = f"STRUCT<events: ARRAY<STRUCT<id: STRING, date: STRING, competitions: ARRAY<{_COMP}>>>>"
_ATHLETE = ("STRUCT<athlete: STRUCT<id: STRING, displayName: STRING, shortName: STRING>, starter: BOOLEAN, "
            "didNotPlay: BOOLEAN, stats: ARRAY<STRING>>")
HEADER = f"STRUCT<header: STRUCT<gameDate: STRING, competitions: ARRAY<{_COMP}>>>"
SUMMARY = (f"STRUCT<header: STRUCT<gameDate: STRING, competitions: ARRAY<{_COMP}>>, boxscore: STRUCT<players: ARRAY<"
           "STRUCT<team: STRUCT<id: STRING, abbreviation: STRING>, statistics: ARRAY<STRUCT<labels: ARRAY<STRING>, "
           f"athletes: ARRAY<{_ATHLETE}>>>>>>>")


def parsed(raw: DataFrame, schema: str) -> DataFrame:
    """``p``: the payload as a struct, all other columns kept.

    Parsed through a one-element explode: columns and filters built on ``p`` then share one parse
    instead of repeating it in every expression.
    """
    keep = [F.col(c) for c in raw.columns if c != "payload"]
    return raw.select(*keep, F.explode(F.array(F.from_json("payload", schema))).alias("p"))


def _last(items: Column, test) -> Column:
    """Last array element passing a test (later entries of a key replace earlier ones)."""
    return F.try_element_at(F.filter(items, test), F.lit(-1))


def _named(items: Column, name: str) -> Column:
    return _last(items, lambda x: x["name"] == name)


def _first_of(items: Column) -> Column:
    return F.get(items, 0)


def score_value(score: Column) -> Column:
    """A score is bare text or an object with a ``value``."""
    return F.coalesce(X.to_double(F.get_json_object(score, "$.value")), X.to_double(score))


def _sides(df: DataFrame, comp: str = "c") -> DataFrame:
    """Home and away competitor of a competition; events lacking a side are dropped."""
    return (df.withColumn("home", _last(F.col(f"{comp}.competitors"), lambda x: x["homeAway"] == "home"))
            .withColumn("away", _last(F.col(f"{comp}.competitors"), lambda x: x["homeAway"] == "away"))
            .filter(F.col("home").isNotNull() & F.col("away").isNotNull()))


def _side_columns(score) -> list[Column]:
    return [c for s in ("home", "away") for c in (
        F.col(f"{s}.team.id").try_cast("bigint").alias(f"{s}_id"),
        F.col(f"{s}.team.abbreviation").alias(f"{s}_abbrev"),
        score(F.col(f"{s}.score")).alias(f"{s}_score"))]


# --- schedule, scoreboard, rounds -----------------------------------------------------------------

def _events(raw: DataFrame) -> DataFrame:
    return parsed(raw, EVENTS).withColumn("e", F.explode("p.events")).drop("p").withColumn(
        "c", _first_of(F.col("e.competitions"))).filter(F.col("c").isNotNull())


def flatten_schedule(raw: DataFrame) -> DataFrame:
    """Game rows of team schedules; a ``season`` column of the input overrides the date's season."""
    df = _sides(_events(raw))
    date = F.coalesce("e.date", "c.date")
    by_date = season_label_from_date(F.to_date(F.substring(date, 1, 10)), F.col("league"))
    season = F.coalesce("season", by_date) if "season" in raw.columns else by_date
    return df.select(
        "league", F.col("e.id").try_cast("bigint").alias("game_id"), date.alias("date"), season.alias("season"),
        *_side_columns(score_value), F.col("c.status.type.name").alias("status"),
        F.coalesce("c.neutralSite", F.lit(False)).alias("neutral"),
        X.round_label(_first_of(F.col("c.notes"))["headline"]).alias("round"))


def flatten_scoreboard(raw: DataFrame) -> DataFrame:
    """A day's events; scores stay null until a game has started, period and clock as they come."""
    df = _events(raw)
    df = df.withColumn("home", _last(F.col("c.competitors"), lambda x: x["homeAway"] == "home")).withColumn(
        "away", _last(F.col("c.competitors"), lambda x: x["homeAway"] == "away"))
    started = X.game_started("c.status.type.state", "c.status.type.name")
    text = lambda s: F.nullif(F.coalesce(F.get_json_object(s, "$.displayValue"), F.get_json_object(s, "$.value"), s), F.lit(""))
    clock = F.when(F.col("c.status.displayClock").contains(":"), F.col("c.status.displayClock")).otherwise(F.col("c.status.clock"))
    return df.select(
        "league", F.col("e.id").alias("game_id"), F.col("e.date").alias("date"), F.col("c.status.type.name").alias("status"),
        F.coalesce(F.get_json_object("c.status.period", "$.displayValue"), "c.status.period").alias("period"), clock.alias("clock"),
        F.col("home.team.abbreviation").alias("home"), F.col("away.team.abbreviation").alias("away"),
        F.when(started, text(F.col("home.score"))).alias("home_score"), F.when(started, text(F.col("away.score"))).alias("away_score"))


def flatten_event_rounds(raw: DataFrame) -> DataFrame:
    """(game_id, round) of events with a note."""
    return _events(raw).select("league", F.col("e.id").try_cast("bigint").alias("game_id"), X.round_label(
        _first_of(F.col("c.notes"))["headline"]).alias("round")).filter(F.col("round").isNotNull())


# --- box score -----------------------------------------------------------------------------------------

_CELLS = (*K.BOX_LABELS, *K.BOX_SPLIT_LABELS)


def _places(back: Column) -> Column:
    """Index of the last column under every known label (null when the block lacks it); labels from last to first."""
    found = F.transform(F.array(*[F.lit(la) for la in _CELLS]), lambda la: F.array_position(back, la))
    return F.transform(found, lambda n: F.when(n > 0, (F.size(back) - n).cast("int")))


def flatten_box_score(raw: DataFrame) -> DataFrame:
    """Player rows of game summaries; blocks of teams outside the header are dropped.

    A player who did not play (or has no stats) has zeros and min 0, plus_minus stays null.  The
    labels are looked up once per team block, each player's cell is then an array access.  Cells are
    read in one transform each for numbers and pairs: an expression per cell makes generated
    methods longer than the JVM compiles, which then run interpreted.
    """
    df = parsed(raw, SUMMARY).withColumn("c", _first_of(F.col("p.header.competitions")))
    df = _sides(df).withColumn("b", F.explode("p.boxscore.players")).withColumn("g", _first_of(F.col("b.statistics")))
    home, away = F.col("home.team.id").try_cast("bigint"), F.col("away.team.id").try_cast("bigint")
    team = X.to_long("b.team.id")
    date = F.coalesce("c.date", "p.header.gameDate")
    head = ("league", "game_id", "date", "season", "team_id", "team_abbrev", "opponent_id", "opponent_abbrev", "is_home")
    df = df.filter(F.col("g").isNotNull() & ((team == home) | (team == away)))
    df = df.withColumn("back", F.explode(F.array(F.reverse("g.labels"))))  # exploded, so that it is reversed once
    rows = df.select(
        "league", F.col("c.id").try_cast("bigint").alias("game_id"), date.alias("date"),
        season_label_from_date(F.to_date(F.substring(date, 1, 10)), F.col("league")).alias("season"),
        team.alias("team_id"), F.col("b.team.abbreviation").alias("team_abbrev"),
        F.when(team == home, away).otherwise(home).alias("opponent_id"),
        F.when(team == home, F.col("away.team.abbreviation")).otherwise(F.col("home.team.abbreviation")).alias("opponent_abbrev"),
        (team == home).alias("is_home"), _places(F.col("back")).alias("at"), F.explode("g.athletes").alias("a"))
    stats = F.col("a.stats")
    dnp = F.coalesce("a.didNotPlay", F.lit(False))
    idle = F.when(dnp | (F.coalesce(F.size(stats), F.lit(0)) <= 0), F.lit(0))
    n = len(K.BOX_LABELS)
    numbers = F.transform(F.slice("at", 1, n), lambda i: X.to_long(F.get(stats, i)))
    pairs = F.transform(F.slice("at", n + 1, len(_CELLS) - n), lambda i: F.struct(
        X.made(F.get(stats, i)).alias("made"), X.attempted(F.get(stats, i)).alias("attempted")))
    rows = rows.filter(F.col("a.athlete.id").isNotNull()).select(
        *head, F.explode(F.array(F.struct(F.col("a"), dnp.alias("dnp"), idle.alias("idle"), numbers.alias("numbers"), pairs.alias("pairs")))).alias("y"))
    a, idle = F.col("y.a"), F.col("y.idle")
    cells = {col: F.get("y.numbers", i) for i, col in enumerate(K.BOX_LABELS.values())}
    for i, (m, t) in enumerate(K.BOX_SPLIT_LABELS.values()):
        cells[m], cells[t] = F.get("y.pairs", i)["made"], F.get("y.pairs", i)["attempted"]
    filled = {c: v if c == "plus_minus" else F.coalesce(v, idle) for c, v in cells.items()}
    filled["min"] = F.coalesce(idle, cells["min"])
    return rows.select(
        *head, a["athlete"]["id"].try_cast("bigint").alias("player_id"),
        F.coalesce(F.nullif(a["athlete"]["displayName"], F.lit("")), a["athlete"]["shortName"]).alias("player_name"),
        F.coalesce(a["starter"], F.lit(False)).alias("starter"), F.col("y.dnp").alias("did_not_play"),
        *[v.cast("bigint").alias(c) for c, v in filled.items()])


def flatten_box_meta(raw: DataFrame) -> DataFrame:
    """Game header of summaries."""
    df = _sides(parsed(raw, HEADER).withColumn("c", _first_of(F.col("p.header.competitions"))))
    date = F.coalesce("c.date", "p.header.gameDate")
    return df.select("league", F.col("c.id").try_cast("bigint").alias("game_id"), date.alias("date"),
                     season_label_from_date(F.to_date(F.substring(date, 1, 10)), F.col("league")).alias("season"),
                     *_side_columns(score_value), F.col("c.status.type.name").alias("status"))


def flatten_plays(raw: DataFrame) -> DataFrame:
    """Play-by-play rows with running score; plays without text are skipped."""
    play = ("STRUCT<text: STRING, shortDescription: STRING, period: STRING, clock: STRING, awayScore: STRING, "
            "homeScore: STRING, scoringPlay: BOOLEAN>")
    df = parsed(raw, f"STRUCT<plays: ARRAY<{play}>>").select("*", F.posexplode("p.plays").alias("pos", "y")).drop("p")
    text = F.trim(F.coalesce(F.nullif("y.text", F.lit("")), "y.shortDescription"))
    keep = [c for c in raw.columns if c != "payload"]
    return df.select(*keep, "pos", F.get_json_object("y.period", "$.displayValue").alias("period"),
                     F.get_json_object("y.clock", "$.displayValue").alias("clock"), text.alias("description"),
                     F.concat(F.coalesce("y.awayScore", F.lit("")), F.lit(":"), F.coalesce("y.homeScore", F.lit(""))).alias("score"),
                     F.coalesce("y.scoringPlay", F.lit(False)).alias("scoring")).filter(F.col("description") != "")


def filter_plays(plays: DataFrame, period: str | None = None, scoring_only: bool = False) -> DataFrame:
    out = plays if period is None else plays.filter(F.col("period") == period)
    return out.filter("scoring") if scoring_only else out


def finals_series(raw: DataFrame) -> DataFrame:
    """(league, game_id) of the finals series named in a summary, the summary's own game included.

    The block is a play-off series whose description has 'Finals' but not 'Conference', or a generic
    one of at least 7 games or with the season over (input column ``season_over``).
    """
    df = parsed(raw, HEADER).withColumn("c", _first_of(F.col("p.header.competitions")))
    over = F.coalesce("season_over", F.lit(False)) if "season_over" in raw.columns else F.lit(False)

    def is_finals(s: Column) -> Column:
        d = F.coalesce(s["description"], F.lit(""))
        named = d.contains("Finals") & ~d.contains("Conference")
        generic = d.isin("", "Playoff Series") & ((F.coalesce(X.to_long(s["totalCompetitions"]), F.lit(0)) >= 7) | over)
        return F.coalesce(s["type"] == "playoff", F.lit(False)) & (named | generic)

    s = df.withColumn("s", _first_of(F.filter("c.series", is_finals))).filter(F.col("s").isNotNull())
    ids = F.array_distinct(F.concat(F.coalesce(F.transform("s.events", lambda e: e["id"]), F.array().cast("array<string>")), F.array("c.id")))
    return s.select("league", F.col("c.id").try_cast("bigint").alias("latest_id"), F.explode(ids).alias("id")).select(
        "league", "latest_id", F.col("id").try_cast("bigint").alias("game_id")).filter(F.col("game_id").isNotNull())


# --- teams, standings, injuries, rosters ------------------------------------------------------------------

def flatten_teams(raw: DataFrame) -> DataFrame:
    t = "STRUCT<id: STRING, abbreviation: STRING, displayName: STRING, location: STRING, name: STRING, slug: STRING>"
    df = parsed(raw, f"STRUCT<sports: ARRAY<STRUCT<leagues: ARRAY<STRUCT<teams: ARRAY<STRUCT<team: {t}>>>>>>>")
    lg = _first_of(_first_of(F.col("p.sports"))["leagues"])
    return df.select("league", F.explode(lg["teams"]).alias("x")).select("league", "x.team.*").select(
        "league", F.col("id").try_cast("bigint").alias("team_id"), F.col("abbreviation").alias("abbrev"),
        F.col("displayName").alias("display_name"), "location", "name", "slug").filter(F.col("team_id").isNotNull())


_ENTRY = ("STRUCT<team: STRUCT<id: STRING, displayName: STRING, name: STRING>, "
          "stats: ARRAY<STRUCT<name: STRING, displayValue: STRING, value: STRING>>>")


#: One node of a standings document; its children stay text until their level is walked.
_NODE = (f"STRUCT<name: STRING, entries: ARRAY<{_ENTRY}>, standings: STRUCT<name: STRING, entries: ARRAY<{_ENTRY}>>, "
         "children: ARRAY<STRING>>")


def flatten_standings(raw: DataFrame) -> DataFrame:
    """One row per team; entries may sit at any level, the document's root included. The conference
    is the nearest level above whose name ends in 'Conference'.

    The document is walked level by level until no node has children.
    """
    extra = [c for c in raw.columns if c not in ("league", "payload")]
    level = raw.select("league", *extra, "payload", F.lit(None).cast("string").alias("conf"), F.lit("").alias("path"))
    parts = []
    while True:
        conf = lambda c: F.when(c.endswith("Conference"), c).otherwise(F.col("conf"))
        here = level.withColumn("n", F.from_json("payload", _NODE)).withColumn("conf", conf(F.coalesce("n.name", F.lit(""))))
        inner = conf(F.coalesce("n.standings.name", F.lit("")))
        for kind, c, e in ((0, F.col("conf"), "n.entries"), (1, inner, "n.standings.entries")):
            parts.append(here.select("league", *extra, c.alias("conference"), "path", F.posexplode(e).alias("pos", "e")).withColumn(
                "path", F.concat("path", F.lit(f"-{kind}"))))
        below = here.select("league", *extra, "conf", "path", F.posexplode("n.children").alias("i", "payload")).withColumn(
            "path", F.concat("path", F.format_string("-2%05d", "i"))).drop("i")
        level = stage(below, "standings-level")
        if level.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    cols = []
    for name, (col, kind) in K.STANDING_STATS.items():
        s = _named(F.col("e.stats"), name)
        v = F.coalesce(s["displayValue"], s["value"])
        cols.append((X.to_double(v) if kind == "double" else v.try_cast(kind)).alias(col))
    rows = out.filter(F.col("e.team.id").isNotNull()).select(
        "league", *extra, F.col("e.team.id").try_cast("bigint").alias("team_id"),
        F.coalesce(F.nullif("e.team.displayName", F.lit("")), "e.team.name").alias("team"), "conference", "path", "pos", *cols)
    return first_by(rows, ["league", *extra, "team_id"], ["path", "pos"]).drop("path", "pos")


def flatten_injuries(raw: DataFrame) -> DataFrame:
    """Report rows; a payload without the field is an error, an empty list is nobody hurt."""
    inj = "ARRAY<STRUCT<status: STRING, shortComment: STRING, date: STRING, athlete: STRUCT<displayName: STRING>>>"
    df = parsed(raw, f"STRUCT<injuries: ARRAY<STRUCT<displayName: STRING, injuries: {inj}>>>")
    lists = F.when(F.col("p.injuries").isNotNull(), F.col("p.injuries")).otherwise(
        F.raise_error(F.lit("injuries payload has no 'injuries' field")).cast(df.schema["p"].dataType["injuries"].dataType))
    return df.select("league", F.explode(lists).alias("t")).select("league", "t.displayName", F.explode("t.injuries").alias("r")).select(
        "league", F.col("r.athlete.displayName").alias("player_name"), F.col("displayName").alias("team"),
        F.col("r.status").alias("status"), F.col("r.shortComment").alias("detail"), F.col("r.date").alias("date"))


def _position(c: Column) -> Column:
    """A position is bare text or an object with an abbreviation or a name."""
    obj = F.coalesce(F.nullif(F.get_json_object(c, "$.abbreviation"), F.lit("")), F.get_json_object(c, "$.name"))
    return F.nullif(F.when(c.startswith("{"), obj).otherwise(c), F.lit(""))


def flatten_roster(raw: DataFrame) -> DataFrame:
    """Roster rows; the athlete's own position, else the group's."""
    a = "STRUCT<id: STRING, displayName: STRING, fullName: STRING, position: STRING>"
    df = parsed(raw, f"STRUCT<team: STRUCT<id: STRING>, positionGroups: ARRAY<STRUCT<position: STRING, athletes: ARRAY<{a}>>>>")
    return df.select("league", X.to_long("p.team.id").alias("team_id"), F.explode("p.positionGroups").alias("g")).select(
        "league", "team_id", "g.position", F.explode("g.athletes").alias("a")).filter(F.col("a.id").isNotNull()).select(
        "league", F.col("a.id").try_cast("bigint").alias("player_id"),
        F.coalesce(F.nullif("a.displayName", F.lit("")), "a.fullName").alias("player_name"),
        F.coalesce(_position(F.col("a.position")), _position(F.col("position"))).alias("position"), "team_id")


# --- leaders, totals, careers ---------------------------------------------------------------------------------

def leader_candidates(raw: DataFrame, per_category: int | None = None) -> DataFrame:
    """Players among the entries of any category (the first ``per_category`` of each, if given), each once, with the team of the first hit."""
    entry = "STRUCT<athlete: STRUCT<`$ref`: STRING>, team: STRUCT<`$ref`: STRING>>"
    df = parsed(raw, f"STRUCT<categories: ARRAY<STRUCT<name: STRING, leaders: ARRAY<{entry}>>>>")
    rows = df.select("league", F.posexplode("p.categories").alias("cat", "c")).select(
        "league", "cat", F.posexplode("c.leaders").alias("pos", "e")).filter(
        F.lit(True) if per_category is None else F.col("pos") < per_category).select(
        "league", "cat", "pos", X.to_long(X.ref_id("e.athlete.`$ref`")).alias("player_id"),
        X.to_long(X.ref_id("e.team.`$ref`")).alias("team_id")).filter(F.col("player_id").isNotNull())
    return first_by(rows, ["league", "player_id"], ["cat", "pos"]).select("league", "player_id", "team_id")


_STATS = "STRUCT<categories: ARRAY<STRUCT<name: STRING, stats: ARRAY<STRUCT<name: STRING, value: STRING>>>>>"


def _stat_list(raw: DataFrame) -> DataFrame:
    """``stats``: all (name, value) of a statistics document, in document order; ``splits`` may be a list."""
    one = parsed(raw, "STRUCT<splits: STRING>")
    as_list = F.from_json("p.splits", f"ARRAY<{_STATS}>")
    as_one = F.from_json("p.splits", _STATS)
    splits = F.when(F.col("p.splits").startswith("["), F.get(as_list, 0)).otherwise(as_one)
    return one.withColumn("stats", F.flatten(F.transform(splits["categories"], lambda c: c["stats"]))).drop("p")


def flatten_athlete_totals(raw: DataFrame) -> DataFrame:
    """Season totals; of a repeated stat the first counts, a missing one is 0."""
    df = _stat_list(raw)
    pick = lambda n: F.get(F.filter("stats", lambda s: s["name"] == n), 0)["value"]
    return df.select(*[c for c in df.columns if c != "stats"], *[
        F.coalesce(X.to_long(pick(n)), F.lit(0)).alias(c) for n, c in K.TOTAL_STATS.items()])


def flatten_career_line(raw: DataFrame) -> DataFrame:
    """Career totals as whole numbers; of a repeated stat the last non-null counts; no games, no row."""
    df = _stat_list(raw)
    pick = lambda n: _last(F.col("stats"), lambda s: (s["name"] == n) & s["value"].isNotNull())["value"]
    whole = lambda v: F.floor(F.coalesce(X.to_double(v), F.lit(0.0)) + 0.5)
    return df.select(*[c for c in df.columns if c != "stats"], *[
        whole(pick(n)).alias(c) for n, c in K.CAREER_LINE_STATS.items()]).filter(F.col("gp") > 0)


def flatten_season_averages(raw: DataFrame) -> DataFrame:
    """``rows``: a career's season averages in year order, and the last known team.

    Document input has one payload per player; team slugs go through the payload's own table.
    """
    stat = "STRUCT<season: STRUCT<year: STRING>, teamSlug: STRING, teamId: STRING, stats: ARRAY<STRING>>"
    df = parsed(raw, f"STRUCT<teams: MAP<STRING, STRUCT<abbreviation: STRING>>, "
                     f"categories: ARRAY<STRUCT<name: STRING, labels: ARRAY<STRING>, statistics: ARRAY<{stat}>>>>")
    avg = F.get(F.filter("p.categories", lambda c: c["name"] == "averages"), 0)
    df = df.withColumn("_c", avg).withColumn("_l", F.transform("_c.labels", lambda x: F.upper(x)))

    def cell(r: Column, label: str) -> Column:
        at = F.array_position("_l", label)
        return F.coalesce(F.when(at > 0, X.leading_number(F.get(r["stats"], (at - 1).cast("int")))), F.lit(0.0))

    one = lambda v: F.floor(v * 10 + 0.5) / 10

    def record(r: Column) -> Column:
        team = F.col("p.teams")[r["teamSlug"]]["abbreviation"]
        vals = [(F.floor(cell(r, la)).cast("bigint") if c == "gp" else one(cell(r, la))).alias(c) for la, c in K.SEASON_AVERAGE_LABELS.items()]
        return F.struct(X.to_long(r["season"]["year"]).cast("int").alias("year"),
                        F.coalesce(X.to_long(r["teamId"]), F.lit(0)).alias("team_id"),
                        F.coalesce(team, F.lit("")).alias("team"), *vals)

    rows = F.filter(F.transform("_c.statistics", record), lambda r: F.coalesce(r["year"], F.lit(0)) != 0)
    df = df.withColumn("_r", rows).withColumn("team", _last(F.col("_r"), lambda r: r["team"] != "")["team"])
    return df.withColumn("rows", F.array_sort("_r", lambda a, b: a["year"] - b["year"])).drop("p", "_c", "_l", "_r")


def flatten_award_detail(raw: DataFrame) -> DataFrame:
    """Winners of award documents (columns league, award_type, year): one row per athlete, with the
    champion team for the finals award from the league's first indexed year on."""
    win = "STRUCT<athlete: STRUCT<`$ref`: STRING>, team: STRUCT<`$ref`: STRING>>"
    df = parsed(raw, f"STRUCT<name: STRING, winners: ARRAY<{win}>>").filter(F.coalesce("p.name", F.lit("")) != "")
    rows = df.select("league", "award_type", "year", F.col("p.name").alias("name"), F.explode("p.winners").alias("w")).select(
        "league", "award_type", "year", "name", X.ref_number("w.athlete.`$ref`", "athletes").alias("player_id"),
        X.ref_number("w.team.`$ref`", "teams").alias("_team")).filter(F.col("player_id").isNotNull())
    finals = case_map(F.col("league"), {k: v["finals_mvp_type"] for k, v in K.LEAGUES.items()})
    since = case_map(F.col("league"), {k: v["champion_first_year"] for k, v in K.LEAGUES.items()})
    ok = (F.col("award_type") == finals) & (F.col("year") >= since)
    return rows.withColumn("champion_team_id", F.when(ok, F.col("_team"))).drop("_team")


# --- cached documents --------------------------------------------------------------------------------------------

def read_award_facts(raw: DataFrame) -> DataFrame:
    """Cached award map '{type}-{year}' -> {name, athletes, champion}: one row per winner."""
    df = raw.select("league", F.explode(F.from_json("payload", "MAP<STRING, STRUCT<name: STRING, athletes: ARRAY<BIGINT>, champion: BIGINT>>")).alias("k", "v"))
    return df.select("league", F.split_part("k", F.lit("-"), F.lit(1)).try_cast("int").alias("award_type"),
                     F.split_part("k", F.lit("-"), F.lit(2)).try_cast("int").alias("year"), "v.name",
                     F.col("v.champion").alias("champion_team_id"), F.explode("v.athletes").alias("player_id"))


def read_bundles(raw: DataFrame) -> DataFrame:
    """Cached athlete map id -> bundle; season rows are positional arrays of 12 cells."""
    line = ", ".join(f"`{c}`: BIGINT" for c in ("gp", "starts", "minutes", *K.LINE_STATS))
    doc = (f"MAP<STRING, STRUCT<name: STRING, debut: INT, position: STRING, jersey: STRING, team: STRING, complete: BOOLEAN, "
           f"fetched: STRING, line: STRUCT<{line}>, rows: ARRAY<ARRAY<STRING>>>>")
    df = raw.select("league", F.explode(F.from_json("payload", doc)).alias("k", "v"))
    names = ("year", "team_id", "team", "gp", "min", "pts", "reb", "ast", "stl", "blk", "fg_pct", "fg3_pct")
    kinds = {"year": "int", "team_id": "bigint", "team": "string", "gp": "bigint"}
    record = lambda r: F.struct(*[
        (F.get(r, i) if n == "team" else X.to_double(F.get(r, i)).cast(kinds.get(n, "double"))).alias(n) for i, n in enumerate(names)])
    return df.select("league", X.to_long("k").alias("player_id"), "v.name", "v.debut", "v.position", "v.jersey", "v.team",
                     "v.complete", "v.fetched", "v.line", F.transform("v.rows", record).alias("rows"))
