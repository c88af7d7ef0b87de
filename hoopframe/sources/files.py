"""Reading stored files into entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.core import first_by
from ..functions.seasons import season_start_year

PLAYER_ROW = (
    "game_id: BIGINT, date: STRING, season: STRING, team_id: INT, team_abbrev: STRING, opponent_id: INT, "
    "opponent_abbrev: STRING, is_home: BOOLEAN, player_id: BIGINT, player_name: STRING, starter: BOOLEAN, "
    "did_not_play: BOOLEAN, min: INT, pts: INT, reb: INT, oreb: INT, dreb: INT, ast: INT, stl: INT, blk: INT, "
    "to: INT, pf: INT, plus_minus: INT, fgm: INT, fga: INT, fg3m: INT, fg3a: INT, ftm: INT, fta: INT")
GAME = ("game_id: BIGINT, date: STRING, season: STRING, status: STRING, home_id: INT, home_abbrev: STRING, "
        "home_score: DOUBLE, away_id: INT, away_abbrev: STRING, away_score: DOUBLE")
BOX_SCHEMA = f"game STRUCT<{GAME}>, players ARRAY<STRUCT<{PLAYER_ROW}>>, _corrupt STRING"
GAME_COLUMNS = ("game_id", "date", "season", "home_id", "home_abbrev", "home_score", "away_id", "away_abbrev",
                "away_score", "status", "neutral", "round")


def season_from_path(path: Column) -> Column:
    """The season directory of ``.../{season}/games/{id}.json``."""
    return F.nullif(F.regexp_extract(path, r"/(\d{4}(?:-\d{2})?)/games/[^/]+$", 1), F.lit(""))


def id_from_path(path: Column) -> Column:
    return F.regexp_extract(path, r"/(\d+)\.json$", 1).try_cast("bigint")


def box_documents(spark: SparkSession, path: str) -> DataFrame:
    """Stored game documents, one JSON line per file, with their path, season and file id."""
    docs = (spark.read.schema(BOX_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
            .json(path).select("*", F.col("_metadata.file_path").alias("path")))
    return with_path_fields(docs)


BUNDLE_SCHEMA = "path STRING, modified TIMESTAMP, body STRING"


def parsed_bundle(rows: DataFrame) -> DataFrame:
    """Documents of bundled files: the body of each, parsed; what is no document keeps its text in ``_corrupt``."""
    doc = F.from_json("body", BOX_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return with_path_fields(rows.select(F.col("path"), F.col("modified"), doc.alias("d")).select("d.*", "path", "modified"))


def read_bundle(spark: SparkSession, path: str, league: str) -> tuple[DataFrame, DataFrame]:
    """(player_game, rejects) of bundled game files, the newest good version of each game."""
    good, bad = split_documents(parsed_bundle(spark.read.schema(BUNDLE_SCHEMA).parquet(path)))
    newest = good.groupBy("season", "file_id").agg(F.max_by(F.struct(*good.columns), F.struct("modified", "path")).alias("_f"))
    return player_rows(newest.select("_f.*").drop("modified"), league), bad


def with_path_fields(docs: DataFrame) -> DataFrame:
    return docs.withColumn("season", season_from_path(F.col("path"))).withColumn("file_id", id_from_path(F.col("path")))


def document_problem() -> Column:
    """Why a stored document is no complete box score (null: it is one)."""
    teams = F.size(F.array_distinct(F.filter(F.transform("players", lambda r: r["team_id"]), lambda t: t.isNotNull())))
    return (F.when(F.col("_corrupt").isNotNull(), "unreadable")
            .when(F.coalesce(F.size("players"), F.lit(0)) <= 0, "no players")
            .when(F.coalesce(F.col("game.game_id") != F.col("file_id"), F.lit(True)), "game id differs")
            .when(teams < 2, "fewer than two teams"))


def split_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid documents, rejects with a reason); a bad file is rejected as a whole."""
    d = docs.withColumn("reason", document_problem())
    return d.filter(F.col("reason").isNull()).drop("reason"), d.filter(F.col("reason").isNotNull()).select(
        "path", "season", "file_id", "reason")


def player_rows(docs: DataFrame, league: str) -> DataFrame:
    """Player-game rows of documents; the season is the directory's."""
    rows = docs.select(F.lit(league).alias("league"), F.col("season").alias("_season"), F.explode("players").alias("r")).select(
        "league", "_season", "r.*")
    return rows.withColumn("season", F.coalesce("_season", "season")).drop("_season").withColumn(
        "season_start", season_start_year("season")).withColumn("ts", X.utc_time("date"))


def read_box_scores(spark: SparkSession, path: str, league: str) -> tuple[DataFrame, DataFrame]:
    """(player_game, rejects) of a glob like ``root/*/games/*.json``."""
    good, bad = split_documents(box_documents(spark, path))
    return player_rows(good, league), bad


def read_schedule(spark: SparkSession, path: str, league: str) -> DataFrame:
    """Season CSVs; files without a ``round`` column get an empty one."""
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return typed_games(df, league)


def read_versions(spark: SparkSession, path: str, columns: tuple[str, ...] = GAME_COLUMNS, key: str = "game_id") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV files whose headers differ, in one job.

    Every file starts with its own header. Columns are met by name: what a file lacks is null, what it has besides
    ``columns`` is left out. A line with another number of cells than its file's header, or without a
    whole number under ``key``, is a reject with its file, text and reason. Cells may be
    quoted but hold no line feeds; all come out as text. Files without a header line give nothing.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))
    is_head = F.col("value").rlike(rf'(^|,)"?{key}"?(,|$)')
    heads = lines.where(is_head).groupBy("path").agg(F.min("value").alias("_head"))
    heads = heads.withColumn("_names", F.transform(F.split("_head", ","), lambda c: F.trim(F.btrim(c, F.lit('"')))))
    widest = heads.agg(F.max(F.size("_names"))).first()[0] or 1
    cells = ", ".join(f"c{i} STRING" for i in range(widest + 1))  # one more, to notice lines that are too long
    body = lines.where(~is_head & (F.length(F.trim("value")) > 0)).join(heads.select("path", "_names"), "path")
    parsed = body.withColumn("_csv", F.from_csv("value", cells, {"escape": '"'}))
    parsed = parsed.withColumn("_cells", F.array(*[F.col(f"_csv.c{i}") for i in range(widest + 1)])).drop("_csv")
    commas = F.length(F.regexp_replace(F.regexp_replace("value", '"[^"]*"', ""), "[^,]", ""))
    id_text = F.get("_cells", (F.array_position("_names", key) - 1).cast("int"))
    why = F.when(commas + 1 != F.size("_names"), "cells differ from the header").when(
        ~F.coalesce(id_text.rlike(r"^\d+$"), F.lit(False)), f"no whole number under {key}")
    checked = parsed.withColumn("reason", why)
    named = F.map_from_arrays("_names", F.slice("_cells", 1, F.size("_names")))
    rows = checked.where(F.col("reason").isNull()).withColumn("_row", named)
    return (rows.select("path", *[F.col("_row")[c].alias(c) for c in columns]),
            checked.where(F.col("reason").isNotNull()).select("path", F.col("value").alias("line"), "reason"))


def read_season_docs(spark: SparkSession, path: str, league: str) -> DataFrame:
    """Season documents ``{season, games: [...]}`` whose cells are all text."""
    cells = ", ".join(f"{c}: STRING" for c in GAME_COLUMNS)
    docs = spark.read.schema(f"season STRING, games ARRAY<STRUCT<{cells}>>").option("multiLine", True).json(path)
    return typed_games(docs.select(F.col("season").alias("_s"), F.explode("games").alias("g")).select("_s", "g.*").withColumn(
        "season", F.coalesce("season", "_s")).drop("_s"), league)


def typed_games(df: DataFrame, league: str) -> DataFrame:
    for c in GAME_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select(
        F.lit(league).alias("league"), "season", season_start_year("season").alias("season_start"),
        X.to_long("game_id").alias("game_id"), X.utc_time("date").alias("ts"), "date",
        *[c for s in ("home", "away") for c in (X.to_long(f"{s}_id").alias(f"{s}_id"), F.col(f"{s}_abbrev"),
                                                X.to_long(f"{s}_score").alias(f"{s}_score"))],
        "status", X.is_neutral("neutral").alias("neutral"), "round")


def read_positions(spark: SparkSession, path: str, league: str) -> DataFrame:
    """``{"players": [...]}`` or a bare list; each player once, the first entry wins.

    No entries give an empty table with the same columns.
    """
    row = "STRUCT<player_id: BIGINT, player_name: STRING, position: STRING, team_id: BIGINT>"
    text = spark.read.text(path, wholetext=True)
    listed = F.when(F.trim("value").startswith("["), F.from_json("value", f"ARRAY<{row}>")).otherwise(
        F.from_json("value", f"STRUCT<players: ARRAY<{row}>>")["players"])
    rows = text.select(F.posexplode(listed).alias("pos", "r")).select(F.lit(league).alias("league"), "pos", "r.*")
    return first_by(rows, ["league", "player_id"], ["pos"]).drop("pos")


def read_envelope(spark: SparkSession, path: str, field: str, row: str, league: str) -> DataFrame:
    """A document with a list under one field: teams, standings or injuries."""
    docs = spark.read.schema(f"season STRING, {field} ARRAY<STRUCT<{row}>>").option("multiLine", True).json(path)
    out = docs.select("season", F.explode(field).alias("r")).select("season", "r.*")
    return out.withColumn("league", F.lit(league))


TEAM_ROW = "team_id: BIGINT, abbrev: STRING, display_name: STRING, location: STRING, name: STRING, slug: STRING"
STANDING_ROW = ("team_id: BIGINT, team: STRING, conference: STRING, wins: INT, losses: INT, win_percent: STRING, playoff_seed: INT, "
                "games_behind: STRING, streak: STRING, avg_points_for: DOUBLE, avg_points_against: DOUBLE, last_ten: STRING, differential: DOUBLE")
INJURY_ROW = "player_name: STRING, team: STRING, status: STRING, detail: STRING, date: STRING"


def read_teams(spark: SparkSession, path: str, league: str) -> DataFrame:
    return read_envelope(spark, path, "teams", TEAM_ROW, league)


def read_standings(spark: SparkSession, path: str, league: str) -> DataFrame:
    return read_envelope(spark, path, "standings", STANDING_ROW, league)


def read_injuries(spark: SparkSession, path: str, league: str) -> DataFrame:
    return read_envelope(spark, path, "injuries", INJURY_ROW, league)


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    """Fact or feature table written by ``sinks.write_fact``."""
    return spark.read.parquet(path)
