"""Small hand-made tables."""

from pyspark.sql import functions as F

STATS = ("pts", "reb", "oreb", "dreb", "ast", "stl", "blk", "to", "pf", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta")
TEXT = ("league", "season", "date", "team_abbrev", "opponent_abbrev", "player_name", "position")
BOOL = ("is_home", "starter", "did_not_play")
BOX = dict(league="nba", season="2020-21", season_start=2020, game_id=1, date="2021-01-01T00:00:00Z", team_id=1,
           team_abbrev="AAA", opponent_id=2, opponent_abbrev="BBB", is_home=True, player_id=1, player_name=None,
           starter=True, did_not_play=False, min=30, plus_minus=0, **{s: 0 for s in STATS})
GAME = dict(league="nba", season="2020-21", season_start=2020, game_id=1, date="2021-01-01T00:00:00Z", home_id=1,
            home_abbrev="AAA", home_score=100, away_id=2, away_abbrev="BBB", away_score=90, status="STATUS_FINAL", neutral="False")


def _kind(c):
    return "string" if c in TEXT or c in ("status", "neutral", "home_abbrev", "away_abbrev") else "boolean" if c in BOOL else (
        "int" if c == "season_start" else "bigint")


def rows(spark, base, items):
    data = [tuple({**base, **r}[c] for c in base) for r in items]
    df = spark.createDataFrame(data, ", ".join(f"`{c}` {_kind(c)}" for c in base))
    return df.withColumn("ts", F.col("date").cast("timestamp")).drop("date")


def box(spark, items):
    return rows(spark, BOX, [{**r, "player_name": r.get("player_name", f"P{r.get('player_id', 1)}")} for r in items])


def games(spark, items):
    return rows(spark, GAME, items)


def totals(spark, items):
    """Player-season totals rows."""
    base = dict(league="nba", season="2020-21", season_start=2020, player_id=1, player_name="P", team_abbrev="AAA", gp=10, starts=10,
                minutes=300, plus_minus=0, **{s: 0 for s in STATS})
    cols = ", ".join(f"`{c}` {_kind(c)}" for c in base)
    return spark.createDataFrame([tuple({**base, **r}[c] for c in base) for r in items], cols)


def by(df, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}
