"""Player-game tables derived from the driver's TPC-H-like tables.

lineitem rows of one (order, supplier) become one player-game row, orders become games, events
become a second player log.  All stats are sums of whole numbers, so every engine gets the same
digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAGUE = "nba"
#: Lines of a task that gathers the lines of orders: aggregates and joins by order keep this partitioning.
LINES_A_TASK = 250_000
STATS = ("pts", "reb", "oreb", "dreb", "ast", "stl", "blk", "to", "pf",
         "fgm", "fga", "fg3m", "fg3a", "ftm", "fta")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def abbrev(team_id: Column) -> Column:
    return F.concat(F.lit("T"), F.lpad(team_id.cast("string"), 4, "0"))


def supplier_name(k: Column) -> Column:
    """"Supplier#%09d"; ids of up to nine digits are padded, which takes far less than the formatter a row."""
    return F.when(k.between(0, 999_999_999), F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0"))).otherwise(
        F.format_string("Supplier#%09d", k))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as games: sides, date, season.  The team count is a one-value subquery."""
    o = table(spark, sf_dir, "orders")
    teams = o.agg((F.floor(F.max("o_custkey") / 25) + 1).alias("t")).scalar()
    home = F.floor(F.col("o_custkey") / 25)
    return (o.withColumn("_t", teams).select(
        F.lit(LEAGUE).alias("league"), F.year("o_orderdate").cast("string").alias("season"),
        F.year("o_orderdate").alias("season_start"), F.col("o_orderkey").alias("game_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), home.alias("home_id"),
        ((home + 1 + F.col("o_orderkey") % (F.col("_t") - 1)) % F.col("_t")).alias("away_id"),
        F.col("o_orderstatus"), F.col("o_orderpriority")))


def line_parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts for rows as many as order lines: their number is in the files' footers."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // LINES_A_TASK))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, dealt by order in as many parts as their number asks for.

    What follows per player of an order, per order and joined with orders needs no further exchange, and
    a task's rows don't grow with the table. Adaptive execution leaves a given number of parts alone.
    """
    return table(spark, sf_dir, "lineitem").repartition(line_parts(spark, sf_dir), "l_orderkey")


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player-game rows.  Lines are aggregated before the join, so an order with very many lines
    is reduced to one row per player first. Rows of a game lie in one part."""
    li = lines(spark, sf_dir)
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5)
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    raw = {
        "pts": F.col("l_quantity").cast("bigint"), "oreb": cents("l_discount"), "dreb": line,
        "ast": part % 11, "stl": part % 4, "blk": cents("l_tax"), "to": F.col("l_orderkey") % 5,
        "pf": line % 6, "fgm": part % 8, "miss": line, "fg3m": part % 3, "miss3": part % 2,
        "ftm": F.col("l_suppkey") % 4, "missft": F.col("l_orderkey") % 3,
        "min": (part % 8) * line, "plus_minus": part % 21 - 10,
    }
    agg = li.groupBy("l_orderkey", "l_suppkey").agg(
        F.bool_and(F.col("l_returnflag") == "R").alias("did_not_play"),
        (F.min("l_linenumber") == 1).alias("starter"),
        *[F.sum(c.cast("bigint")).alias(n) for n, c in raw.items()])
    g = _orders(spark, sf_dir)
    j = agg.join(g, agg.l_orderkey == g.game_id)
    is_home = (F.col("l_suppkey") + F.col("l_orderkey")) % 2 == 0
    own = F.when(is_home, F.col("home_id")).otherwise(F.col("away_id"))
    opp = F.when(is_home, F.col("away_id")).otherwise(F.col("home_id"))
    dnp = F.col("did_not_play")
    val = {n: F.col(n) for n in raw}
    val.update(reb=F.col("oreb") + F.col("dreb"), fga=F.col("fgm") + F.col("miss"),
               fg3a=F.col("fg3m") + F.col("miss3"), fta=F.col("ftm") + F.col("missft"))
    unknown_min = (F.col("l_orderkey") + F.col("l_suppkey")) % 101 == 0
    return j.select(
        "league", "season", "season_start", "game_id", "ts",
        own.alias("team_id"), abbrev(own).alias("team_abbrev"),
        opp.alias("opponent_id"), abbrev(opp).alias("opponent_abbrev"), is_home.alias("is_home"),
        F.col("l_suppkey").alias("player_id"),
        supplier_name(F.col("l_suppkey")).alias("player_name"),
        "starter", "did_not_play",
        F.when(dnp, F.lit(0)).when(~unknown_min, F.col("min")).cast("bigint").alias("min"),
        *[F.when(dnp, F.lit(0)).otherwise(val[s]).cast("bigint").alias(s) for s in STATS],
        F.when(~dnp, F.col("plus_minus")).alias("plus_minus"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: scores are the sums of pts of the players who appeared, 0 for a side
    without any."""
    scores = box(spark, sf_dir).groupBy("game_id").agg(
        F.coalesce(F.sum(F.when(F.col("is_home"), F.col("pts"))), F.lit(0)).alias("home_score"),
        F.coalesce(F.sum(F.when(~F.col("is_home"), F.col("pts"))), F.lit(0)).alias("away_score"))
    return _orders(spark, sf_dir).join(scores, "game_id").select(
        "league", "season", "season_start", "game_id", "ts", "home_id",
        abbrev(F.col("home_id")).alias("home_abbrev"), "home_score", "away_id",
        abbrev(F.col("away_id")).alias("away_abbrev"), "away_score",
        F.when(F.col("o_orderstatus") == "P", "STATUS_SCHEDULED").otherwise("STATUS_FINAL").alias("status"),
        F.when(F.col("game_id") % 50 == 0, "True").otherwise("False").alias("neutral"))


def series_games(games: DataFrame) -> DataFrame:
    """Games of a season grouped by pairing: the stand-in for play-off series."""
    pair = F.concat_ws("-", F.least("home_abbrev", "away_abbrev"), F.greatest("home_abbrev", "away_abbrev"))
    return games.withColumn("series", pair)


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player dimension: name, position, debut season, current team."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    pos = F.when(k % 4 == 0, "G").when(k % 4 == 1, "F").when(k % 4 == 2, "C")
    teams = table(spark, sf_dir, "orders").agg((F.floor(F.max("o_custkey") / 25) + 1).alias("t")).scalar()
    return s.withColumn("_t", teams).select(
        F.lit(LEAGUE).alias("league"), k.alias("player_id"), F.col("s_name").alias("player_name"),
        pos.alias("position"), (F.lit(1995) + k % 7).cast("int").alias("debut"),
        (k % F.col("_t")).alias("team_id"))


def award_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Award wins: lines of quantity 50 and discount 0.10; the award is the part type."""
    li = table(spark, sf_dir, "lineitem").filter(
        (F.col("l_quantity") == 50) & (F.floor(F.col("l_discount") * 100 + 0.5) == 10))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.lit(LEAGUE).alias("league"), F.year("l_shipdate").alias("year"),
        F.col("p_type").alias("name"), F.col("l_suppkey").alias("player_id"))


AWARD_POINTS = {"ECONOMY": 6.0, "SMALL": 5.0, "STANDARD": 3.0, "MEDIUM": 1.5, "LARGE": 1.0, "PROMO": 0.25}


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second player log from events: one row per event, 'error' rows count as not played."""
    e = table(spark, sf_dir, "events")
    played = F.col("event_type") != "error"
    return e.select(
        F.lit("wnba").alias("league"), F.year("ts").cast("string").alias("season"),
        F.year("ts").alias("season_start"), F.col("event_id").alias("game_id"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("player_id"),
        (F.col("user_id") % 10).alias("team_id"),
        ((F.col("user_id") + 1) % 10).alias("opponent_id"),
        F.when(played, F.floor(F.col("value") + 0.5)).otherwise(0).cast("bigint").alias("score"),
        F.when(played, F.lit(30)).otherwise(0).alias("min"), "event_type", "props")
