import datetime as dt

import pytest
from pyspark.sql import functions as F

from hoopframe.functions import constants as K
from hoopframe.functions import scalars as X
from hoopframe.functions import scoring as S
from hoopframe.functions import seasons as Y
from hoopframe.functions.core import half_up, nan_to_null, text_order


def values(spark, items, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_half_up_and_nan(spark):
    assert values(spark, [1.005, 0.125, -1.25, None], lambda v: half_up(v, 2), "double")[1:] == [0.13, -1.25, None]
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert sorted([r.x for r in df.collect()], key=str) == [1.0, None]


def test_text_order(spark):
    ids = [9, 10, 100, 99, 1, 401620234, 40]
    got = values(spark, ids, text_order, "bigint")
    assert [i for _, i in sorted(zip(got, ids))] == sorted(ids, key=str)


def test_numbers(spark):
    assert values(spark, [".682", "12.5", "x", "nan", None, ".5%"], X.to_double) == [0.682, 12.5, None, None, None, 0.5]
    assert values(spark, ["125", "125.0", "-3.9", "x", "nan", None], X.to_long) == [125, 125, -3, None, None, None]
    assert values(spark, ["94.0", "94", "", "n/a", "94.5"], X.clean_score) == ["94", "94", "", "n/a", "94.5"]
    assert values(spark, ["6-13", "6", None], X.made) == [6, None, None]
    assert values(spark, ["6-13", "6", None], X.attempted) == [13, None, None]
    assert values(spark, ["7.9-18.9", "3.1", "x", None], X.leading_number) == [7.9, 3.1, 0.0, 0.0]
    assert values(spark, ["-", "1.5", None], X.games_behind) == [0.0, 1.5, None]
    assert values(spark, [-1.0, 2.0], X.clip_zero, "double") == [0.0, 2.0]


def test_refs(spark):
    links = ["http://x/seasons/2027/athletes/4251?lang=en&region=us", "http://x/teams/7/", "", None]
    assert values(spark, links, X.ref_id) == ["4251", "7", None, None]
    assert values(spark, links, lambda v: X.ref_number(v, "athletes")) == [4251, None, None, None]


def test_rounds(spark):
    heads = ["East 1st Round - Game 3", "West Semifinals – Game 1", "NBA Play-In - East - 7th vs 8th", "  ", None]
    assert values(spark, heads, X.round_label) == ["East 1st Round", "West Semifinals", "NBA Play-In", None, None]
    shown = values(spark, ["EASTERN CONFERENCE 1st ROUND", "NBA Finals", "nba play-in", "WNBA SEMIFINALS 1"], X.round_display)
    assert shown == ["Eastern Conference 1st Round", "NBA Finals", "NBA Play-In", "WNBA Semifinals 1"]
    labels = ["NBA Play-In", "WNBA SEMIFINALS 1", "EASTERN CONFERENCE FINALS", "WEST FINALS", "WNBA FINALS 2017 PRESENTED BY VERIZON",
              "Second Round", "East 1st Round", "Cup", "", None]
    assert values(spark, labels, X.round_rank) == [0, 2, 3, 3, 4, 1, 1, 9, 9, 9]
    assert values(spark, ["nan", "None", " ", None, "x"], X.has_round) == [False, False, False, False, True]


def test_states_and_positions(spark):
    assert values(spark, ["PG", "sg", "F", "SF", "C", "UNK", None], X.position_bucket) == ["G", "G", "F", "F", "C", None, None]
    df = spark.createDataFrame([("pre", "STATUS_FINAL"), ("in", None), (None, "STATUS_FINAL"), ("", "STATUS_POSTPONED"), (None, None)], "s string, n string")
    assert [r[0] for r in df.select(X.game_started("s", "n")).collect()] == [False, True, True, False, False]
    z = spark.createDataFrame([("nba", 6, True), ("nba", 10, True), ("nba", 11, True), ("wnba", 8, True), ("wnba", 9, True), ("nba", 1, False)],
                              "l string, s int, p boolean")
    assert [r[0] for r in z.select(X.seed_zone(F.col("l"), "s", F.col("p"))).collect()] == ["playoff", "play_in", "", "playoff", "", ""]


def test_dates(spark):
    stamps = ["2026-10-23T23:30Z", "2026-10-23T23:30:00Z", "soon maybe later", None]
    assert values(spark, stamps, lambda v: X.local_date(v, "Pacific/Auckland")) == ["2026-10-24", "2026-10-24", None, None]
    assert values(spark, stamps[:2], lambda v: X.local_stamp(v, "America/New_York")) == ["2026-10-23 19:30"] * 2
    d = dt.date
    df = spark.createDataFrame([(d(2024, 4, 14), d(2024, 4, 17)), (d(2024, 4, 14), d(2024, 4, 15)), (d(2024, 4, 1), d(2024, 5, 1))], "a date, b date")
    gaps = [r[0] for r in df.select(X.gap_days("a", "b")).collect()]
    assert gaps[0] == [d(2024, 4, 15), d(2024, 4, 16)] and gaps[1] == [] and len(gaps[2]) == 29
    assert [len(r[0]) for r in df.select(X.gap_days("a", "b", 7)).collect()] == [2, 0, 7]
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    notes = ["old 2026-01-01T00:00:00Z new 2026-01-09T22:00Z", "2026-01-09T23:59:30Z", "2026-01-09T23:55:00Z", "2026-01-01T00:00:00Z", "none"]
    assert values(spark, notes, lambda v: X.age_text(v, now)) == [" (2 h ago)", " (just now)", " (5 min ago)", " (9 d ago)", ""]
    assert values(spark, ["2026-01-04T00:00:00Z", "2026-01-01T00:00:00Z", None], lambda v: X.is_fresh(v, 7, now)) == [True, False, False]


def test_seasons(spark):
    labels = ["2010-11", "2025-26", "1999-00"]
    assert values(spark, labels, Y.season_start_year) == [2010, 2025, 1999]
    assert values(spark, labels, lambda v: Y.season_param(v, "nba")) == [2011, 2026, 2000]
    assert values(spark, labels, lambda v: Y.previous_season(v, "nba")) == ["2009-10", "2024-25", "1998-99"]
    assert values(spark, ["2026"], lambda v: Y.previous_season(v, "wnba")) == ["2025"]
    assert values(spark, [2011, 2000], lambda v: Y.season_label(v, "nba"), "int") == ["2010-11", "1999-00"]
    days = [dt.date(2026, 7, 1), dt.date(2026, 8, 1), dt.date(2026, 1, 5), dt.date(2026, 12, 1)]
    assert values(spark, days, lambda v: Y.season_label_from_date(v, "nba"), "date") == ["2025-26", "2026-27", "2025-26", "2026-27"]
    assert values(spark, days, lambda v: Y.current_season_label(v, "nba"), "date") == ["2026-27", "2026-27", "2025-26", "2026-27"]
    assert values(spark, days, lambda v: Y.current_season_label(v, "wnba"), "date") == ["2026", "2026", "2026", "2027"]
    assert values(spark, days, lambda v: Y.latest_completed_season(v, "wnba"), "date") == ["2025", "2025", "2025", "2026"]
    ranks = values(spark, ["2010-11", "2039-40", "2045-46", "1995-96"], Y.season_rank)
    assert ranks[0] == 0 and ranks[1] == 29 and ranks[2] > ranks[1] and ranks[3] > ranks[1]
    with pytest.raises(Exception, match="malformed"):
        values(spark, ["20x"], Y.season_start_year)


def test_fantasy_points(spark):
    df = spark.createDataFrame([(20, 10, 5, 2, 1, 3), (10, 5, 0, 0, 0, 0), (None, None, None, None, None, None)],
                               "pts int, reb int, ast int, stl int, blk int, to int")
    assert [r.fantasy_points for r in S.fantasy_points(df).collect()] == [46.0, 15.0, 0.0]
    assert [r.fantasy_points for r in S.fantasy_points(df, {"pts": 2, "absent": 9}).collect()] == [40.0, 20.0, 0.0]
    assert S.fantasy_points(df, K.FRACTIONAL_FANTASY_WEIGHTS).first().fantasy_points == pytest.approx(20 + 12 + 7.5 + 6 + 3 - 3)


def test_efficiency(spark):
    df = spark.createDataFrame([(19, 36, 2, 8, 0, 0, 50)], "fgm int, fga int, fg3m int, fg3a int, ftm int, fta int, pts int")
    e = {n: v for n, v in zip(S.efficiency(), df.select(*S.efficiency().values()).first())}
    assert e == {"fgp": 52.8, "fg3p": 25.0, "ftp": None, "efg": 55.6, "ts": 69.4}
