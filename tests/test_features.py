import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tables import box, by, games

from hoopframe.operators import features as X
from hoopframe.operators import logs
from hoopframe.operators import projections as P
from hoopframe.operators import quality as V

DAYS = ("2021-01-01", "2021-01-03", "2021-01-05", "2021-01-06")


def small(spark, extra=()):
    """Six rows: player 11 plays four games, player 22 the last two."""
    rows = [dict(game_id=100 + i, date=f"{d}T20:00:00Z", player_id=11, min=30 + i, pts=10 + i) for i, d in enumerate(DAYS)]
    rows += [dict(game_id=100 + i, date=f"{DAYS[i]}T20:00:00Z", player_id=22, min=20, pts=8, team_id=2, team_abbrev="BBB", opponent_id=1, is_home=False) for i in (2, 3)]
    f = box(spark, [{**r, **dict(e)} for r in rows for e in [()]] + list(extra))
    g = games(spark, [dict(game_id=100 + i, date=f"{d}T20:00:00Z", home_score=100 + i, away_score=95 + i) for i, d in enumerate(DAYS)])
    fact = X.player_games(f, g)
    target = F.when(F.col("player_id") == 22, 15.0).otherwise(20.0 + F.col("game_id") - 100)
    return fact.withColumn("fantasy_points", target), g


def test_small_table(spark):
    fact, _ = small(spark)
    f = X.feature_table(fact).filter(F.col("player_id") == 11)
    got = by(f, "game_id", "fantasy_points_avg_last_3", "season_game_count", "rest_days", "back_to_back", "games_played_last_5", "team_form_pf")
    assert got[100] == (None, 0, None, 0, None, None)
    assert got[101] == (20.0, 1, 1, 0, 1.0, 100.0)
    assert got[102][0] == 20.5 and got[102][1:4] == (2, 1, 0)
    assert got[103][1:5] == (3, 0, 1, 3.0)
    base = by(X.feature_table(fact), "game_id", "new_player_baseline")
    assert base[100] is None and base[102] == 20.5
    assert V.no_leak(X.feature_table(fact)).count() == 0
    assert V.feature_columns(X.feature_table(fact)).count() == 0


def test_prior_appearances(spark):
    mins = [30, 0, 30, 0, 30, 30, 0]
    rows = [dict(game_id=i, date=f"2021-01-{i + 1:02d}T20:00:00Z", min=m) for i, m in enumerate(mins)]
    f = X.player_form(X.player_games(box(spark, rows), games(spark, [dict(game_id=99)])))
    assert [r.games_played_last_5 for r in f.orderBy("ts").collect()] == [None, 1, 1, 2, 2, 3, 3]


def test_scores_and_disagreement(spark):
    b = box(spark, [dict(player_id=1), dict(player_id=2, team_id=2, opponent_id=1, is_home=False)])
    ok = by(X.with_scores(b, games(spark, [dict()])), "player_id", "team_score", "opp_score", "home_mismatch")
    assert ok == {1: (100.0, 90.0, False), 2: (90.0, 100.0, False)}
    bad = by(X.with_scores(b, games(spark, [dict(home_id=7)])), "player_id", "team_score", "home_mismatch")
    assert bad == {1: (None, True), 2: (None, True)}


def test_contradictory_team_games(spark):
    fact, _ = small(spark)
    shifted = fact.unionByName(fact.filter("player_id = 11 and game_id = 101").withColumns({"player_id": F.lit(33).cast("bigint"), "team_score": F.lit(1.0)}))
    good, bad = X.team_game_table(shifted)
    assert [(r.game_id, r.team_id) for r in bad.collect()] == [(101, 1)]
    assert good.filter("game_id = 101").count() == 0 and good.count() == 5


def test_projection_rows(spark):
    fact, _ = small(spark)
    up = games(spark, [dict(game_id=999, date="2021-01-09T20:00:00Z", status="STATUS_SCHEDULED"),
                       dict(game_id=1000, date="2021-01-11T20:00:00Z", status="STATUS_SCHEDULED")])
    roster = spark.createDataFrame([("nba", 11, 1, "G"), ("nba", 33, 2, "F"), ("nba", 44, 3, "C")], "league string, player_id bigint, team_id bigint, position string")
    rows = {(r.game_id, r.player_id): r for r in P.projection_rows(fact, up, roster).collect()}
    assert set(rows) == {(999, 11), (999, 33), (1000, 11), (1000, 33)}
    a, b = rows[(999, 11)], rows[(1000, 11)]
    assert (a.fantasy_points_avg_last_5, a.rest_days, a.career_game_count) == (21.5, 2, 4)
    assert (b.fantasy_points_avg_last_3, b.rest_days, b.career_game_count) == (22.0, 4, 4)
    c = rows[(999, 33)]
    assert c.fantasy_points_avg_last_5 is None and c.new_player_baseline is not None and c.career_game_count == 0
    out = P.project_upcoming(fact, up, roster, P.naive_score).collect()
    assert [r.game_id for r in out] == [999, 999, 1000, 1000] and out[0].projected_points == 21.5


def test_same_day_history_is_not_seen(spark):
    fact, _ = small(spark)
    up = games(spark, [dict(game_id=999, date="2021-01-06T23:00:00Z", status="STATUS_SCHEDULED")])
    roster = spark.createDataFrame([("nba", 11, 1, "G")], "league string, player_id bigint, team_id bigint, position string")
    assert P.projection_rows(fact, up, roster).first().career_game_count == 3


def log(spark, seed, n=300, players=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = 1 if rng.random() < 0.5 else rng.randint(2, players)
        day = dt.date(2019, 10, 1) + dt.timedelta(days=rng.randint(0, 500))
        start = day.year if day.month >= 8 else day.year - 1
        rows.append(("nba", f"{start}-{(start + 1) % 100:02d}", start, i, dt.datetime(day.year, day.month, day.day, rng.randint(0, 23)), p,
                     rng.choice([None, 0, 10, 30]), float(rng.randint(0, 40))))
    return spark.createDataFrame(rows, "league string, season string, season_start int, game_id bigint, ts timestamp, player_id bigint, min int, fantasy_points double")


FORM = ("fantasy_points_avg_last_3", "fantasy_points_avg_last_10", "career_game_count", "season_game_count", "minutes_last_game", "games_played_last_5", "rest_days", "back_to_back")


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_do_not_change_features(spark, seed):
    df = log(spark, seed)
    cols = ["game_id", *FORM]
    one = X.player_form(df, ("fantasy_points",), (3, 10), parts=1)
    many = X.player_form(df, ("fantasy_points",), (3, 10), parts=23)
    assert sorted(map(tuple, many.select(*cols).collect())) == sorted(map(tuple, one.select(*cols).collect()))
    a = sorted(map(str, P.player_states(df, ("fantasy_points",), (3, 10), parts=1).collect()))
    assert sorted(map(str, P.player_states(df, ("fantasy_points",), (3, 10), parts=23).collect())) == a


@pytest.mark.parametrize("long_key", [0, 60, 10**6])
def test_only_long_keys_are_cut(spark, monkeypatch, long_key):
    """All keys in blocks, one long key in blocks beside short and null ones, none in blocks."""
    df = log(spark, 3).withColumn("player_id", F.when(F.col("player_id") != 3, F.col("player_id")))
    cols = ["game_id", *FORM]
    want = sorted(map(str, X.player_form(df, ("fantasy_points",), (3, 10), parts=1).select(*cols).collect()))
    states = sorted(map(str, P.player_states(df, ("fantasy_points",), (3, 10), parts=1).collect()))
    monkeypatch.setattr(logs, "LONG_KEY", long_key)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges of few rows
    try:
        rows = logs.with_blocks(df, X.PLAYER, X.ORDER).filter(F.col(logs.BLOCK).isNotNull())
        cut = {r.player_id for r in rows.select("player_id").distinct().collect()}
        assert cut == set() if long_key == 10**6 else 1 in cut and (long_key == 0 or cut == {1})
        assert sorted(map(str, X.player_form(df, ("fantasy_points",), (3, 10)).select(*cols).collect())) == want
        assert sorted(map(str, P.player_states(df, ("fantasy_points",), (3, 10)).collect())) == states
        assert X.player_form(df.limit(0), ("fantasy_points",), (3,)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_key_and_day_with_most_rows(spark):
    """90 % of the rows under one key on one day, and a null key, in more ranges than keys."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        p = rng.choice([7] * 18 + [8, None])
        t = dt.datetime(2020, 12, 1, rng.randint(0, 23), rng.randint(0, 59)) if p == 7 else dt.datetime(2020, 11, rng.randint(1, 28))
        rows.append(("nba", "2020-21", 2020, i, t, p, rng.choice([None, 0, 10]), float(rng.randint(0, 40))))
    df = spark.createDataFrame(rows, "league string, season string, season_start int, game_id bigint, ts timestamp, player_id bigint, min int, fantasy_points double")
    pdf = df.toPandas().sort_values(["ts", "game_id"])
    got = {r.game_id: r for r in X.player_form(df, ("fantasy_points",), (3, 10), parts=40).collect()}
    assert len(got) == len(rows)
    for _, g in pdf.groupby("player_id", dropna=False):
        want = g["fantasy_points"].shift(1).rolling(10, min_periods=1).mean()
        for k, (i, w) in enumerate(zip(g["game_id"], want)):
            assert got[i].career_game_count == k and got[i].season_game_count == k
            assert got[i].fantasy_points_avg_last_10 == (None if pd.isna(w) else pytest.approx(w))
    states = P.player_states(df, ("fantasy_points",), (3,), parts=40)
    assert states.groupBy("league", "player_id", "day").count().filter("count > 1").isEmpty()


def test_windows_match_pandas(spark):
    df = log(spark, 5)
    pdf = df.toPandas().sort_values(["player_id", "season_start", "ts", "game_id"])
    g = pdf.groupby("player_id")["fantasy_points"]
    pdf["want"] = g.transform(lambda s: s.shift(1).rolling(3, min_periods=1).mean())
    pdf["gap"] = (pdf["ts"] - pdf.groupby("player_id")["ts"].shift(1)).dt.days
    got = {r.game_id: r for r in X.player_form(df, ("fantasy_points",), (3,)).collect()}
    for r in pdf.itertuples():
        v = got[r.game_id]
        assert v.fantasy_points_avg_last_3 == (None if pd.isna(r.want) else pytest.approx(r.want))
        assert v.rest_days == (None if pd.isna(r.gap) else max(int(r.gap) - 1, 0))
        assert v.back_to_back == int(r.gap == 1)


def test_baseline_grain(spark):
    rows = [("nba", "2020-21", 2020, i, dt.datetime(2021, 1, 1, h), float(v)) for i, (h, v) in enumerate([(1, 10), (2, 20), (2, 30)])]
    df = spark.createDataFrame(rows, "league string, season string, season_start int, game_id bigint, ts timestamp, fantasy_points double")
    inst = X.with_baseline(df, grain="instant")
    assert by(inst, "game_id", "new_player_baseline") == {0: None, 1: 10.0, 2: 10.0}
    assert {r.new_player_baseline for r in X.with_baseline(df).collect()} == {None}


def test_filters(spark):
    g = games(spark, [dict(game_id=1, date="2021-01-01T00:00:00Z", status="S"), dict(game_id=2, date="2021-01-22T00:00:00Z", status="S"),
                      dict(game_id=3, date="2021-01-23T00:00:00Z", status="S"), dict(game_id=4, date="2021-01-05T00:00:00Z")])
    assert sorted(r.game_id for r in P.horizon(g, "2021-01-01").collect()) == [1, 2]
    assert P.only_games(g, spark.createDataFrame([("nba", 3)], "league string, game_id bigint")).first().game_id == 3
    assert P.drop_null_rows(spark.createDataFrame([(None,), (1,)], "x int"), ["x"]).count() == 1
