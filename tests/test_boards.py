import pytest
from pyspark.sql import functions as F
from tables import box, by, games, totals

from hoopframe.operators import boards as B


def records(spark, items):
    cols = "league string, season string, season_start int, team_abbrev string, wins int, losses int, games int, win_pct double, opp_pg double"
    return spark.createDataFrame([("nba", "2020-21", 2020, *i) for i in items], cols)


def bars(spark, n, season=2020):
    return spark.createDataFrame([("nba", f"{season}-{(season + 1) % 100:02d}", season, n)], "league string, season string, season_start int, min_gp int")


def test_bar(spark):
    t = [0, 1, 4, 10, 15, 16, 73, 82, 100]
    df = spark.createDataFrame([(x,) for x in t], "t int").select(B.season_bar(F.col("t")).alias("b"))
    assert [r.b for r in df.collect()] == [1, 1, 2, 5, 8, 8, 36, 41, 50]


def test_mvp_multiplier_and_gate(spark):
    t = totals(spark, [dict(player_id=i, player_name=n, team_abbrev=tm, gp=g, pts=200, reb=80, ast=60)
                       for i, n, tm, g in ((1, "a", "GOOD", 10), (2, "b", "BAD", 10), (3, "c", "GOOD", 9))])
    t = t.withColumn("oreb", F.lit(0))
    r = records(spark, [("GOOD", 8, 2, 10, 0.8, 100.0), ("BAD", 2, 8, 10, 0.2, 100.0)])
    got = by(B.mvp(t, r, bars(spark, 10)), "player_id", "score")
    assert got == {1: 22.26, 2: 16.46}


def test_unknown_team_is_neutral(spark):
    t = totals(spark, [dict(player_id=1, team_abbrev="ZZZ", pts=100)])
    row = B.mvp(t, records(spark, [("AAA", 1, 0, 1, 1.0, 1.0)]), bars(spark, 1)).first()
    assert (row.win_pct, row.wins, row.score) == (0.5, None, 8.0)


def test_sixth_man_boundary(spark):
    t = totals(spark, [dict(player_id=1, starts=4, pts=200, ast=40, reb=40), dict(player_id=2, starts=5, pts=200, ast=40, reb=40)])
    rows = B.sixth_man(t, bars(spark, 1)).collect()
    assert [(r.player_id, r.start_pct, r.score) for r in rows] == [(1, 0.4, 23.0)]


def test_mip(spark):
    now = [dict(player_id=1, pts=800, minutes=1600, gp=40), dict(player_id=2, pts=800, minutes=1200, gp=40), dict(player_id=3, pts=10, minutes=0, gp=40)]
    prev = [dict(player_id=1, pts=800, minutes=1200, gp=40), dict(player_id=2, pts=600, minutes=1200, gp=40), dict(player_id=3, pts=9, minutes=9, gp=40)]
    t = totals(spark, now + [{**p, "season": "2019-20", "season_start": 2019} for p in prev])
    rows = B.mip(t, bars(spark, 1)).orderBy("rank").collect()
    assert [(r.player_id, r.score) for r in rows] == [(2, 6.0), (1, -6.0)]
    assert B.mip(totals(spark, now), bars(spark, 1)).count() == 0


def test_roy(spark):
    t = totals(spark, [dict(player_id=1, pts=100), dict(player_id=2, pts=200)])
    debuts = spark.createDataFrame([("nba", 1, 2020), ("nba", 2, 2015)], "league string, player_id bigint, debut int")
    assert [r.player_id for r in B.roy(t, bars(spark, 1), debuts).collect()] == [1]
    assert B.roy(t, bars(spark, 1), None) is None
    assert B.roy(t, bars(spark, 1), debuts.limit(0)).count() == 0


def test_leaders_cut_at_ten_and_ties_by_name(spark):
    t = totals(spark, [dict(player_id=i, player_name=f"n{99 - i}", pts=100) for i in range(12)])
    rows = B.stat_leaders(t, bars(spark, 1), ("pts",)).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 11)) and rows[0].player_name == "n88"


def test_totals_team_and_appearances(spark):
    rows = [dict(game_id=9, team_abbrev="X", pts=1, starter=False), dict(game_id=10, team_abbrev="Y", pts=2),
            dict(game_id=11, team_abbrev="Z", did_not_play=True, pts=50), dict(game_id=12, team_abbrev="", pts=None, min=None)]
    r = B.player_totals(box(spark, rows)).first()
    assert (r.gp, r.starts, r.minutes, r.pts, r.team_abbrev) == (3, 2, 60, 3, "Y")


def test_records_draw_goes_away_and_text_scores(spark):
    g = games(spark, [dict(game_id=1), dict(game_id=2, home_score=90), dict(game_id=3, status="STATUS_SCHEDULED"), dict(game_id=4, home_score=None)])
    assert by(B.team_records(g), "team_abbrev", "wins", "losses", "win_pct", "opp_pg") == {"AAA": (1, 1, 0.5, 90.0), "BBB": (1, 1, 0.5, 95.0)}
    text = B.final_games(g.withColumn("home_score", F.lit("125.0"))).first()
    assert text.home_score == 125


def test_series_mvp(spark):
    g = games(spark, [dict(game_id=i, home_score=100 if i < 4 else 90, away_score=95) for i in (1, 2, 3, 4)] + [dict(game_id=5, home_score=0, away_score=0)])
    g = g.withColumn("series", F.lit("s"))
    line = dict(pts=20, fgm=8, fga=16, ast=4)
    rows = [dict(game_id=i, player_id=p, team_abbrev=t, **line) for i in (1, 2, 3, 4) for p, t in ((1, "AAA"), (2, "BBB"), (3, "AAA"))]
    rows += [dict(game_id=1, player_id=4, team_abbrev="AAA", pts=90), dict(game_id=2, player_id=5, did_not_play=True), dict(game_id=5, player_id=1, pts=500)]
    out = B.series_mvp(box(spark, rows).withColumn("series", F.lit("s")), g, ("league", "season", "series"))
    got = by(out, "player_id", "gp", "win_pct")
    assert got == {1: (4, 0.75), 2: (4, 0.25), 3: (4, 0.75)}
    s = by(out, "player_id", "score")
    assert s[1] == pytest.approx((20 + 3.2 - 11.2 + 2.8) * 0.9, abs=0.01)


def test_season_races_equal_single_boards(spark):
    t = totals(spark, [dict(player_id=i, pts=100 + i, stl=i, starts=i % 10, gp=10, minutes=200 + i, season_start=s, season=f"{s}-{(s + 1) % 100:02d}", reb=s - 2000)
                       for i in range(1, 30) for s in (2019, 2020)])
    r = records(spark, [("AAA", 5, 5, 10, 0.5, 99.0)]).unionByName(records(spark, [("AAA", 5, 5, 10, 0.4, 98.0)]).withColumns(
        {"season": F.lit("2019-20"), "season_start": F.lit(2019)}))
    q = B.qualifiers(r)
    debuts = spark.createDataFrame([("nba", i, 2020) for i in range(1, 6)], "league string, player_id bigint, debut int")
    allr = B.season_races(t, r, debuts)
    parts = {"mvp": B.mvp(t, r, q), "dpoy": B.dpoy(t, r, q), "sixth_man": B.sixth_man(t, q), "mip": B.mip(t, q), "roy": B.roy(t, q, debuts)}
    for name, df in parts.items():
        want = {(x.season, x["rank"], x.player_id, x.score) for x in df.collect()}
        assert {(x.season, x["rank"], x.player_id, x.score) for x in allr.filter(F.col("race") == name).collect()} == want, name


def test_live_races(spark):
    cand = spark.createDataFrame([("nba", 1, 7), ("nba", 2, 7), ("nba", 3, 8)], "league string, player_id bigint, team_id bigint")
    lines = totals(spark, [dict(player_id=i, gp=g, pts=p) for i, g, p in ((1, 10, 100), (2, 5, 100), (3, 4, 90))]).drop(
        "team_abbrev", "starts", "minutes", "season", "season_start")
    teams = spark.createDataFrame([("nba", 7, "AAA"), ("nba", 8, "BBB")], "league string, team_id bigint, abbrev string")
    stand = spark.createDataFrame([("nba", 7, 3, 1), ("nba", 8, 0, 0)], "league string, team_id bigint, wins int, losses int")
    rows = by(B.live_mvp(cand, lines, teams, stand), "player_id", "score", "win_pct")
    assert rows == {1: (9.0, 0.75), 2: (18.0, 0.75)}
    assert by(B.live_mvp(cand, lines, teams, None), "player_id", "score", "wins") == {1: (8.0, None), 2: (16.0, None)}
    prof = spark.createDataFrame([("nba", 1, "Ann", 2020), ("nba", 2, "Bo", None), ("nba", 3, "Cy", 2019)], "league string, player_id bigint, player_name string, draft_year int")
    assert by(B.live_roy(cand, prof, lines, teams, 2020), "player_id", "player_name") == {1: "Ann"}
    assert B.unknown_draft(cand, prof).first().undrafted == 1


def test_kpi_and_summary(spark):
    b = box(spark, [dict(game_id=1, pts=10), dict(game_id=2, pts=20, min=0)])
    g = games(spark, [dict(game_id=1), dict(game_id=3, date="2021-02-01T00:00:00Z", status="STATUS_SCHEDULED"), dict(game_id=4, date="2020-12-01T00:00:00Z", status="STATUS_POSTPONED")])
    t, r = B.player_totals(b), B.team_records(g)
    k = B.kpi_strip(b, g, t, B.qualifiers(r), "2021-01-15").first()
    assert (k.games_collected, str(k.next_tip), k.top_ppg) == (2, "2021-02-01 00:00:00", 15.0)
    s = B.dataset_summary(b).first()
    assert (s.n_rows, s.n_games, s.share_played) == (2, 2, 0.5)
    order = spark.createDataFrame([("nba", "2021-22", 0), ("nba", "2020-21", 1)], "league string, season string, priority int")
    assert B.first_season_with_rows(b, order).count() == 2


def test_one_player_with_most_rows(spark):
    """A key with a third of all rows gives the same totals as a plain sum."""
    rows = [dict(game_id=i, player_id=1 if i % 3 == 0 else i, pts=i % 7, team_abbrev=f"T{i % 4}") for i in range(1, 600)]
    got = by(B.player_totals(box(spark, rows)), "player_id", "gp", "pts")
    assert got[1] == (199 + 1, sum(i % 7 for i in range(1, 600) if i % 3 == 0 or i == 1))
