
import pytest
from pyspark.sql import functions as F
from tables import box, by, totals

from hoopframe.operators import boards as B
from hoopframe.operators import careers as C
from hoopframe.operators import schedule as G

ROW = "struct<year:int,team_id:bigint,team:string,gp:bigint,min:double,pts:double,reb:double,ast:double,stl:double,blk:double,fg_pct:double,fg3_pct:double>"
LINE = "struct<" + ",".join(f"{c}:bigint" for c in C.LINE) + ">"
BUNDLE = f"league string, player_id bigint, name string, debut int, position string, jersey string, team string, line {LINE}, rows array<{ROW}>"


def row(year, team=1, gp=80, pts=20.0, reb=4.0, ast=5.0):
    return (year, team, f"T{team}", gp, 30.0, pts, reb, ast, 1.0, 1.0, 50.0, 30.0)


def line(**kw):
    return tuple(kw.get(c, 0) for c in C.LINE)


def bundle(pid, name=None, debut=None, ln=None, rows=None, league="nba"):
    return (league, pid, name, debut, "G", "1", "OLD", ln, rows)


def test_career_totals_two_seasons(spark):
    rows = [dict(game_id=1, season="2019-20", season_start=2019, player_id=1, team_abbrev="BOS", pts=20, fgm=8, fga=16),
            dict(game_id=2, player_id=1, team_abbrev="CLE", pts=30, fgm=11, fga=20), dict(game_id=2, player_id=2, did_not_play=True)]
    out = C.career_totals(B.player_totals(box(spark, rows))).collect()
    assert [(r.player_id, r.seasons, r.gp, r.pts, r.fgm, r.fga, r.team_abbrev, r.peak_impact) for r in out] == [(1, 2, 2, 50, 19, 36, "CLE", 30.0)]


def test_trust_peak_and_debut(spark):
    df = spark.createDataFrame([bundle(1, debut=2000, rows=[row(2001), row(2002, pts=30.0)]), bundle(2, debut=1990, rows=[row(2001)]),
                                bundle(3, debut=None, rows=[row(2001)]), bundle(4, debut=2000, rows=[]), bundle(5, debut=2000, rows=[row(2001, gp=0)])], BUNDLE)
    got = by(df.select("player_id", C.trusted().alias("t"), C.peak_from_rows().alias("p"), C.debut_year().alias("d")), "player_id", "t", "p", "d")
    assert got == {1: (True, 38.0, 2000), 2: (False, 28.0, 1990), 3: (False, 28.0, 2000), 4: (False, None, 2000), 5: (True, None, 2000)}


def test_titles(spark):
    b = spark.createDataFrame([bundle(1, debut=2000, rows=[row(2001, 7), row(2002, 8)]), bundle(2, debut=1990, rows=[row(2001, 7)]),
                               bundle(3, debut=1959, rows=[row(1960)]), bundle(4, debut=2000, rows=[row(2001), row(2003)])], BUNDLE)
    champs = spark.createDataFrame([("nba", 2001, 7), ("nba", 2002, 9)], "league string, year int, team_id bigint")
    assert by(C.titles(b, champs, 2010), "player_id", "championships") == {1: 1, 2: None, 3: None, 4: None}
    fix = spark.createDataFrame([("nba", 3, 11)], "league string, player_id bigint, titles bigint")
    assert by(C.titles(b, champs, 2010, fix), "player_id", "championships")[3] == 11
    filled = C.fill_champions(champs, spark.createDataFrame([("nba", 2001, 1), ("nba", 1999, 2)], "league string, year int, team_id bigint"))
    assert sorted((r.year, r.team_id) for r in filled.collect()) == [(1999, 2), (2001, 7), (2002, 9)]
    assert C.verified_champions(spark).count() == 6


def entries(spark, **kw):
    b = spark.createDataFrame([bundle(1, "Ann", 2000, line(gp=100, pts=900), [row(2001), row(2002)]), bundle(2, None, None, None, None),
                               bundle(3, "Cy", 1990, line(gp=50), [row(2001)]), bundle(4, "Di", 2000, line(gp=0), None)], BUNDLE)
    w = C.career_totals(totals(spark, [dict(player_id=1, gp=60, plus_minus=33, pts=500), dict(player_id=2, player_name="Bo", gp=45, pts=90), dict(player_id=9, gp=5)]))
    honours = spark.createDataFrame([("nba", 3, "MVP", 2), ("nba", 4, "MVP", 1)], "league string, player_id bigint, name string, wins bigint")
    champs = spark.createDataFrame([("nba", 2001, 1), ("nba", 2002, 1)], "league string, year int, team_id bigint")
    ids = C.pool(None, honours, w)
    return C.career_entries(ids, b, w, champs, 2010, **kw), w, honours


def test_entries_and_overlay(spark):
    e, w, honours = entries(spark)
    got = {r.player_id: r for r in e.collect()}
    assert set(got) == {1, 2, 3}
    a = got[1]
    assert (a.line_source, a.gp, a.pts, a.plus_minus, a.seasons, a.championships) == ("history", 100, 900, 33, 2, 2)
    assert a.seasons_log[0].season == "2000-01" and a.peak_impact == 28.0
    assert (got[2].line_source, got[2].player_name, got[2].seasons) == ("window", "Bo", 1)
    assert (got[3].seasons, got[3].peak_impact, got[3].plus_minus) == (None, None, None)
    m = {r.player_id: r for r in C.merge_history(e.drop("seasons_log"), w).collect()}
    assert set(m) == {1, 2, 3, 9} and m[9].line_source == "window" and m[1].pts == 900 and m[1].fga == 0
    assert m[3].seasons is None
    meta = C.history_meta(e, C.pool(None, honours, w), honours.withColumn("year", F.lit(2001)), w.select("league", F.lit(2001).alias("year"))).first()
    assert (meta.pool, meta.history_lines, meta.window_lines, meta.champion_years) == (4, 2, 1, 1)


def test_official_rebounds(spark):
    reb = spark.createDataFrame([("nba", 1, 777)], "league string, player_id bigint, reb bigint")
    e, _, _ = entries(spark, official_rebounds=reb, official_titles=C.official_titles(spark))
    assert by(e, "player_id", "reb")[1] == 777
    b = spark.createDataFrame([bundle(1, rows=[row(2001, reb=0.0), row(2002, reb=3.0)])], BUNDLE)
    fix = spark.createDataFrame([("nba", 1, 2001, 9.5), ("nba", 1, 2002, 9.9)], "league string, player_id bigint, year int, reb double")
    assert [r.reb for r in C.overlay_season_rebounds(b, fix).first().rows] == [9.5, 3.0]
    assert C.official_rebounds(spark).count() == 11 and C.official_season_rebounds(spark).count() > 100


CAREER = "league string, player_id bigint, player_name string, team_abbrev string, seasons bigint, gp bigint, pts bigint, reb bigint, ast bigint, stl bigint, blk bigint, fg3m bigint, fg3a bigint, plus_minus bigint, peak_impact double, championships bigint"


def test_ladder(spark):
    full = ("nba", 1, "A", "T", 10, 100, 2000, 1000, 500, 100, 100, 100, 300, 200, 40.0, 4)
    old = ("nba", 2, "B", "T", 10, 100, 1000, 500, 250, 0, 0, 0, 0, None, None, None)
    neg = ("nba", 3, "C", "T", 10, 200, 2000, 1000, 500, 100, 100, 0, 5, -50, 20.0, 0)
    short = ("nba", 4, "D", "T", 1, 81, 9000, 9000, 9000, 900, 900, 900, 999, 900, 90.0, 9)
    df = spark.createDataFrame([full, old, neg, short], CAREER)
    table = C.honour_table(spark)
    h = spark.createDataFrame([("nba", 1, "MVP", 2), ("nba", 3, "MVP", 1), ("nba", 3, "Unknown", 5)], "league string, player_id bigint, name string, wins bigint")
    got = {r.player_id: r for r in C.ladder(df, h, table).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].production == 100.0 and got[1].score == 100.0 and got[1].data_gaps == []
    assert got[2].data_gaps == ["stl", "blk", "fg3m", "plus_minus", "peak", "championships"]
    assert got[2].production == 50.0 and got[2].score == pytest.approx(50.0 * .35 / .65, abs=0.05)
    assert got[3].data_gaps == [] and got[3].championships_score == 0.0 and got[3].honours_score == 50.0 and got[3].honours_total == 6
    none = {r.player_id: r for r in C.ladder(df, None, table).collect()}
    assert none[1].data_gaps == ["honours"] and none[1].score == 100.0


def test_index_pivot_and_views(spark):
    e, _, honours = entries(spark)
    table = C.honour_table(spark)
    board = spark.createDataFrame([("nba", 1, 1, 88.0)], "league string, player_id bigint, rank int, score double")
    idx = by(C.player_index(e, honours, table, board), "player_id", "honour_points", "ladder_rank")
    assert idx == {1: (0.0, 1), 2: (0.0, None), 3: (12.0, None)}
    assert C.honours_map(honours).filter("player_id = 3").first().honours == {"MVP": 2}
    names = e.select("league", "player_id", "player_name")
    p = C.accolades_pivot(honours, names, ["Ann", "Cy"], table).first()
    assert (p.name, p.points, p.Ann, p.Cy) == ("MVP", 6.0, None, 2)
    wins = spark.createDataFrame([("wnba", 2020, "Sixth Player of the Year", 1), ("nba", 2020, "MVP", 2), ("nba", 2020, "Other", 3)],
                                 "league string, year int, name string, player_id bigint")
    assert {(r.race, r.player_id) for r in C.official_winners(wins).collect()} == {("sixth_man", 1), ("mvp", 2)}
    seasons = totals(spark, [dict(team_abbrev=t, season_start=2010 + i) for i, t in enumerate(("A", "B", "A", "C", "D", ""))])
    assert C.career_teams(seasons).first().teams == "A · B · C +1"


def test_progression(spark):
    log = spark.createDataFrame([("nba", 1, "2019-20", "T", 10, 20.04, 50.0), ("nba", 1, "2020-21", "T", None, 21.0, 51.0), ("nba", 1, None, "T", 9, 1.0, 1.0),
                                 ("nba", 1, "2021-22", "T", 5, 10.0, None)], "league string, player_id bigint, season string, team string, gp int, pts double, fg_pct double")
    assert [(r.season, r.value, r.career_year) for r in C.progression(log, "pts", True).orderBy("season").collect()] == [("2019-20", 200.0, 1), ("2021-22", 50.0, 2)]
    assert C.progression(log, "pts").count() == 3 and C.progression(log, "fg_pct", True).count() == 2


def test_refresh_selection(spark):
    b = spark.createDataFrame([bundle(i, "n", 2000, None, [row(y)]) for i, y in ((1, 2026), (2, 2026), (3, 2010))], BUNDLE).withColumn("complete", F.lit(True)).withColumn(
        "fetched", F.when(F.col("player_id") == 1, "2026-01-08T00:00:00Z").otherwise("2025-12-01T00:00:00Z"))
    pool = spark.createDataFrame([("nba", i) for i in (1, 2, 3, 4)], "league string, player_id bigint")
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    assert sorted(r.player_id for r in G.stale_entries(b, pool, now, 2026).collect()) == [2, 4]


def test_reports(spark):
    df = spark.createDataFrame([("G", 10, 5.0), ("G", 20, 15.0), ("F", 0, 99.0), ("F", 30, 7.0)], "position string, min int, fantasy_points double")
    q = {r.position: (r.low, r.median, r.high) for r in B.score_quantiles(df).collect()}
    assert q == {"G": (5.0, 10.0, 15.0), "F": (7.0, 7.0, 7.0)}
    assert B.score_quantiles(df, approx=True).count() == 2
    fit = B.minutes_fit(df.filter("position = 'G'")).first()
    assert (fit.slope, fit.intercept, fit.n) == (1.0, -5.0, 2)
