import json

import pytest
from pyspark.sql import functions as F
from tables import box, games

from hoopframe.operators import schedule as C
from hoopframe.sources import files as S
from hoopframe.sources import payloads as P
from hoopframe.sources import sinks as W


def player(game, pid, team, **kw):
    return dict(game_id=game, date="2024-05-21T23:30Z", season="ignored", team_id=team, team_abbrev=f"T{team}", player_id=pid,
                player_name=f"P{pid}", starter=True, did_not_play=False, is_home=team == 1, pts=10, min=20, **kw)


def write_boxes(root):
    d = root / "2024" / "games"
    d.mkdir(parents=True)
    good = {"game": {"game_id": 1, "date": "2024-05-21T23:30Z"}, "players": [player(1, 1, 1), player(1, 2, 2)]}
    (d / "1.json").write_text(json.dumps(good))
    (d / "2.json").write_text(json.dumps({**good, "game": {"game_id": 99}}))
    (d / "3.json").write_text(json.dumps({"game": {"game_id": 3}, "players": [player(3, 1, 1)]}))
    (d / "4.json").write_text(json.dumps(good)[:60])
    (d / "5.json").write_text(json.dumps({"game": {"game_id": 5}, "players": []}))
    return str(root / "*" / "games" / "*.json")


def test_box_scores_and_rejects(spark, tmp_path):
    rows, bad = S.read_box_scores(spark, write_boxes(tmp_path), "wnba")
    got = rows.collect()
    assert sorted(r.player_id for r in got) == [1, 2] and {r.season for r in got} == {"2024"} and got[0].season_start == 2024
    assert str(got[0].ts) == "2024-05-21 23:30:00"
    assert {r.file_id: r.reason for r in bad.collect()} == {2: "game id differs", 3: "fewer than two teams", 4: "unreadable", 5: "no players"}


def test_schedule_csv_and_documents(spark, tmp_path):
    head = "game_id,date,season,home_id,home_abbrev,home_score,away_id,away_abbrev,away_score,status,neutral"
    (tmp_path / "a.csv").write_text(f"{head},round\n1,2018-08-22T00:30Z,2018,11,PHX,101.0,3,DAL,83.0,STATUS_FINAL,False,FIRST ROUND\n")
    (tmp_path / "b.csv").write_text(f"{head}\n2,2018-08-23T00:30Z,2018,11,PHX,,3,DAL,,STATUS_SCHEDULED,True\n")
    both = C.union_all([S.read_schedule(spark, str(tmp_path / f), "wnba") for f in ("a.csv", "b.csv")])
    got = {r.game_id: r for r in both.collect()}
    assert got[1].home_score == 101 and got[1]["round"] == "FIRST ROUND" and got[2].home_score is None and got[2].neutral
    doc = {"season": "2018", "games": [{"game_id": "7", "date": "2018-08-22T00:30Z", "home_score": "94", "neutral": "True"}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    r = S.read_season_docs(spark, str(tmp_path / "d.json"), "wnba").first()
    assert (r.game_id, r.season, r.home_score, r.neutral, r.away_score) == (7, "2018", 94, True, None)


def test_positions_and_envelopes(spark, tmp_path):
    rows = [{"player_id": 1, "position": "G", "team_id": 5}, {"player_id": 1, "position": "F"}, {"player_id": 2, "position": "C"}]
    for name, doc in (("env", {"players": rows}), ("bare", rows), ("none", {"players": []})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    read = lambda n: {r.player_id: r.position for r in S.read_positions(spark, str(tmp_path / f"{n}.json"), "nba").collect()}
    assert read("env") == read("bare") == {1: "G", 2: "C"} and read("none") == {}
    (tmp_path / "t.json").write_text(json.dumps({"teams": [{"team_id": 1, "abbrev": "ATL", "display_name": "Atlanta"}]}))
    (tmp_path / "s.json").write_text(json.dumps({"season": "2026", "standings": [{"team_id": 1, "wins": 3, "losses": 1, "win_percent": ".750"}]}))
    (tmp_path / "i.json").write_text(json.dumps({"injuries": [{"player_name": "A", "status": "Out"}]}))
    assert S.read_teams(spark, str(tmp_path / "t.json"), "nba").first().abbrev == "ATL"
    assert S.read_standings(spark, str(tmp_path / "s.json"), "nba").first().win_percent == ".750"
    assert S.read_injuries(spark, str(tmp_path / "i.json"), "nba").first().status == "Out"


def test_injuries_payload_without_field_is_an_error(spark):
    raw = spark.createDataFrame([("nba", '{"injuries": []}')], "league string, payload string")
    assert P.flatten_injuries(raw).count() == 0
    with pytest.raises(Exception, match="no 'injuries' field"):
        P.flatten_injuries(spark.createDataFrame([("nba", '{"other": 1}')], "league string, payload string")).collect()


def test_payload_edges(spark):
    make = lambda doc: spark.createDataFrame([("nba", json.dumps(doc))], "league string, payload string")
    side = lambda hw, i: {"homeAway": hw, "team": {"id": str(i), "abbreviation": hw}, "score": {"value": 90.0 + i}}
    comp = {"id": "5", "date": "2026-01-05T00:00Z", "competitors": [side("home", 1), side("away", 2)]}
    line = lambda pid, stats, **kw: {"athlete": {"id": str(pid), "shortName": f"s{pid}"}, "stats": stats, **kw}
    block = {"team": {"id": "1", "abbreviation": "home"}, "statistics": [{"labels": ["MIN", "FG", "PTS", "+/-"], "athletes": [
        line(1, ["20", "6-13", "15", "-3"]), line(2, [], didNotPlay=True), line(3, ["12", "x"]), {"athlete": {}}]}]}
    doc = {"header": {"competitions": [comp]}, "boxscore": {"players": [block, {"team": {"id": "1"}, "statistics": []}]}}
    got = {r.player_id: r for r in P.flatten_box_score(make(doc)).collect()}
    assert (got[1].fgm, got[1].fga, got[1].pts, got[1].plus_minus, got[1].season) == (6, 13, 15, -3, "2025-26")
    assert (got[2].min, got[2].pts, got[2].fga, got[2].plus_minus, got[2].did_not_play) == (0, 0, 0, None, True)
    assert (got[3].min, got[3].fgm, got[3].pts) == (12, None, None) and got[3].player_name == "s3" and got[3].opponent_id == 2
    meta = P.flatten_box_meta(make(doc)).first()
    assert (meta.home_score, meta.away_abbrev) == (91.0, "away")
    assert P.flatten_box_score(make({"header": {"competitions": [{"competitors": [side("home", 1)]}]}})).count() == 0
    sched = make({"events": [{"id": "1", "date": "2026-01-05T00:00Z", "competitions": []}, {"id": "2", "date": "2026-01-05T00:00Z", "competitions": [comp]}]})
    assert [r.game_id for r in P.flatten_schedule(sched.withColumn("season", F.lit("1999-00"))).collect()] == [2]
    assert P.flatten_schedule(sched.withColumn("season", F.lit("1999-00"))).first().season == "1999-00"
    assert P.filter_plays(P.flatten_plays(make({"plays": [{"text": "a", "scoringPlay": True}, {"text": " "}, {"shortDescription": "b"}]})), scoring_only=True).count() == 1


def test_standings_depths(spark):
    entry = lambda i, w: {"team": {"id": str(i), "name": f"n{i}"}, "stats": [{"name": "wins", "displayValue": str(w)}, {"name": "winPercent", "displayValue": ".5"}]}
    doc = {"children": [{"name": "Eastern Conference", "standings": {"entries": [entry(1, 5)]},
                         "children": [{"name": "Atlantic", "standings": {"entries": [entry(1, 9), entry(2, 6)]},
                                       "children": [{"name": "a", "children": [{"name": "b", "entries": [entry(4, 2)]}]}]}]}],
           "entries": [entry(3, 7)]}
    raw = spark.createDataFrame([("nba", json.dumps(doc))], "league string, payload string")
    got = {r.team_id: (r.wins, r.conference, r.win_percent, r.team) for r in P.flatten_standings(raw).collect()}
    assert got == {1: (5, "Eastern Conference", ".5", "n1"), 2: (6, "Eastern Conference", ".5", "n2"),
                   3: (7, None, ".5", "n3"), 4: (2, "Eastern Conference", ".5", "n4")}


def test_sinks(spark, tmp_path):
    root = str(tmp_path / "fact")
    g = games(spark, [dict(game_id=i, season=s, home_score=i) for i, s in ((1, "2019-20"), (2, "2020-21"), (3, "2020-21"))])
    assert W.write_changed_seasons(g, root).count() == 2
    assert W.write_changed_seasons(g, root).count() == 0
    moved = g.filter("season = '2020-21'").withColumn("home_score", F.col("home_score") + 1)
    assert [r.season for r in W.write_changed_seasons(moved, root).collect()] == ["2020-21"]
    got = {r.game_id: r.home_score for r in S.read_fact(spark, root).collect()}
    assert got == {1: 1, 2: 3, 3: 4}
    assert W.write_changed_seasons(g.limit(0), root).count() == 0 and S.read_fact(spark, root).count() == 3

    flat = str(tmp_path / "flat")
    t = W.stamp(g.select("game_id"), "local", "2026-01-01T00:00:00Z")
    assert W.write_if_changed(t, flat) and not W.write_if_changed(W.stamp(g.select("game_id"), "local", "2027-01-01T00:00:00Z"), flat)
    assert W.write_if_changed(t.filter("game_id < 3"), flat)

    W.export_csv(g, str(tmp_path / "csv"), {"game_id": "Game", "nothing": "No", "season": "Season"})
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["Game", "Season"]


def test_seasons_of_a_table(spark):
    g = games(spark, [dict(game_id=1), dict(game_id=2, season="2021-22", season_start=2021, status="STATUS_SCHEDULED"), dict(game_id=3, season="1999-00", season_start=1999)])
    assert {r.season for r in C.available_seasons(g, 2010).collect()} == {"2020-21", "2021-22"}
    assert C.available_seasons(g).count() == 3
    r = C.latest_season(g).first()
    assert (r.latest, r.latest_played) == ("2021-22", "2020-21")
    order = {r.season: r.priority for r in C.try_order(g, "2022-02-01").collect()}
    assert sorted(order, key=order.get)[0] == "2021-22" and len(order) == 3
    assert {r.season: r.games for r in C.season_counts(g).collect()}["1999-00"] == 1
    teams = spark.createDataFrame([("nba", i) for i in range(29)] + [("wnba", i) for i in range(10)], "league string, team_id int")
    assert {r.league: r.ok for r in C.enough_teams(teams).collect()} == {"nba": False, "wnba": True}
    pos = lambda rows: spark.createDataFrame([("nba", *r) for r in rows], "league string, player_id int, team_id int")
    out = C.refresh_positions(pos([(1, 1), (2, 2)]), pos([(3, 1)]), spark.createDataFrame([("nba", 2)], "league string, team_id int"))
    assert {r.player_id for r in out.collect()} == {2, 3}
    assert [r.game_id for r in C.schedule_order(g.withColumn("ts", F.when(F.col("game_id") != 3, F.col("ts")))).collect()] == [3, 1, 2]
    z = C.zero_table(spark.createDataFrame([("nba", 1, "A")], "league string, team_id int, display_name string"), "2030-31").first()
    assert (z.wins, z.season) == (0, "2030-31")
    assert C.current_only(g, "2021-01-01").count() == 1
    look = C.team_lookup(spark.createDataFrame([("nba", 1)], "league string, team_id int"),
                         spark.createDataFrame([("nba", 1, "ATL", "Atlanta")], "league string, team_id int, abbrev string, display_name string")).first()
    assert look.team_abbrev == "ATL"
    assert box(spark, [dict()]).count() == 1


def test_box_score_cells_run_compiled(spark):
    """HotSpot interprets methods of more than 8000 bytes; the flattening's generated ones stay below."""
    side = lambda hw, i: {"homeAway": hw, "team": {"id": str(i), "abbreviation": hw}, "score": "9"}
    comp = {"id": "5", "date": "2026-01-05T00:00Z", "competitors": [side("home", 1), side("away", 2)]}
    block = {"team": {"id": "2", "abbreviation": "away"}, "statistics": [{"labels": ["PTS", "FT", "PTS", "REB"], "athletes": [
        {"athlete": {"id": "7"}, "stats": ["1", "2-3", "4"]}]}]}
    none = {"team": {"id": "1", "abbreviation": "home"}, "statistics": [{"athletes": [{"athlete": {"id": "8"}, "stats": ["1"]}]}]}
    doc = json.dumps({"header": {"competitions": [comp]}, "boxscore": {"players": [block, none]}})
    raw = spark.createDataFrame([("nba", doc)] * 2, "league string, payload string").repartition(2)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = P.flatten_box_score(raw)
        codegen = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages = codegen.codegenStringSeq(out._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and max(sizes) < 8000, sizes
    got = {(r.player_id, r.pts, r.ftm, r.fta, r.reb, r.fgm, r.min) for r in out.collect()}
    assert got == {(7, 4, 2, 3, None, None, None), (8, None, None, None, None, None, None)}
