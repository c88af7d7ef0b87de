"""Rows that lie together stay together, groups stay bounded, nothing is moved or gathered twice."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

import tables as T
from hoopframe.operators import boards as B
from hoopframe.operators import features as X
from hoopframe.plans import bindings as D
from hoopframe.plans import catalog, ops_queries, payload_queries, stream_queries
from hoopframe.sources import files as S
from hoopframe.sources import staging
from hoopframe.streaming import incremental as I


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """Orders of two years with six lines each, forty players, two of the lines of one player."""
    d = str(tmp_path_factory.mktemp("tiny"))
    day = dt.datetime(1995, 3, 1)
    orders = [(k, k * 7 % 100, "P" if k % 10 == 0 else "F", day + dt.timedelta(days=k * 5), "5-LOW") for k in range(1, 121)]
    lines = [(k, k * 13 % 50 + n, (k * 5 + min(n, 5) * 3) % 40 + 1, n, float(n * k % 50 + 1), 0.04, 0.02, "R" if (k + n) % 9 == 0 else "N", day)
             for k, *_ in orders for n in range(1, 7)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, "
                                 "l_returnflag string, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, f"Supplier#{k:09d}") for k in range(1, 41)], "s_suppkey long, s_name string").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(k, f"N{k}") for k in range(3)], "n_nationkey int, n_name string").write.parquet(f"{d}/nation.parquet")
    return d


def test_games_lie_in_one_part_and_parts_grow_with_the_lines(spark, tiny, monkeypatch):
    monkeypatch.setattr(D, "LINES_A_TASK", 20)
    at = D.box(spark, tiny).select("game_id", F.spark_partition_id().alias("p"))
    assert at.groupBy("game_id").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
    assert at.agg(F.countDistinct("p")).first()[0] > 16  # 36 parts for 720 lines; adaptive execution leaves them


def test_player_totals_take_the_parts_given(spark):
    rows = [dict(game_id=g, player_id=p, pts=g, team_abbrev="ABC"[(g + p) % 3]) for g in range(1, 9) for p in range(1, 30)]
    box = T.box(spark, rows)
    wide, plain = B.player_totals(box, parts=5), B.player_totals(box)
    assert wide.rdd.getNumPartitions() == 5
    assert sorted(wide.collect()) == sorted(plain.collect())


def test_player_totals_of_a_constant_league_move_once_after_the_first_aggregate(spark, tiny):
    plan = B.player_totals(D.box(spark, tiny), parts=5).select("player_id", "team_abbrev")._jdf.queryExecution().executedPlan().toString()
    after_join = plan[:plan.index("Join")]
    assert after_join.count("Exchange hashpartitioning(") == 2  # four before: rows dealt by the league's literal moved again


def test_titles_stage_what_they_read(spark, tiny, monkeypatch):
    from hoopframe.plans import career_queries
    seen = []
    write = staging.stage
    monkeypatch.setattr(career_queries, "stage", lambda df, name: seen.append(df.columns) or write(df, name))
    got = catalog.QUERIES["titles"](spark, tiny)
    assert seen == [["league", "player_id", "season_start", "team_abbrev"]]
    whole = career_queries.bundles(career_queries.staged_totals(spark, tiny), spark, tiny)
    want = career_queries.C.titles(whole, career_queries.champions(spark, tiny), career_queries.END_YEAR)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() > 20


def test_supplier_names_of_long_negative_and_null_ids(spark):
    ids = [0, 7, 999_999_999, 1_000_000_000, -5, None]
    df = spark.createDataFrame([(i,) for i in ids], "k long").select("k", D.supplier_name(F.col("k")).alias("n"), F.format_string("Supplier#%09d", "k").alias("w"))
    assert all(r.n == r.w for r in df.collect()) and df.count() == 6


def test_series_are_joined_where_games_lie(spark, tiny, monkeypatch):
    seen = []
    write = staging.stage
    monkeypatch.setattr("hoopframe.plans.board_queries.stage", lambda df, name: seen.append((name, spark.conf.get(staging.PARTIAL_KEYS))) or write(df, name))
    before = spark.conf.get(staging.PARTIAL_KEYS)
    catalog.QUERIES["series_mvp"](spark, tiny)
    assert seen == [("series_mvp", "false")] and spark.conf.get(staging.PARTIAL_KEYS) == before
    catalog.QUERIES["team_form"](spark, tiny)
    assert seen[1:] == [("player_games", "false")] and spark.conf.get(staging.PARTIAL_KEYS) == before


def test_team_form_of_rows_with_null_ids_and_seasons_that_start_twice(spark):
    rows = [(y, g, t, o) for y in (2020, 2021) for g, t, o in ((1, 1, 2), (1, 2, 1), (2, 1, None), (2, None, 1), (3, 1, 2), (3, 2, 1))]
    df = spark.createDataFrame([("nba", "s", y, g, dt.datetime(y, 1, g), t, o, True, float(g), 1.0, float(g * y), 1, 30, i) for i, (y, g, t, o) in enumerate(rows)],
                               "league string, season string, season_start int, game_id long, ts timestamp, team_id long, opponent_id long, is_home boolean, "
                               "team_score double, opp_score double, fantasy_points double, played int, min int, player_id long")
    good, _ = X.team_game_table(df)
    out = X.join_team_form(df, X.team_form(good, keep=("season_start",))).collect()
    assert len(out) == len(rows)  # the same season under two start years used to double its rows
    got = {(r.season_start, r.game_id, r.team_id): (r.team_form_pf, r.opp_form_pf) for r in out}
    assert got[2020, 1, 1] == (None, None) and got[2020, 3, 1] == (1.5, 1.0) and got[2021, 1, 1] == (2.0, 2.0)
    assert got[2020, 2, None] == (None, 1.0)  # an unknown team still meets its opponent's form
    old = X.join_team_form(df.where("season_start = 2020"), X.team_form(good.where("season_start = 2020"))).collect()
    assert {(r.game_id, r.team_id): (r.team_form_pf, r.opp_form_pf) for r in old} == {k[1:]: v for k, v in got.items() if k[0] == 2020}


def test_leader_documents_are_bounded(spark, tiny, monkeypatch):
    monkeypatch.setattr(payload_queries, "PLAYERS_A_DOC", 10)
    t = payload_queries.totals(spark, tiny)
    docs = payload_queries.leader_payload(spark, tiny, t)
    sizes = [r.payload.count("athletes/") for r in docs.collect()]
    assert max(sizes) <= 3 * 10 and len(sizes) > 4
    found = payload_queries.P.leader_candidates(docs).count()
    assert found == t.select("season", "player_id").distinct().count()


def test_documents_hold_many_games(spark, tiny, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "fresh_path", lambda spark, name: str(tmp_path / name))
    out = catalog.QUERIES["read_documents"](spark, tiny)
    assert out.where("kind = 'game'").count() == 120 and out.where("kind = 'position'").count() == 40
    bound = stream_queries.GAMES_A_DOC
    assert bound >= 10_000 and len(glob.glob(str(tmp_path / "documents/seasons/*.json"))) == D.games(spark, tiny).select("season").distinct().count()


def test_stored_documents_are_not_gathered_again(spark, tiny, tmp_path, monkeypatch):
    land, table, rejects = (str(tmp_path / n) for n in ("land", "table", "rejects"))
    docs = stream_queries.game_bodies(spark, tiny)
    path = F.concat(F.lit("raw/"), "season", F.lit("/games/"), F.col("game_id").cast("string"), F.lit(".json"))
    docs.select(path.alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modified"), "body").write.parquet(land)
    gathered, rows = [], S.player_rows
    monkeypatch.setattr(S, "player_rows", lambda d, league: gathered.append(d.count()) or rows(d, league))
    for i in range(2):
        I.ingest_documents(spark, I.bundle_documents(spark, land), table, rejects, str(tmp_path / f"ck{i}"), "nba").awaitTermination()
    assert gathered[0] > 0 and gathered[1:] == [0]


def test_models_keep_only_what_they_read(spark, tiny, monkeypatch):
    kept = {}
    write = staging.stage
    monkeypatch.setattr(ops_queries, "stage", lambda df, name: kept.update({name: df.columns}) or write(df, name))
    monkeypatch.setattr(ops_queries.G, "train", lambda *a, **k: spark.createDataFrame([], ops_queries.G.MODEL))
    monkeypatch.setattr(ops_queries.G, "load", lambda held: {})
    monkeypatch.setattr(ops_queries.G, "score", lambda rows, *a: rows.withColumns({c: F.lit(1.0) for c in ("single", "p_play", "points")}))
    ops_queries.models_of(spark, tiny)
    assert "team_score" not in kept["features"] and "player_name" not in kept["features"] and "naive" in kept["features"]
    assert len(kept["scored"]) == len(ops_queries._ROW) + 4
