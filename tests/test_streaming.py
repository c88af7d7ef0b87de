import datetime as dt
import json
import shutil

from pyspark.sql import functions as F
from tables import box, games
from test_sources import player, write_boxes

from hoopframe.operators import boards as B
from hoopframe.operators import snapshots as N
from hoopframe.sources import files as S
from hoopframe.sources import staging
from hoopframe.streaming import incremental as T


def ingest(spark, tmp_path, pattern, **kw):
    T.ingest_box_scores(spark, pattern, str(tmp_path / "fact"), str(tmp_path / "rejects"), str(tmp_path / "ck"), "wnba", **kw).awaitTermination()
    return spark.read.parquet(str(tmp_path / "fact")), spark.read.parquet(str(tmp_path / "rejects"))


def test_box_score_stream(spark, tmp_path):
    pattern = write_boxes(tmp_path / "raw")
    fact, bad = ingest(spark, tmp_path, pattern)
    assert fact.count() == 2 and bad.count() == 4
    again = T.offered_again(spark, str(tmp_path / "rejects"), fact)
    assert {r.game_id for r in again.collect()} == {2, 3, 4, 5}

    # a repaired file, a duplicate of a stored game and a new game arrive later
    d = tmp_path / "raw" / "2024" / "games"
    good = lambda g: json.dumps({"game": {"game_id": g}, "players": [player(g, 1, 1), player(g, 2, 2)]})
    sub = tmp_path / "raw" / "2025" / "games"
    sub.mkdir(parents=True)
    (sub / "6.json").write_text(good(6))
    extra = tmp_path / "raw" / "again" / "2024" / "games"
    extra.mkdir(parents=True)
    (extra / "1.json").write_text(good(1))
    fact, _ = ingest(spark, tmp_path, pattern, files_per_batch=1)
    assert fact.groupBy("game_id").count().collect() and fact.count() == 4
    batch, _ = S.read_box_scores(spark, pattern, "wnba")
    assert {(r.game_id, r.player_id) for r in batch.collect()} == {(r.game_id, r.player_id) for r in fact.collect()}
    assert d.exists()


def test_replay_changes_nothing(spark, tmp_path):
    pattern = write_boxes(tmp_path / "raw")
    fact, _ = ingest(spark, tmp_path, pattern)
    n = fact.count()
    shutil.move(str(tmp_path / "ck"), str(tmp_path / "old-ck"))
    fact, _ = ingest(spark, tmp_path, pattern)
    assert fact.count() == n


def test_documents_are_not_held_in_memory(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    held = []
    for name in ("persist", "cache"):
        monkeypatch.setattr(DataFrame, name, lambda self, *_, n=name: held.append(n) or self)
    monkeypatch.setattr(DataFrame, "unpersist", lambda self, *_: self)
    monkeypatch.setattr(staging, "shared_dir", lambda session: str(tmp_path / "shared"))
    fact, bad = ingest(spark, tmp_path, write_boxes(tmp_path / "raw"))
    assert fact.count() == 2 and bad.count() == 4 and not held
    assert [p.name for p in (tmp_path / "shared" / "hoopframe").glob("documents-*")] == []  # written for the batch only


def test_schedule_upsert(spark, tmp_path):
    table = str(tmp_path / "schedule")
    base = games(spark, [dict(game_id=i) for i in (1, 2, 3)]).withColumn("feed", F.lit(0))
    none = spark.createDataFrame([], "league string, season string, failures int")
    one = spark.createDataFrame([("nba", "2020-21", 1)], "league string, season string, failures int")
    T.upsert_batch(spark, table, base, "feed", none)
    T.upsert_batch(spark, table, base.filter("game_id < 3"), "feed", one)
    assert spark.read.parquet(table).count() == 3
    T.upsert_batch(spark, table, base.filter("game_id < 3"), "feed", none)
    assert spark.read.parquet(table).count() == 2
    other = base.withColumn("season", F.lit("2021-22"))
    T.upsert_batch(spark, table, other, "feed", none)
    assert spark.read.parquet(table).count() == 5


SNAP = "league string, season string, snap_date date, arrival int, race string, rank int, player_id bigint, player_name string, score double"


def snap(day, arrival, score, season="2020-21"):
    return ("nba", season, dt.date(2021, 1, 1) + dt.timedelta(days=day), arrival, "mvp", 1, 7, "P", score)


def fold(rows, cap=90):
    """The rule as a plain loop."""
    kept = []
    for r in sorted(rows, key=lambda x: (x[2], x[3])):
        if kept and kept[-1][8] == r[8]:
            continue
        if kept and kept[-1][2] == r[2]:
            kept[-1] = r
        else:
            kept.append(r)
    return [(r[2], r[8]) for r in kept[-cap:]]


def test_snapshot_rule(spark):
    cases = [[(0, 0, 1.0), (1, 0, 1.0)], [(0, 0, 1.0), (1, 0, 2.0)], [(0, 0, 1.0), (1, 0, 2.0), (1, 1, 3.0)],
             [(0, 0, 1.0), (1, 0, 2.0), (1, 1, 1.0)], [(0, 0, 1.0), (1, 0, 1.0), (1, 1, 2.0), (2, 0, 2.0), (3, 0, 1.0)],
             [(i, 0, float(i)) for i in range(96)]]
    for case in cases:
        rows = [snap(*c) for c in case]
        got = sorted((r.snap_date, r.score) for r in N.keep_changed(spark.createDataFrame(rows, SNAP), cap=90).collect())
        assert got == fold(rows), case
    rows = [snap(i, 0, float(i)) for i in range(96)]
    assert N.keep_changed(spark.createDataFrame(rows, SNAP)).count() == 96


def test_snapshots_with_repeated_rows(spark):
    """Contents that differ only in which row is there twice are different."""
    a, b, c = 1.0, 2.0, 3.0
    rows = [snap(0, 0, x) for x in (a, a, c)] + [snap(1, 0, x) for x in (b, b, c)]
    assert N.keep_changed(spark.createDataFrame(rows, SNAP)).count() == 6


def test_snapshot_stream_equals_batch(spark, tmp_path):
    days = [1.0, 1.0, 2.0, 2.0, 3.0, 1.0, 1.0]
    rows = [snap(i, 0, v) for i, v in enumerate(days)]
    table = str(tmp_path / "snapshots")
    for r in rows:
        T.snapshot_batch(spark, table, spark.createDataFrame([r], SNAP))
        T.snapshot_batch(spark, table, spark.createDataFrame([r], SNAP))  # replayed batch
    got = sorted((r.snap_date, r.score) for r in spark.read.parquet(table).collect())
    assert got == fold(rows)
    assert T.snapshot_batch(spark, table, spark.createDataFrame([snap(0, 0, 9.0, "2021-22")], SNAP)) is None
    assert spark.read.parquet(table).select("season").distinct().count() == 2


def test_file_streams(spark, tmp_path):
    """The same rules behind real streams: one file per pull, oldest first."""
    none = spark.createDataFrame([], "league string, season string, failures int")
    schema = spark.createDataFrame([snap(0, 0, 1.0)], SNAP).schema
    src, table = str(tmp_path / "arrivals"), str(tmp_path / "kept")
    days = [1.0, 2.0, 2.0, 3.0]
    for i, v in enumerate(days):
        spark.createDataFrame([snap(i, 0, v)], SNAP).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        T.ingest_snapshots(stream, table, str(tmp_path / "ck1")).awaitTermination()
    assert sorted((r.snap_date, r.score) for r in spark.read.parquet(table).collect()) == fold([snap(i, 0, v) for i, v in enumerate(days)])

    pulls, stored = str(tmp_path / "pulls"), str(tmp_path / "schedule")
    base = games(spark, [dict(game_id=i, home_score=None if i == 2 else 1) for i in (1, 2)]).withColumn("feed", F.lit(0))
    for pull in (base, games(spark, [dict(game_id=i) for i in (1, 2)]).withColumn("feed", F.lit(0))):
        pull.coalesce(1).write.mode("append").parquet(pulls)
        T.ingest_schedule(spark.readStream.schema(base.schema).parquet(pulls), stored, str(tmp_path / "ck2"), "feed", none).awaitTermination()
    assert {r.game_id: r.home_score for r in spark.read.parquet(stored).collect()} == {1: 100, 2: 100}


def test_snapshot_views(spark):
    rows = [("nba", "2020-21", dt.date(2021, 1, d), "mvp", r, p, f"P{p}", float(s)) for d, r, p, s in
            ((1, 1, 1, 9), (1, 2, 2, 8), (2, 1, 2, 9), (2, 2, 1, 8), (2, 3, 3, 7))]
    s = spark.createDataFrame(rows, SNAP.replace("arrival int, ", ""))
    assert {r.player_id: r.delta for r in N.race_movement(s).collect()} == {1: -1, 2: 1}
    assert N.race_movement(s.filter("snap_date = '2021-01-01'")).count() == 0
    trend = {(r.snap_date.day, r.player_id): r.score for r in N.race_trend(s).collect()}
    assert trend[(1, 3)] is None and len(trend) == 6
    assert N.race_trend(s.filter("snap_date = '2021-01-01'")).count() == 0
    won = spark.createDataFrame([("nba", "2020-21", "mvp", "P2"), ("nba", "2020-21", "dpoy", "P9")], "league string, season string, race string, player_name string")
    races = s.filter("snap_date = '2021-01-02'")
    assert {r.race: r.verdict for r in N.official_vs_top(races, won).collect()} == {"mvp": "agree", "dpoy": None}
    assert N.snapshot_rows(races, 2).count() == 2


def test_tracker(spark):
    w = spark.createDataFrame([("nba", y, 1) for y in range(2010, 2023)], "league string, year int, player_id bigint")
    c = spark.createDataFrame([("nba", 2022, 5)], "league string, year int, team_id bigint")
    t = N.finals_tracker(w, c, "2022-11-01")
    top = N.other_seasons(t, "2021-22").collect()
    assert top[0].season == "2022-23" and top[0].pending and len(top) == 10 and top[1].season == "2020-21"
    assert t.filter("season = '2021-22'").first().team_id == 5
    assert N.finals_tracker(w, c, "2022-02-01").filter("pending").count() == 0
    assert N.best_profiles(w.withColumn("rank", F.col("year") - 2009)).count() == 4


def test_late_rows_recompute_only_their_season(spark):
    b = box(spark, [dict(game_id=1), dict(game_id=2, season="2021-22", season_start=2021)])
    out = T.recompute_seasons(b, b.filter("game_id = 2"))
    assert [r.season for r in out.collect()] == ["2021-22"]
    assert B.player_totals(b).count() == 2


def test_snapshot_state_in_any_order(spark, tmp_path):
    """Pulls in a shuffled order, some twice, against the batch rule on all of them."""
    import random

    from hoopframe.streaming import snapshot_state as Z
    rng = random.Random(4)
    rows = [snap(day, a, float(rng.randint(0, 2)), season) for day in range(8) for a in range(2) for season in ("2020-21", "2021-22")]
    arrivals = spark.createDataFrame(rows, SNAP)
    pulls = Z.pulls(arrivals)
    order = list(range(4))
    for part in order:
        some = pulls.where(F.pmod(F.xxhash64("season", "snap_date", "arrival"), F.lit(4)) == (part * 3 + 1) % 4)
        some.coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
        if part == 2:
            some.coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))  # offered again
        stream = spark.readStream.schema(pulls.schema).parquet(str(tmp_path / "land"))
        Z.follow_snapshots(stream, str(tmp_path / "updates"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(tuple(r) for r in Z.stored_snapshots(spark, str(tmp_path / "updates")).select("season", "snap_date", "score").collect())
    want = sorted(tuple(r) for r in N.keep_changed(arrivals).select("season", "snap_date", "score").collect())
    assert got == want and len(want) > 6


def test_bundles_and_rejects_by_league(spark, tmp_path):
    good = lambda g, pts: json.dumps({"game": {"game_id": g}, "players": [{**player(g, 1, 1), "pts": pts}, player(g, 2, 2)]})
    rows = [("r/2024/games/1.json", "2024-01-01", good(1, 5)), ("r/2024/games/1.json", "2024-01-02", good(1, 9)), ("r/2024/games/2.json", "2024-01-01", "{"),
            ("r/2024/games/3.json", "2024-01-01", good(4, 1))]
    df = spark.createDataFrame(rows, "path string, modified string, body string").withColumn("modified", F.col("modified").cast("timestamp"))
    df.write.parquet(str(tmp_path / "land"))
    batch, bad = S.read_bundle(spark, str(tmp_path / "land"), "wnba")
    assert {(r.game_id, r.player_id, r.pts) for r in batch.collect()} >= {(1, 1, 9)} and {r.reason for r in bad.collect()} == {"unreadable", "game id differs"}
    run = lambda ck: T.ingest_documents(spark, T.bundle_documents(spark, str(tmp_path / "land"), 1), str(tmp_path / "f"), str(tmp_path / "r"), str(tmp_path / ck), "wnba").awaitTermination()
    run("ck1")
    fact = spark.read.parquet(str(tmp_path / "f"))
    assert fact.where("game_id = 1").count() == 2
    run("ck2")
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    assert {r.game_id for r in T.offered_again(spark, str(tmp_path / "r"), fact).collect()} == {2, 3}
    other = fact.withColumn("game_id", F.lit(2)).withColumn("league", F.lit("nba"))
    assert {r.game_id for r in T.offered_again(spark, str(tmp_path / "r"), fact.unionByName(other)).collect()} == {2, 3}


def test_headers_of_several_versions(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.csv").write_text("game_id,season,status\n1,2020,F\n\n2,2020\nx,2020,F\n")
    (tmp_path / "v" / "b.csv").write_text('"status","game_id","extra","round"\nF,3,q,"Finals, ""last"""\nF,4,q,r,s\n')
    rows, bad = S.read_versions(spark, str(tmp_path / "v"), ("game_id", "season", "status", "round"))
    assert {(r.game_id, r.season, r.status, r.round) for r in rows.collect()} == {("1", "2020", "F", None), ("3", None, "F", 'Finals, "last"')}
    assert {(r.line, r.reason) for r in bad.collect()} == {("2,2020", "cells differ from the header"), ("F,4,q,r,s", "cells differ from the header"),
                                                          ("x,2020,F", "no whole number under game_id")}
