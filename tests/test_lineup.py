import itertools
import random

from hoopframe.operators import lineup as L

SCHEMA = "slate int, player_id bigint, position string, projected_points double"


def pool(spark, items, slate=1):
    return spark.createDataFrame([(slate, i, p, v) for i, (p, v) in enumerate(items)], SCHEMA)


def test_known_optimum(spark):
    p = pool(spark, [("G", 50.0), ("PG", 40.0), ("G", 30.0), ("F", 45.0), ("SF", 35.0), ("C", 44.0), ("C", 10.0)])
    best = L.best_lineup(p, ["slate"])
    assert best.count() == 7 and L.total_points(best, ["slate"]).first().total_points == 254.0
    shown = [r.slot for r in L.display_order(best, ["slate"]).collect()]
    assert shown == ["G", "G", "F", "F", "C", "UTIL", "UTIL"]


def test_infeasible(spark):
    p = pool(spark, [("G", 50.0)] * 4 + [("F", 1.0)] * 4)
    assert L.best_lineup(p, ["slate"]).count() == 0
    assert L.lineup_status(p, ["slate"]).first().reason == "too few players for C"
    assert L.lineup_status(pool(spark, [("G", None)]), ["slate"]).first().reason == "empty pool"
    few = pool(spark, [("G", 1.0), ("G", 1.0), ("F", 1.0), ("F", 1.0), ("C", 1.0), ("C", 1.0)])
    assert L.lineup_status(few, ["slate"]).first().reason == "too few players for UTIL"


def brute(items, slots):
    order = [b for b, n in slots.items() for _ in range(n)]
    best = None
    bucket = {"G": "G", "F": "F", "C": "C"}
    for combo in itertools.permutations(range(len(items)), len(order)):
        if all(b == "UTIL" or bucket.get(items[i][0]) == b for i, b in zip(combo, order)):
            v = sum(items[i][1] for i in combo)
            best = v if best is None else max(best, v)
    return best


def test_brute_force(spark):
    rng = random.Random(7)
    slots = {"G": 1, "F": 1, "C": 1, "UTIL": 2}
    pools = [[(rng.choice(["G", "F", "C", "UNK"]), float(rng.randint(-20, 40))) for _ in range(rng.randint(4, 7))] for _ in range(25)]
    df = spark.createDataFrame([(s, i, p, v) for s, items in enumerate(pools) for i, (p, v) in enumerate(items)], SCHEMA)
    got = {r.slate: (r.total_points, r.players) for r in L.total_points(L.best_lineup(df, ["slate"], slots), ["slate"]).collect()}
    for s, items in enumerate(pools):
        want = brute(items, slots)
        assert got.get(s) == (None if want is None else (want, 5)), s


def test_formation(spark):
    board = spark.createDataFrame([("nba", "2020-21", i, i) for i in range(1, 7)], "league string, season string, player_id bigint, rank int")
    pos = spark.createDataFrame([("nba", 1, "G"), ("nba", 2, "PG"), ("nba", 3, "SG"), ("nba", 4, "C"), ("nba", 5, "UNK")], "league string, player_id bigint, position string")
    got = {r.player_id: r.slot for r in L.formation(board, pos, ("league", "season")).collect()}
    assert got == {1: "G", 2: "G", 3: None, 4: "C", 5: None, 6: None}
