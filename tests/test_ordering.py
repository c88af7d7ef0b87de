"""Places, running sums, quantiles and AUC over ranges, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoopframe.operators import models as M
from hoopframe.operators import ordering as O


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice([None, float(rng.randint(0, 6)), float(rng.randint(0, 500))]), i) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(3000), "g string, v double, i long").repartition(7)


def test_places(table):
    got = sorted((r.place, r.i) for r in O.number_rows(table, [F.asc_nulls_last("g"), F.desc_nulls_first("v"), "i"]).collect())
    want = sorted(rows(3000), key=lambda r: (r[0] is None, r[0] or "", r[1] is not None, -(r[1] or 0), r[2]))
    assert got == [(n + 1, r[2]) for n, r in enumerate(want)]
    assert O.number_rows(table.limit(0), ["i"]).count() == 0
    assert set(O.number_rows(table, ["i"]).columns) == {"g", "v", "i", "place"}


def test_running_sum(spark):
    data = [(i, (i * 7) % 11) for i in range(500)]
    got = {r.i: r.s for r in O.running_sum(spark.createDataFrame(data, "i long, w long").repartition(5), ["i"], "w", "s").collect()}
    total = 0
    for i, w in data:
        assert got[i] == total
        total += w


def test_quantiles(table):
    shares = {"low": 0.0, "third": 1 / 3, "half": 0.5, "high": 1.0}
    got = {r.g: r for r in O.quantiles(table, ["g"], "v", shares).collect()}
    for g in ("a", "b", None, "hot"):
        v = [r[1] for r in rows(3000) if r[0] == g and r[1] is not None]
        for name, share in shares.items():
            assert got[g][name] == pytest.approx(np.quantile(v, share))
    plan = O.quantiles(table, ["g"], "v", shares)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower()
    one = O.quantiles(table, [], "v", {"half": 0.5}).first()
    assert one.half == pytest.approx(np.median([r[1] for r in rows(3000) if r[1] is not None]))


def test_auc(spark):
    rng = random.Random(3)
    data = [(rng.choice("xy"), rng.randint(0, 9), rng.randint(0, 1)) for _ in range(600)] + [("one", 1, 1), ("one", 2, 1), (None, 1, 0), (None, 2, 1), ("x", None, 1)]
    df = spark.createDataFrame([(g, None if s is None else float(s), y) for g, s, y in data], "g string, p_play double, played int").repartition(4)
    got = {r.g: r.auc for r in M.auc(df, by=["g"]).collect()}
    for g in ("x", "y", None):
        pos = [s for k, s, y in data if k == g and y == 1 and s is not None]
        neg = [s for k, s, y in data if k == g and y == 0]
        assert got[g] == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
    assert got["one"] is None
