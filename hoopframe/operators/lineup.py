"""Best line-ups per slate and formation fill.

Each player has at most one specialised bucket and the free slots take anyone, so the optimum
is: the best n of every bucket, then the best m of everybody left.  No solver is needed and any
number of slates is solved at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.core import case_map, ranked
from ..functions.scalars import position_bucket

FREE = "UTIL"


def _order(score: str) -> list:
    return [F.desc(score), F.asc("player_id")]


def best_lineup(pool: DataFrame, slate: Sequence[str], slots: Mapping[str, int] | None = None,
                score: str = "projected_points") -> DataFrame:
    """Chosen players with their slot, for every slate that can be filled.

    Only the best n+m players of a bucket can be chosen at all, so the first ranked cut leaves a
    handful of rows per slate and bucket; a large slate is never gathered.
    """
    slots = dict(K.LINEUP_SLOTS if slots is None else slots)
    free = slots.get(FREE, 0)
    need = {b: n for b, n in slots.items() if b != FREE and n > 0}
    usable = pool.filter(F.col(score).isNotNull()).withColumn(
        "bucket", F.coalesce(position_bucket("position"), F.lit("")))
    most = max(need.values(), default=0) + free
    top = ranked(usable, [*slate, "bucket"], _order(score), most, "_in_bucket")
    quota = case_map(F.col("bucket"), need, F.lit(0)) if need else F.lit(0)
    special = F.col("_in_bucket") <= quota
    chosen = top.filter(special).withColumn("slot", F.col("bucket"))
    rest = ranked(top.filter(~special), list(slate), _order(score), free, "_in_free").drop(
        "_in_free").withColumn("slot", F.lit(FREE))
    ok = lineup_status(pool, slate, slots, score).filter("feasible").select(*slate)
    return chosen.unionByName(rest).drop("_in_bucket", "bucket").join(ok, list(slate), "left_semi")


def lineup_status(pool: DataFrame, slate: Sequence[str], slots: Mapping[str, int] | None = None,
                  score: str = "projected_points") -> DataFrame:
    """Whether every slot of a slate can be filled, and the reason when not."""
    slots = dict(K.LINEUP_SLOTS if slots is None else slots)
    need = {b: n for b, n in slots.items() if b != FREE and n > 0}
    ok = F.col(score).isNotNull()
    bucket = position_bucket("position")
    agg = pool.groupBy(*slate).agg(F.count_if(ok).alias("players"), *[
        F.count_if(ok & F.coalesce(bucket == b, F.lit(False))).alias(f"n_{b}") for b in need])
    total = sum(need.values()) + slots.get(FREE, 0)
    reason = F.when(F.col("players") == 0, F.lit("empty pool"))
    for b, n in need.items():
        reason = reason.when(F.col(f"n_{b}") < n, F.lit(f"too few players for {b}"))
    reason = reason.when(F.col("players") < total, F.lit(f"too few players for {FREE}"))
    return agg.withColumn("reason", reason).withColumn("feasible", F.col("reason").isNull())


def display_order(lineup: DataFrame, slate: Sequence[str], slots: Mapping[str, int] | None = None,
                  score: str = "projected_points") -> DataFrame:
    """Specialised slots first, in slot order, best player first."""
    slots = K.LINEUP_SLOTS if slots is None else slots
    order = {b: i for i, b in enumerate([b for b in slots if b != FREE] + [FREE])}
    return lineup.orderBy(*slate, case_map(F.col("slot"), order), F.desc(score), "player_id")


def display_lines(lineup: DataFrame, slate: Sequence[str], slots: Mapping[str, int] | None = None,
                  score: str = "projected_points") -> DataFrame:
    """The same order as a ``line`` number within each slate (a line-up is a few rows)."""
    slots = K.LINEUP_SLOTS if slots is None else slots
    order = {b: i for i, b in enumerate([b for b in slots if b != FREE] + [FREE])}
    return ranked(lineup, slate, [case_map(F.col("slot"), order), F.desc(score), F.asc("player_id")], None, "line")


def total_points(lineup: DataFrame, slate: Sequence[str], score: str = "projected_points") -> DataFrame:
    return lineup.groupBy(*slate).agg(F.sum(score).alias("total_points"), F.count(F.lit(1)).alias("players"))


def formation(board: DataFrame, positions: DataFrame, by: Sequence[str],
              capacity: Mapping[str, int] | None = None) -> DataFrame:
    """Leaders in rank order fill 2 G, 2 F, 1 C; everybody else sits on the bench (slot null)."""
    capacity = K.FORMATION if capacity is None else capacity
    placed = board.join(positions.select("league", "player_id", "position"),
                        ["league", "player_id"], "left").withColumn("bucket", position_bucket("position"))
    out = ranked(placed, [*by, "bucket"], [F.asc("rank")], None, "_pos")
    fits = F.col("_pos") <= case_map(F.col("bucket"), capacity, F.lit(0))
    return out.withColumn("slot", F.when(F.col("bucket").isNotNull() & fits, F.col("bucket"))).drop("_pos")
