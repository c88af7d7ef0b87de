"""Places in a total order of a whole table, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .logs import join_on

#: ``monotonically_increasing_id`` holds the partition above this bit and the row's place in it below.
SHIFT = 33


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """The rows written in ranges of the order; ``_at`` is the range and the place in it."""
    return stage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_at", F.monotonically_increasing_id()), "ordered")


def _firsts(held: DataFrame, amount) -> DataFrame:
    """``_range`` and ``_before``: what all earlier ranges hold. One row a range, so one small window."""
    sizes = held.groupBy(F.shiftright("_at", SHIFT).alias("_range")).agg(F.sum(amount).alias("_held"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_range", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"))


def number_rows(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Adds the row's place, from 1, in the order of the given columns or sort expressions.

    One exchange: rows are range-partitioned by the order, sorted within their range, counted
    there and written; a range's first place is the sum of the ranges before it, a table with one
    row a range. Equal rows fall into one range, so the order should end with an id. An empty
    table stays empty; the columns ``_at``, ``_range`` and ``_before`` are used inside.
    """
    held = _ranged(df, order)
    placed = held.join(F.broadcast(_firsts(held, F.lit(1))), F.shiftright("_at", SHIFT) == F.col("_range"))
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << SHIFT) - 1) + 1).drop("_at", "_range", "_before")


def running_sum(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` (whole numbers) over all earlier rows in the order, 0 for the first.

    Ranges as in ``number_rows``; within a range a window sums, so no task sees more than one.
    """
    held = _ranged(df, order).withColumn("_range", F.shiftright("_at", SHIFT))
    earlier = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = held.withColumn("_local", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    return (local.join(F.broadcast(_firsts(held.drop("_range"), F.col(value))), "_range")
            .withColumn(name, F.col("_before") + F.col("_local")).drop("_at", "_range", "_before", "_local"))


def rank_bounds(rows: DataFrame, group: list, value: str) -> DataFrame:
    """Each distinct value of a group with its count ``n``, the group's rows ``total`` and those below it ``below``.

    Order statistics without a state per group: counts per value, then running counts over ranges.
    Null values don't count; null groups are a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    placed = stage(running_sum(counts, [*[F.asc_nulls_first(g) for g in group], value], "n", "_sum"), "values")
    if not group:
        return placed.withColumns({"total": F.lit(placed.agg(F.sum("n")).first()[0]).cast("long"), "below": F.col("_sum")}).drop("_sum")
    whole = placed.groupBy(*group).agg(F.sum("n").alias("total"), F.min("_sum").alias("_first"))
    return join_on(placed, whole, group).withColumn("below", F.col("_sum") - F.col("_first")).drop("_sum", "_first")


def quantiles(rows: DataFrame, group: list, value: str, shares: dict[str, float]) -> DataFrame:
    """One row a group with the named quantiles, linear between the two nearest rows."""
    bounds = rank_bounds(rows, group, value)
    out = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("total") - 1)
        low, high = F.floor(at), F.ceil(at)

        def held(k):
            return F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col(value)))

        weight = F.max(at - low)
        out.append(F.when(weight == 0, held(low)).otherwise((1 - weight) * held(low) + weight * held(high)).alias(name))
    return bounds.groupBy(*group).agg(*out)
