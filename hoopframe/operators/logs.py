"""Ordered per-key windows that stay balanced whatever share of the rows one key owns.

A window over ``partitionBy(player).orderBy(time)`` puts a whole player into one task.  Keys are
counted first, with map-side partial sums.  Rows of keys that fit into a task go to their window
straight, with one shuffle.  Rows of long keys are range-partitioned by (key, order) and written
once; the number of the range is the block.  A key that reaches over a block's edge (at most one
key does so at each edge, null keys included) is windowed block by block:

* row counts before a block come from a prefix sum over the few rows of a block table,
* the rows a short look-back needs from earlier blocks (the last L rows) are copied to the
  start of the block and dropped again after the window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage

BLOCK = "_block"
HALO = "_halo"
#: Rows of a key that one task orders at ease, and how many keys at most are cut into blocks: only
#: keys with more rows than both this number and the MOST_LONG-th part of all rows are.
LONG_KEY, MOST_LONG = 1_000_000, 10_000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the keys come out once."""
    named = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return left.join(named, cond, how).drop(*[f"_on_{k}" for k in keys])


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` over ranges, with ``_block``: the number of the range for keys that reach over an edge, else null."""
    by = [*keys, *order]
    rows = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    rows = stage(rows.withColumn(BLOCK, F.spark_partition_id()), "log")
    wide = rows.groupBy(*keys).agg(F.min(BLOCK).alias("_lo"), F.max(BLOCK).alias("_hi")).filter("_lo < _hi")
    listed = F.broadcast(wide.select(*keys, F.lit(True).alias("_wide")))  # at most one key an edge between ranges
    return join_on(rows, listed, keys, "left").withColumn(BLOCK, F.when(F.col("_wide"), F.col(BLOCK))).drop("_wide")


def with_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Adds ``_block``: the number of the range for long keys that reach over an edge, else null.

    ``parts`` puts all rows over that many ranges, whatever the length of their keys.
    """
    if parts:
        return ranged(df, keys, order, parts)
    none = F.lit(None).cast("int")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    bound = max(LONG_KEY, total // MOST_LONG)
    if most <= bound:
        return df.withColumn(BLOCK, none)
    long = F.broadcast(sizes.filter(F.col("_n") > bound).select(*keys, F.lit(True).alias("_long")))  # fewer than MOST_LONG
    marked = join_on(df, long, keys, "left")
    short = marked.filter(F.col("_long").isNull()).drop("_long").withColumn(BLOCK, none)
    return short.unionByName(ranged(marked.filter("_long").drop("_long"), keys, order))


def with_halo(blocked: DataFrame, keys: Sequence[str], order: Sequence[str], lookback: int) -> DataFrame:
    """Adds, for every block of a wide key, copies (``_halo`` true) of the last ``lookback``
    rows before it."""
    cols = blocked.columns
    wide = blocked.filter(F.col(BLOCK).isNotNull())
    back = Window.partitionBy(*keys, BLOCK).orderBy(*[F.desc(o) for o in order])
    tails = (wide.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= lookback)
             .select(*keys, F.col(BLOCK).alias("_b"), F.struct(*cols).alias("_row")))
    # per wide key at most (blocks x lookback) tail rows; gather the last ones before each block
    starts = wide.select(*keys, F.col(BLOCK).alias("_b")).distinct().withColumn(
        "_row", F.lit(None).cast(tails.schema["_row"].dataType))
    seq = Window.partitionBy(*keys).orderBy("_b", F.col("_row").isNotNull(), *[
        F.col(f"_row.{o}") for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    # a start marker sorts before the tails of its own block
    near = tails.unionByName(starts)
    kept = near.withColumn("_seen", F.count("_row").over(seq))
    marks = kept.filter(F.col("_row").isNull()).select(*keys, F.col("_b").alias("_to"),
                                                       F.col("_seen").alias("_hi"))
    rows = kept.filter(F.col("_row").isNotNull()).select(*keys, (F.col("_seen") + 1).alias("_pos"), "_row")
    # every tail row goes to the next blocks whose look-back still reaches it: its position
    # p serves marks with p <= hi < p + lookback, an equality join on the explicit positions
    reach = marks.select(*keys, "_to", F.explode(F.when(
        F.col("_hi") > 0, F.sequence(F.greatest(F.col("_hi") - lookback + 1, F.lit(1)), F.col("_hi")))).alias("_pos"))
    copies = join_on(rows, reach, [*keys, "_pos"]).select("_to", "_row.*").withColumn(BLOCK, F.col("_to"))
    return blocked.withColumn(HALO, F.lit(False)).unionByName(
        copies.select(*cols).withColumn(HALO, F.lit(True)))


def block_counts(blocked: DataFrame, keys: Sequence[str], order: Sequence[str], within: str) -> DataFrame:
    """One row per wide key, block and ``within`` value: rows in all earlier blocks (``_before``),
    those with the same ``within`` value (``_before_within``), and the order columns of the next
    block's first row (``_next_first``)."""
    wide = blocked.filter(F.col(BLOCK).isNotNull())
    first = F.min(F.struct(*order)).alias("_first")
    parts = wide.groupBy(*keys, BLOCK, within).agg(F.count(F.lit(1)).alias("_n"), first)
    blocks = parts.groupBy(*keys, BLOCK).agg(F.sum("_n").alias("_all"), F.min("_first").alias("_first"))
    by = Window.partitionBy(*keys).orderBy(BLOCK)
    frame = (Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, BLOCK, F.coalesce(F.sum("_all").over(by.rowsBetween(*frame)), F.lit(0)).alias("_before"),
                           F.lead("_first").over(by).alias("_next_first"))
    same = Window.partitionBy(*keys, within).orderBy(BLOCK).rowsBetween(*frame)
    parts = parts.select(*keys, BLOCK, within, F.coalesce(F.sum("_n").over(same), F.lit(0)).alias("_before_within"))
    return join_on(parts, blocks, [*keys, BLOCK])


@dataclass
class Log:
    """Rows ready for ordered windows over ``keys``; ``finish`` after the windows."""

    rows: DataFrame
    keys: list[str]
    counts: DataFrame
    within: str

    def own(self) -> Column:
        """1 for real rows, null for look-back copies."""
        return F.when(~F.col(HALO), F.lit(1))

    def finish(self, df: DataFrame, total: str | None = None, within: str | None = None,
               next_first: tuple[str, Column] | None = None) -> DataFrame:
        """Drop the copies and add the rows of earlier blocks to the named counts.

        ``next_first`` is (column, expression over ``_next_first``): a look-ahead of one row that
        is null on a block's last row is filled from the next block.
        """
        out = join_on(df.filter(~F.col(HALO)), self.counts, [*self.keys, self.within], "left")
        for name, extra in ((total, "_before"), (within, "_before_within")):
            if name is not None:
                out = out.withColumn(name, F.col(name) + F.coalesce(extra, F.lit(0)))
        if next_first is not None:
            out = out.withColumn(next_first[0], F.coalesce(F.col(next_first[0]), next_first[1]))
        return out.drop("_before", "_before_within", "_next_first", HALO, BLOCK)


def open_log(df: DataFrame, keys: Sequence[str], order: Sequence[str], lookback: int,
             within: str = "season_start", parts: int | None = None) -> Log:
    """Prepare ``df`` for windows partitioned by ``log.keys`` and ordered by ``order``.

    Frames may reach back ``lookback`` rows; counts over everything before a row go through
    ``Log.finish``. ``parts`` puts all rows over that many ranges; by default only long keys
    are cut into blocks.
    """
    blocked = with_blocks(df, keys, order, parts)
    return Log(with_halo(blocked, keys, order, lookback), [*keys, BLOCK],
               block_counts(blocked, keys, order, within), within)
