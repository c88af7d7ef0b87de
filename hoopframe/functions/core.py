"""Small expression helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c: Column | str, digits: int) -> Column:
    """floor(x * 10^n + 0.5) / 10^n.

    One explicit rounding rule for the whole library, so that any engine gives
    the same digits.  Unlike Python's ``round`` an exact tie goes up.
    """
    scale = float(10 ** digits)
    return F.floor(as_col(c).cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def nz(c: Column | str) -> Column:
    """Missing counts as zero (sums only, never rates)."""
    return F.coalesce(as_col(c), F.lit(0))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num/den as double, null when the denominator is null or zero."""
    den = as_col(den).cast("double")
    return F.when(den != 0, as_col(num).cast("double") / den)


def weighted_sum(weights: Mapping[str, float], columns: Sequence[str] | None = None) -> Column:
    """Sum of weight * coalesce(column, 0), left to right in the order of ``weights``.

    Weights of columns that are not in ``columns`` are skipped.
    """
    names = [n for n in weights if columns is None or n in columns]
    terms = [F.lit(float(weights[n])) * nz(n) for n in names]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> null in every float column (for data that has been through pandas)."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns
    ])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None = None,
           name: str = "rank") -> DataFrame:
    """Position in the ordered list per group, cut at ``k``.

    With ``k`` Spark puts a group limit below the shuffle, so at most k rows per
    group and input partition are exchanged, however large a group is.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w))
    return out if k is None else out.filter(F.col(name) <= k)


def board_order(score: str, tie: str) -> list[Column]:
    """Rounded score, then a second rounded rate, then name, then id."""
    return [F.desc(score), F.desc(tie), F.asc(F.coalesce(F.col("player_name"), F.lit(""))),
            F.asc("player_id")]


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in ``order``.

    An aggregate, not a window: rows are reduced before the shuffle, so a key with
    very many copies stays cheap.  ``order`` columns must not be null.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[as_col(o) for o in order])).alias("_first"))
    return best.select(*keys, *[F.col("_first")[c].alias(c) for c in rest]).select(*df.columns)


def literal_map(mapping: Mapping[str, object]) -> Column:
    """A literal map column from a (small, fixed) dictionary."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def case_map(key: Column, mapping: Mapping[str, object], default: Column | None = None) -> Column:
    """CASE key WHEN ... over a (small, fixed) dictionary."""
    items = list(mapping.items())
    out = F.when(key == F.lit(items[0][0]), F.lit(items[0][1]))
    for k, v in items[1:]:
        out = out.when(key == F.lit(k), F.lit(v))
    return out if default is None else out.otherwise(default)


def text_order(id_col: Column | str) -> Column:
    """A number that sorts whole non-negative ids as their text sorts ('10' < '9').

    Numeric on purpose: aggregates over it stay hash aggregates, text would force a sort.
    """
    s = as_col(id_col).cast("string")
    return F.rpad(s, 19, "0").cast("decimal(19,0)") * F.lit(32) + F.length(s)
