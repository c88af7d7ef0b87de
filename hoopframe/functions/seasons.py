"""Season labels: '2010-11' (split-year leagues) and '2026' (single-year leagues)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K
from .core import as_col


def _two(year: Column) -> Column:
    return F.lpad((year % 100).cast("string"), 2, "0")


def _by_label(league: Column | str, split: Column, single: Column) -> Column:
    singles = [k for k, v in K.LEAGUES.items() if v["label"] == "single"]
    return F.when(as_league(league).isin(*singles), single).otherwise(split)


def as_league(league: Column | str) -> Column:
    """A league given by name is a literal; a column stays a column."""
    return F.lit(league) if isinstance(league, str) else league


def start_label(start: Column | str, league: Column | str) -> Column:
    """Label of the season that starts in year ``start``."""
    y = as_col(start).cast("int")
    return _by_label(league, F.concat(y.cast("string"), F.lit("-"), _two(y + 1)), y.cast("string"))


def season_start_year(label: Column | str) -> Column:
    """'2025-26' -> 2025, '2026' -> 2026; any other shape is an error."""
    label = as_col(label)
    year = F.regexp_extract(label, r"^(\d{4})(-\d{2})?$", 1)
    return F.when(label.isNull(), F.lit(None).cast("int")).when(
        year != "", F.try_to_number(year, F.lit("9999")).cast("int")
    ).otherwise(F.raise_error(F.concat(F.lit("malformed season label: "), label)).cast("int"))


def season_param(label: Column | str, league: Column | str) -> Column:
    """The year a season ends ('2010-11' -> 2011); a single-year label as it is."""
    start = season_start_year(label)
    return _by_label(league, start + 1, start)


def season_label(param: Column | str, league: Column | str) -> Column:
    """Inverse of season_param."""
    p = as_col(param).cast("int")
    return _by_label(league, F.concat((p - 1).cast("string"), F.lit("-"), _two(p)), p.cast("string"))


def previous_season(label: Column | str, league: Column | str) -> Column:
    return start_label(season_start_year(label) - 1, league)


def season_label_from_date(ts: Column | str, league: Column | str) -> Column:
    """Aug-Dec starts a new season, Jan-Jul belongs to the one before; single: the year."""
    d = as_col(ts)
    y = F.year(d)
    return start_label(_by_label(league, F.when(F.month(d) >= 8, y).otherwise(y - 1), y), league)


def current_season_label(today: Column | str, league: Column | str) -> Column:
    """The season being played or entered on a supplied date."""
    d = as_col(today)
    y = F.year(d)
    split = F.when(F.month(d) >= 7, y).otherwise(y - 1)
    single = F.when(F.month(d) < 11, y).otherwise(y + 1)
    return start_label(_by_label(league, split, single), league)


def latest_completed_season(today: Column | str, league: Column | str) -> Column:
    """The newest season that can count as complete on a supplied date."""
    d = as_col(today)
    y = F.year(d)
    single = F.when(F.month(d) >= 11, y).otherwise(y - 1)
    return start_label(_by_label(league, y - 1, single), league)


def season_rank(label: Column | str) -> Column:
    """Order of labels: the known range first, any other label after it by start year."""
    start = season_start_year(label)
    known = start.between(K.FIRST_KNOWN_SEASON, K.LAST_KNOWN_SEASON)
    return F.when(known, start - K.FIRST_KNOWN_SEASON).otherwise(start + 10000)


def season_spine(spark: SparkSession, league: str, first: int, last: int) -> DataFrame:
    """One row per season of a generated range of start years."""
    lo, hi = min(first, last), max(first, last)
    return spark.range(lo, hi + 1).select(
        F.lit(league).alias("league"), start_label(F.col("id"), league).alias("season"),
        F.col("id").cast("int").alias("season_start"))
