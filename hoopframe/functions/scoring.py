"""Scores and rates built from box score counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K
from .core import half_up, nz, ratio, weighted_sum


def fantasy_points(df: DataFrame, weights: Mapping[str, float] | None = None,
                   name: str = "fantasy_points") -> DataFrame:
    """Weighted sum of the stats present; missing values count 0."""
    w = K.FANTASY_WEIGHTS if weights is None else weights
    return df.withColumn(name, weighted_sum(w, df.columns).cast("double"))


def pct(num: Column | str, den: Column | str) -> Column:
    """0-100, one decimal, null without an attempt."""
    return half_up(ratio(F.lit(100.0) * nz(num), den), 1)


def efficiency() -> dict[str, Column]:
    """FG%, 3P%, FT%, eFG% and true shooting from counts."""
    return {
        "fgp": pct("fgm", nz("fga")),
        "fg3p": pct("fg3m", nz("fg3a")),
        "ftp": pct("ftm", nz("fta")),
        "efg": pct(nz("fgm") + F.lit(0.5) * nz("fg3m"), nz("fga")),
        "ts": pct("pts", F.lit(2.0) * (nz("fga") + F.lit(0.44) * nz("fta"))),
    }


def per_game(stat: Column | str, gp: Column | str = "gp") -> Column:
    """One decimal; no games played gives 0."""
    return F.coalesce(half_up(ratio(nz(stat), gp), 1), F.lit(0.0))


def game_score_total(weights: Mapping[str, float] | None = None) -> Column:
    return weighted_sum(K.GAME_SCORE_WEIGHTS if weights is None else weights)


def game_score(weights: Mapping[str, float] | None = None) -> Column:
    """Game score per game, unrounded."""
    return F.coalesce(ratio(game_score_total(weights), "gp"), F.lit(0.0))


def game_score_per36(weights: Mapping[str, float] | None = None) -> Column:
    """Game score per 36 minutes, unrounded; 0 without recorded minutes."""
    return F.coalesce(ratio(game_score_total(weights) * F.lit(36.0), "minutes"), F.lit(0.0))


def impact() -> Column:
    """(pts + 0.75 reb + ast) per game, unrounded."""
    return F.coalesce(ratio(weighted_sum(K.IMPACT_WEIGHTS), "gp"), F.lit(0.0))


def team_multiplier(share: Column) -> Column:
    """0.6 for a share of 0 up to 1.0 for a share of 1."""
    return F.lit(K.MULTIPLIER_FLOOR) + F.lit(1 - K.MULTIPLIER_FLOOR) * share


def expected_points(p_play: Column | str, points_if_played: Column | str) -> Column:
    """Two-stage expectation p * E."""
    return F.col(p_play) * F.col(points_if_played) if isinstance(p_play, str) else p_play * points_if_played


def rest_group(rest: str = "rest_days", b2b: str = "back_to_back") -> Column:
    """Null when rest is unknown (a first game)."""
    return (F.when(F.col(b2b) == 1, "Back-to-back").when(F.col(rest) <= 1, "1 day rest")
            .when(F.col(rest) > 1, "2+ days rest"))
