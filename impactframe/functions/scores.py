"""Score formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PENALTY_MODES = ("uniform", "game-count", "minutes")


def shrunk_score(games_with: Column, games_without: Column, score: Column, prior_games: float = 10.0) -> Column:
    """Pull a margin towards zero by the harmonic mean of its two sample sizes."""
    if prior_games < 0:
        raise ValueError("prior_games must be non-negative")
    both = (games_with > 0) & (games_without > 0)
    size = 2.0 * games_with * games_without / (games_with + games_without)
    return F.when(both, score * (size / (size + F.lit(float(prior_games))))).when(score.isNotNull(), F.lit(0.0))


def weighted_average(value: Column, weight: Column) -> Column:
    """Aggregate: average over rows that have a value and a positive weight; null if there are none."""
    counted = value.isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(counted, value * weight)), F.sum(F.when(counted, weight)))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation; null with fewer than two rows or a constant side."""
    varied = (F.count("*") >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def player_penalty(
    alpha: Column, mode: Column, strength: Column, minute_scale: Column, games: Column, minutes: Column
) -> Column:
    """Ridge penalty of one player: uniform, or smaller for players seen more."""
    return (
        F.when(mode == "uniform", alpha)
        .when(mode == "game-count", alpha / F.pow(games.cast("double"), strength))
        .when(mode == "minutes", alpha / F.pow(minutes / minute_scale, strength))
    )
