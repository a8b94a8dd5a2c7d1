"""Half-open bands and ordered labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..schema import GENERATION_SPLIT, POWER_LEVEL_BANDS, TIME_OF_DAY_BANDS


def band(value: Column, bands: Sequence[tuple[str, float, float]]) -> Column:
    """First band with low <= value < high, null outside all of them."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(list(bands)):
        out = F.when((value >= low) & (value < high), F.lit(name)).otherwise(out)
    return out


def time_of_day(time: Column) -> Column:
    return band(F.hour(time), TIME_OF_DAY_BANDS)


def power_level(actual: Column, rated: Column) -> Column:
    share = band(actual / rated, POWER_LEVEL_BANDS)
    return F.when(F.coalesce(rated, F.lit(0.0)) == 0, F.lit("unscaled")).otherwise(share)


def generation_level(actual: Column, rated: Column, split: float = GENERATION_SPLIT) -> Column:
    level = F.when(actual / rated >= split, F.lit("high_generation")).otherwise(
        F.lit("low_generation"))
    return F.when(F.coalesce(rated, F.lit(0.0)) == 0, F.lit("unknown")).otherwise(level)


def rank_of(value: Column, order: Sequence[str]) -> Column:
    """Index of a label in a fixed order, 99 when it is not listed."""
    at = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    return F.when(at > 0, at - 1).otherwise(F.lit(99)).cast("int")
