"""The model inputs: calendar, weather, lags, trailing statistics, derivatives.

All trailing columns of a table come from one halo window per series chunk, so the
whole block costs a single shuffle and a single sort.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from ..functions import clock
from ..plans.chunks import CHUNK_STEPS, over_halo
from ..plans.summaries import sized
from ..schema import (MODEL_INPUTS, ROLLING_WINDOWS, TARGET_LAGS, WEATHER_COLUMNS, WEATHER_INPUTS,
                      WEATHER_ROLLING_WINDOWS)

SITE = ["site"]


def calendar(order: str = "step") -> dict[str, Column]:
    time = clock.instant(F.col(order))
    hours = clock.hour_float(time)
    day_turn = hours * (2 * math.pi / 24.0)
    year_turn = F.dayofyear(time) * (2 * math.pi / 365.25)
    return {
        "hour": F.hour(time), "minute": F.minute(time), "dayofyear": F.dayofyear(time),
        "year": F.year(time), "month": F.month(time), "day": F.dayofmonth(time),
        "dayofweek": F.weekday(time), "is_weekend": F.weekday(time) >= 5,
        "hours_since_midnight": hours,
        "hour_sin": F.sin(day_turn), "hour_cos": F.cos(day_turn),
        "doy_sin": F.sin(year_turn), "doy_cos": F.cos(year_turn),
    }


def lags(column: str, steps: Sequence[int], prefix: str | None = None):
    prefix = prefix or f"{column}_lag_"

    def build(w: WindowSpec) -> Mapping[str, Column]:
        return {f"{prefix}{k}": F.lag(column, k).over(w) if k else F.col(column) for k in steps}
    return build


STATISTICS = {"mean": F.avg, "std": F.stddev_pop, "max": F.max, "min": F.min}


def trailing(column: str, windows: Sequence[int], statistics: Sequence[str], name: str):
    """``name`` is a pattern with ``{stat}`` and ``{window}``; full windows only."""
    def build(w: WindowSpec) -> Mapping[str, Column]:
        out = {}
        for size in windows:
            frame = w.rowsBetween(-(size - 1), 0)
            full = F.count(column).over(frame) == size
            for stat in statistics:
                value = STATISTICS[stat](column).over(frame)
                out[name.format(stat=stat, window=size)] = F.when(full, value)
        return out
    return build


def derivatives(column: str, steps: Sequence[int] = (1, 4)):
    def build(w: WindowSpec) -> Mapping[str, Column]:
        out = {}
        for k in steps:
            change = F.col(column) - F.lag(column, k).over(w)
            out[f"{column}_delta_{k}"] = change
            out[f"{column}_slope_{k}"] = change / F.lit(float(k))
        return out
    return build


def merged(*builds):
    """Several independent window blocks as one."""
    def build(w: WindowSpec) -> Mapping[str, Column]:
        return {name: column for b in builds for name, column in b(w).items()}
    return build


def weather_inputs(df: DataFrame, allowed: Sequence[str] = WEATHER_INPUTS, lag_steps: int = 1,
                   concurrent: bool = False, keys: Sequence[str] = SITE,
                   order: str = "step") -> DataFrame:
    """Keep admitted weather, optionally delayed; wind direction becomes sine and cosine."""
    present = [c for c in WEATHER_COLUMNS if c in df.columns]
    out = df.drop(*[c for c in present if c not in allowed])
    kept = [c for c in present if c in allowed]
    if not concurrent and lag_steps > 1 and kept:
        out = over_halo(out, keys, order,
                        lambda w: {c: F.lag(c, lag_steps).over(w) for c in kept}, before=lag_steps)
    if "wind_direction" in kept:
        turn = F.radians("wind_direction")
        out = out.withColumns({"wind_direction_sin": F.sin(turn),
                               "wind_direction_cos": F.cos(turn)}).drop("wind_direction")
    return out


def build_features(df: DataFrame, target: str = "pv_power_w", keys: Sequence[str] = SITE,
                   order: str = "step", chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """All trailing, calendar and clear-sky inputs on a gap-free grid.

    A null clearness index stays null in its own column and is zero in the input.
    """
    present = set(df.columns)
    blocks = [
        lags(target, TARGET_LAGS),
        trailing(target, ROLLING_WINDOWS, ("mean", "std"), "pv_rolling_{stat}_{window}"),
    ]
    for column in ("ghi", "temperature"):
        if column in present:
            blocks.append(trailing(column, WEATHER_ROLLING_WINDOWS, ("mean",),
                                   column + "_rollmean_{window}"))
    if "ghi" in present:
        blocks.append(derivatives("ghi"))
    out = over_halo(df, keys, order, merged(*blocks), before=max(TARGET_LAGS),
                    chunk_steps=chunk_steps)
    out = out.withColumns(calendar(order))
    if "clear_sky_index" in present:
        out = out.withColumn("clear_sky_input", F.coalesce("clear_sky_index", F.lit(0.0)))
    return out


def input_columns(df: DataFrame) -> list[str]:
    """The model inputs present in a table, in their documented order."""
    return [c for c in MODEL_INPUTS if c in df.columns]


def drop_warm_up(df: DataFrame, history: int, keys: Sequence[str] = SITE,
                 order: str = "step") -> DataFrame:
    """Drop the first ``history`` grid rows of every series, add season and year."""
    start = df.groupBy(*keys).agg(F.min(order).alias("_start"))
    time = clock.instant(F.col(order))
    return (df.join(sized(start), list(keys)).where(F.col(order) >= F.col("_start") + history)
            .drop("_start")
            .withColumns({"season": clock.season(time, title=False), "year": F.year(time)}))
