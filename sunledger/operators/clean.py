"""Outlier repair, target sanity and stuck-sensor detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from ..plans.chunks import CHUNK_STEPS, over_halo
from ..schema import (FLATLINE_STEPS, FLATLINE_TOLERANCE, GHI_MAX, GHI_MIN, MAD_TO_SIGMA,
                      NIGHT_ELEVATION_MAX, NIGHT_OFFSET_MAX, SPIKE_RATIO, SPIKE_SIGMA,
                      SPIKE_WINDOW)

SITE = ["site"]


def _centred_median(value: Column, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(value).over(frame) >= least,
                  F.percentile(value, F.lit(0.5)).over(frame))


def robust_bounds(df: DataFrame, value: str, window: int = SPIKE_WINDOW,
                  n_sigma: float = SPIKE_SIGMA, keys: Sequence[str] = SITE,
                  order: str = "step", chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Centred rolling median and the band ``n_sigma`` robust deviations around it.

    The deviation at a row is taken from that row's own median, and its rolling median
    reaches one more half window, so the halo spans two half windows.
    """
    half, least = window // 2, max(3, window // 3)

    def centre(w: WindowSpec) -> dict[str, Column]:
        return {"rolling_median": _centred_median(F.col(value), w.rowsBetween(-half, half), least)}

    def spread(w: WindowSpec) -> dict[str, Column]:
        away = F.abs(F.col(value) - F.col("rolling_median"))
        return {"_mad": _centred_median(away, w.rowsBetween(-half, half), least)}

    out = over_halo(df, keys, order, centre, spread, before=2 * half, after=2 * half,
                    chunk_steps=chunk_steps)
    reach = n_sigma * MAD_TO_SIGMA * F.col("_mad")
    return out.withColumns({"upper_bound": F.col("rolling_median") + reach,
                            "lower_bound": F.col("rolling_median") - reach}).drop("_mad")


def clean_irradiance(df: DataFrame, value: str = "ghi", elevation: str = "solar_elevation",
                     keys: Sequence[str] = SITE, order: str = "step",
                     plausible: tuple[float, float] = (GHI_MIN, GHI_MAX),
                     window: int = SPIKE_WINDOW, ratio: float = SPIKE_RATIO,
                     night_max: float = NIGHT_ELEVATION_MAX, zero_below_horizon: bool = True,
                     night_offset_max: float = NIGHT_OFFSET_MAX) -> DataFrame:
    """Repair readings in a fixed order and flag what was changed.

    Envelope, local spikes, final clamp, night offset. The rolling statistics are those
    of the raw readings. Adds ``<value>_clean`` and one boolean per kind of change.
    """
    low, high = plausible
    out = robust_bounds(df, value, window, keys=keys, order=order)
    raw, median = F.col(value), F.col("rolling_median")

    def flagged(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    out = out.withColumn("out_of_envelope", flagged((raw < low) | (raw > high)))
    out = out.withColumn("_v1", F.when(F.col("out_of_envelope"), median).otherwise(raw))
    v1 = F.col("_v1")
    out = out.withColumn("is_spike", flagged((v1 > F.col("upper_bound")) & (v1 > ratio * median)))
    out = out.withColumn("_v2", F.when(F.col("is_spike"), median).otherwise(v1))
    v2 = F.col("_v2")
    out = out.withColumns({"clipped_high": flagged(v2 > high), "raised_low": flagged(v2 < low)})
    out = out.withColumn("_v3", F.when(F.col("clipped_high"), F.lit(high))
                         .when(F.col("raised_low"), F.lit(low)).otherwise(v2))
    v3 = F.col("_v3")
    offset = (F.col(elevation) <= night_max) & (v3 > 0)
    if not zero_below_horizon:
        offset = offset & (v3 <= night_offset_max)
    out = out.withColumn("night_zeroed", flagged(offset))
    return out.withColumn(f"{value}_clean", F.when(F.col("night_zeroed"), F.lit(0.0))
                          .otherwise(v3)).drop("_v1", "_v2", "_v3")


def irradiance_summary(cleaned: DataFrame, value: str = "ghi",
                       elevation: str = "solar_elevation", keys: Sequence[str] = SITE,
                       night_max: float = NIGHT_ELEVATION_MAX) -> DataFrame:
    """Counts of each correction and the effect on maximum, mean and night bias."""
    raw, clean = F.col(value), F.col(f"{value}_clean")
    night = F.col(elevation) <= night_max
    return cleaned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_input"), F.count_if(raw.isNull()).alias("n_input_missing"),
        F.count_if("out_of_envelope").alias("n_envelope"),
        F.count_if("is_spike").alias("n_spikes"),
        F.count_if("clipped_high").alias("n_clipped_high"),
        F.count_if("raised_low").alias("n_raised_low"),
        F.count_if("night_zeroed").alias("n_night_zeroed"),
        F.max(raw).alias("original_max"), F.max(clean).alias("cleaned_max"),
        F.avg(raw).alias("original_mean"), F.avg(clean).alias("cleaned_mean"),
        F.avg(F.when(night, raw)).alias("night_bias_before"),
        F.avg(F.when(night, clean)).alias("night_bias_after"))


def clip_negative(value: Column) -> Column:
    """Negative generation is an inverter offset; nulls stay null."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def target_summary(df: DataFrame, stations: DataFrame, value: str = "pv_power_w",
                   keys: Sequence[str] = SITE) -> DataFrame:
    v = F.col(value)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(v < 0).alias("n_negative_clipped"),
        F.max(clip_negative(v)).alias("observed_max_w"))
    rated = stations.select(*keys, "rated_w")
    return out.join(rated, list(keys), "left").withColumns({
        "fraction_negative": F.col("n_negative_clipped") / F.col("n_rows"),
        "max_to_rated_ratio": F.col("observed_max_w") / F.col("rated_w")})


def flag_flatlines(df: DataFrame, value: str, out: str = "flatline",
                   min_length: int = FLATLINE_STEPS, tolerance: float = FLATLINE_TOLERANCE,
                   keys: Sequence[str] = SITE, order: str = "step",
                   chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Flag steps of a run of at least ``min_length`` unchanged steps.

    The step that starts the run is not flagged. A step belongs to such a run exactly
    when some ``min_length`` consecutive unchanged steps cover it, which is a bounded
    frame however long the run is.
    """
    reach = min_length - 1

    def unchanged(w: WindowSpec) -> dict[str, Column]:
        change = F.abs(F.col(value) - F.lag(value).over(w))
        return {"_same": F.when(change <= tolerance, 1).otherwise(0)}

    def full(w: WindowSpec) -> dict[str, Column]:
        return {"_full": F.sum("_same").over(w.rowsBetween(-reach, 0)) == min_length}

    def covered(w: WindowSpec) -> dict[str, Column]:
        return {out: F.max("_full").over(w.rowsBetween(0, reach))}

    return over_halo(df, keys, order, unchanged, full, covered,
                     before=min_length, after=reach, chunk_steps=chunk_steps).drop("_same", "_full")
