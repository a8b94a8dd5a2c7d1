"""Solar position, daylight and clear-sky columns for (site, step) tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock, solar
from ..plans.chunks import once
from ..plans.ranks import at_share, order_statistics
from ..plans.summaries import attached
from ..schema import SCALE_MIN_ROWS, SCALE_QUANTILE

SITE = ["site"]


def add_solar(df: DataFrame, stations: DataFrame, order: str = "step",
              seconds: int | None = None) -> DataFrame:
    """Elevation, azimuth, zenith, their sine and cosine, daylight and clear-sky GHI."""
    time = clock.instant(F.col(order)) if seconds is None else clock.instant(F.col(order), seconds)
    place = stations.select("site", "latitude", "longitude", "altitude_m")
    located = df.join(place, "site", "left").withColumn("_t", time)
    located = located.withColumn("_angle", solar.year_angle(F.col("_t")))
    located = located.withColumns({
        "_tilt": solar.declination(F.col("_angle")),
        "_turn": F.radians(solar.hour_angle(F.col("_t"), F.col("_angle"), F.col("longitude")))})
    at = (F.col("latitude"), F.col("_tilt"), F.col("_turn"))
    located = located.withColumns({"_true": solar.true_elevation(*at),
                                   "_azimuth": solar.azimuth(*at)})
    located = located.withColumn("_apparent", solar.apparent_elevation(F.col("_true")))
    elevation = F.col("_apparent")
    return once(located, {
        "solar_elevation": elevation, "solar_azimuth": F.col("_azimuth"),
        "solar_zenith": 90.0 - F.col("_true"),
        "sin_solar_elevation": F.sin(F.radians(elevation)),
        "cos_solar_elevation": F.cos(F.radians(elevation)),
        "daylight": elevation > 0.0,
        "ghi_clear": solar.clear_sky(elevation, F.coalesce(F.col("altitude_m"), F.lit(0.0))),
    }).drop("_t", "_angle", "_tilt", "_turn", "_true", "_azimuth", "_apparent", "latitude",
            "longitude", "altitude_m")


def add_clearness(df: DataFrame, ghi: str = "ghi") -> DataFrame:
    return once(df, {"clear_sky_index_raw": solar.clearness(
        F.col(ghi), F.col("ghi_clear"), F.col("daylight"))})


def clear_sky_scale(df: DataFrame, in_train: Column, keys: Sequence[str] = SITE,
                    share: float = SCALE_QUANTILE, least: int = SCALE_MIN_ROWS) -> DataFrame:
    """Scale of the clearness index per site from training daylight, with diagnostics.

    ``under_sampled`` marks fewer than ``least`` usable rows; the scale is still theirs.
    ``is_default_scale`` marks a scale of 1.0 for want of rows or of a positive quantile.
    """
    kt = "clear_sky_index_raw"
    wanted = in_train & F.col("daylight") & F.col(kt).isNotNull()
    stats = order_statistics(df.where(wanted), keys, kt, {
        "_scale": at_share(share), "kt_p50": at_share(0.5), "kt_p90": at_share(0.9),
        "kt_p99": at_share(0.99)})
    used = F.when(wanted, F.col(kt))
    sites = df.groupBy(*keys).agg(
        F.max(used).alias("kt_max"),
        F.avg((used > 1.2).cast("double")).alias("fraction_above_1p2"))
    positive = F.coalesce(F.col("_scale") > 1e-6, F.lit(False))
    out = sites.join(stats, list(keys), "left")
    return out.select(
        *keys, F.when(positive, F.col("_scale")).otherwise(F.lit(1.0)).alias("scale"),
        F.coalesce("n", F.lit(0)).alias("n_usable"),
        (F.coalesce("n", F.lit(0)) < least).alias("under_sampled"),
        (~positive).alias("is_default_scale"),
        F.coalesce((F.col("n") >= least) & F.col("_scale").between(0.95, 1.05), F.lit(False))
        .alias("calibrated"),
        "kt_p50", "kt_p90", "kt_p99", "kt_max", "fraction_above_1p2")


def apply_scale(df: DataFrame, scales: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    return attached(df, scales.select(*keys, "scale"), keys).withColumn(
        "clear_sky_index", solar.scaled_clearness(F.col("clear_sky_index_raw"), F.col("scale"))
    ).drop("scale")


def daylight_summary(df: DataFrame, order: str = "step") -> DataFrame:
    """Share of daylight steps, steps per day, elevation range, mean first and last sun hour."""
    time = clock.instant(F.col(order))
    up = F.col("solar_elevation") > 0
    days = df.groupBy("site", F.to_date(time).alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("daylight").alias("_lit"),
        F.min("solar_elevation").alias("_min"), F.max("solar_elevation").alias("_max"),
        F.sum(F.when(F.col("daylight"), F.col("solar_elevation"))).alias("_sum"),
        F.min(F.when(up, F.hour(time))).alias("_first"),
        F.max(F.when(up, F.hour(time))).alias("_last"))
    return days.groupBy("site").agg(
        (F.sum("_lit") / F.sum("_n")).alias("daylight_fraction"),
        F.avg("_lit").alias("mean_daylight_steps_per_day"),
        F.min("_min").alias("elevation_min"), F.max("_max").alias("elevation_max"),
        (F.sum("_sum") / F.sum("_lit")).alias("mean_elevation_daylight"),
        F.avg("_first").alias("first_sun_hour"), F.avg("_last").alias("last_sun_hour"))
