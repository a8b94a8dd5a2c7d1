"""Weather regimes from clearness and short-term irradiance variability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from ..plans.chunks import CHUNK_STEPS, over_halo
from ..schema import (CLEAR_KT, NIGHT_ELEVATION_MAX, PARTLY_KT, VARIABILITY_LIMIT,
                      VARIABILITY_MIN_GHI, VARIABILITY_WINDOW)

SITE = ["site"]


def variability(ghi: str, elevation: str, window: int = VARIABILITY_WINDOW,
                min_ghi: float = VARIABILITY_MIN_GHI):
    """Trailing coefficient of variation of daylight irradiance."""
    least = max(4, window // 4)

    def build(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(-(window - 1), 0)
        usable = F.when((F.col(ghi) > min_ghi) & (F.col(elevation) > 0), F.col(ghi))
        mean = F.avg(usable).over(frame)
        enough = (F.count(usable).over(frame) >= least) & (mean > min_ghi)
        return {"sigma_cv": F.when(enough, F.stddev_pop(usable).over(frame) / mean)}
    return build


def regime_label(kt: Column, sigma_cv: Column, elevation: Column) -> Column:
    """First rule that holds; unknown clearness or variability falls through to Cloudy."""
    return (F.when(elevation <= NIGHT_ELEVATION_MAX, "Night")
            .when(sigma_cv > VARIABILITY_LIMIT, "High-variability")
            .when(kt >= CLEAR_KT, "Clear").when(kt >= PARTLY_KT, "Partly cloudy")
            .otherwise("Cloudy"))


def attach_regimes(df: DataFrame, kt: str = "clear_sky_index", ghi: str = "ghi",
                   elevation: str = "solar_elevation", keys: Sequence[str] = SITE,
                   order: str = "step", chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    out = over_halo(df, keys, order, variability(ghi, elevation),
                    before=VARIABILITY_WINDOW - 1, chunk_steps=chunk_steps)
    return out.withColumn("regime", regime_label(F.col(kt), F.col("sigma_cv"), F.col(elevation)))


def regime_distribution(df: DataFrame, daylight_only: bool = True,
                        keys: Sequence[str] = SITE) -> DataFrame:
    rows = df.where("regime <> 'Night'") if daylight_only else df
    counts = rows.groupBy(*keys, "regime").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"))
    return counts.join(totals, list(keys)).withColumn("share", F.col("n") / F.col("n_total"))
