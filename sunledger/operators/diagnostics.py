"""Diagnostic aggregates behind the usual figures, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock
from ..plans.ranks import quantiles
from ..plans.summaries import sized

RUN = ["site", "model", "horizon"]


def daily_mae(predictions: DataFrame, n_days: int = 14, keys: Sequence[str] = RUN,
              order: str = "step") -> DataFrame:
    """Daylight MAE per day over the first ``n_days`` of every run."""
    start = predictions.groupBy(*keys).agg(F.min(order).alias("_start"))
    date = F.to_date(clock.instant(F.col(order)))
    first = F.to_date(clock.instant(F.col("_start")))
    rows = predictions.join(sized(start), list(keys)).where("daylight")
    rows = rows.withColumn("day_index", F.date_diff(date, first)).where(
        F.col("day_index") < n_days).drop("_start")
    return rows.groupBy(*keys, "day_index").agg(
        F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"),
        F.count(F.lit(1)).alias("n"))


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the top edge belongs to the last bin."""
    at = F.floor((value - low) / (high - low) * bins)
    return F.when(high > low, F.least(at, F.lit(bins - 1))).otherwise(F.lit(0).cast("long"))


def with_bins(df: DataFrame, value: str, bins: int, keys: Sequence[str]) -> DataFrame:
    edges = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"),
                                  F.count(value).alias("_n"))
    return df.where(F.col(value).isNotNull()).join(sized(edges), list(keys)).withColumn(
        "bin", equal_width_bin(F.col(value), F.col("_low"), F.col("_high"), bins))


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str]) -> DataFrame:
    """Counts and density of equal-width bins between the extremes."""
    width = (F.max("_high") - F.max("_low")) / bins
    return with_bins(df, value, bins, keys).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("_low") + F.col("bin") * width).alias("bin_low"),
        F.when(width > 0, F.count(F.lit(1)) / (F.max("_n") * width)).alias("density"))


def residual_histogram(predictions: DataFrame, bins: int = 60, keys: Sequence[str] = RUN,
                       scale: str = "rated_w") -> DataFrame:
    """Histogram of daylight residuals as a share of capacity."""
    rows = predictions.where("daylight").withColumn(
        "residual", (F.col("predicted") - F.col("actual")) / F.col(scale))
    return histogram(rows, "residual", bins, keys)


def residual_bands(predictions: DataFrame, by: str = "predicted", bins: int = 15,
                   keys: Sequence[str] = RUN) -> DataFrame:
    """Median and quartiles of the residual in equal-width bins of another column."""
    rows = predictions.where("daylight").withColumn(
        "residual", F.col("predicted") - F.col("actual"))
    binned = with_bins(rows, by, bins, keys)
    return quantiles(binned, [*keys, "bin"], "residual", {"q25": 0.25, "median": 0.5, "q75": 0.75})


def monthly_coverage(intervals: DataFrame, keys: Sequence[str] = (*RUN, "alpha"),
                     order: str = "step") -> DataFrame:
    month = F.date_format(clock.instant(F.col(order)), "yyyy-MM")
    return intervals.groupBy(*keys, month.alias("month")).agg(
        F.avg(F.col("inside").cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def daily_daylight_share(df: DataFrame, order: str = "step") -> DataFrame:
    date = F.date_format(clock.instant(F.col(order)), "yyyy-MM-dd")
    return df.groupBy("site", date.alias("date")).agg(
        F.avg(F.col("daylight").cast("double")).alias("daylight_share"))


def generation_histogram(df: DataFrame, value: str = "pv_power_w", bins: int = 80,
                         keys: Sequence[str] = ("site",)) -> DataFrame:
    return histogram(df.where("daylight"), value, bins, keys)
