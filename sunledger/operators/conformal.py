"""Split-conformal intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ranks import order_statistics
from ..plans.summaries import sized
from ..schema import CALIBRATION_DAYS, MIN_CONFORMAL_ROWS, STEP_SECONDS

RUN = ["site", "model", "horizon"]


def conformal_position(alpha: float):
    """0-based position of the finite-sample quantile, clipped to the largest residual."""
    def at(n: Column) -> Column:
        rank = F.ceil((n + 1) * F.lit(1.0 - alpha))
        return F.least(rank, n).cast("double") - 1.0
    return at


def conformal_quantiles(df: DataFrame, residual: str, alphas: Sequence[float],
                        keys: Sequence[str] = RUN) -> DataFrame:
    """Half width per key and alpha from absolute residuals."""
    names = {f"q{i}": a for i, a in enumerate(alphas)}
    wide = order_statistics(df, keys, residual,
                            {n: conformal_position(a) for n, a in names.items()})
    rows = F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(n).alias("interval_half_width_w"))
                     for n, a in names.items()])
    return wide.select(*keys, F.inline(rows))


def split_calibration(predictions: DataFrame, days: float = CALIBRATION_DAYS,
                      keys: Sequence[str] = RUN, order: str = "step") -> DataFrame:
    """Mark the first ``days`` of every run as calibration."""
    start = predictions.groupBy(*keys).agg(F.min(order).alias("_start"))
    reach = int(round(days * 86400 / STEP_SECONDS))
    return predictions.join(sized(start), list(keys)).withColumn(
        "is_calibration", F.col(order) < F.col("_start") + reach).drop("_start")


def _run_sizes(split: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    sizes = split.groupBy(*keys).agg(
        F.count_if("is_calibration").alias("n_calibration"),
        F.count_if(F.col("is_calibration") & F.col("daylight")).alias("n_calibration_daylight"),
        F.count_if(~F.col("is_calibration")).alias("_n_evaluation"))
    return sizes.withColumn("under_sampled", F.least("n_calibration", "_n_evaluation") < least
                            ).drop("_n_evaluation")


def interval_frame(predictions: DataFrame, alphas: Sequence[float] = (0.1,),
                   days: float = CALIBRATION_DAYS, keys: Sequence[str] = RUN,
                   order: str = "step", least: int = MIN_CONFORMAL_ROWS) -> DataFrame:
    """Bounds of every evaluation step; ``under_sampled`` marks runs with fewer than ``least``
    rows on a side."""
    split = split_calibration(predictions, days, keys, order)
    residuals = split.where("is_calibration").withColumn(
        "_residual", F.abs(F.col("predicted") - F.col("actual")))
    widths = conformal_quantiles(residuals, "_residual", alphas, keys)
    width = F.col("interval_half_width_w")
    bounds = _run_sizes(split, keys, least).join(widths, list(keys), "left")
    out = split.where("not is_calibration").join(sized(bounds), list(keys))
    return out.withColumns({"lower": F.col("predicted") - width,
                            "upper": F.col("predicted") + width}).withColumn(
        "inside", F.col("actual").between(F.col("lower"), F.col("upper")))


def coverage_table(predictions: DataFrame, alphas: Sequence[float] = (0.1, 0.2),
                   days: float = CALIBRATION_DAYS, keys: Sequence[str] = RUN,
                   order: str = "step", least: int = MIN_CONFORMAL_ROWS) -> DataFrame:
    """Empirical coverage per alpha, over all evaluation steps and over daylight."""
    rows = interval_frame(predictions, alphas, days, keys, order, least)
    scopes = F.when(F.col("daylight"), F.array(F.lit("evaluation_all_steps"),
                                               F.lit("evaluation_daylight"))).otherwise(
        F.array(F.lit("evaluation_all_steps")))
    nominal = 1.0 - F.col("alpha")
    return rows.withColumn("scope", F.explode(scopes)).groupBy(*keys, "alpha", "scope").agg(
        F.max("interval_half_width_w").alias("interval_half_width_w"),
        F.avg(F.col("inside").cast("double")).alias("empirical_coverage"),
        F.count(F.lit(1)).alias("n"), F.max("n_calibration").alias("n_calibration"),
        F.max("n_calibration_daylight").alias("n_calibration_daylight"),
        F.max("under_sampled").alias("under_sampled"),
    ).withColumns({"nominal_coverage": nominal,
                   "coverage_error": F.col("empirical_coverage") - nominal})
