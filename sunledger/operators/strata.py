"""Error analysis by stratum: regime, season, time of day, generation level, ramps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from ..functions import bands, clock, scores
from ..functions.stats import skill
from ..plans.chunks import CHUNK_STEPS, over_halo
from ..plans.summaries import sized
from ..schema import MIN_STRATUM_SIZE, RAMP_FRACTION

RUN = ["site", "model", "horizon"]
STRATA = ["regime", "season", "time_of_day", "power_level", "ramping"]


def add_ramp_flag(df: DataFrame, keys: Sequence[str] = RUN, value: str = "actual",
                  fraction: float = RAMP_FRACTION, steps: int = 1, order: str = "step",
                  capacity: str | None = None, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Flag changes over ``steps`` above a share of the series' own peak (or a capacity)."""
    if capacity is None:
        peak = F.max(F.abs(value))
        peaks = df.groupBy(*keys).agg(F.when(peak > 0, peak).otherwise(F.lit(1.0)).alias("_peak"))
        df = df.join(sized(peaks), list(keys))
    limit = fraction * F.col(capacity or "_peak")

    def ramp(w: WindowSpec) -> dict[str, Column]:
        change = F.abs(F.col(value) - F.lag(value, steps).over(w))
        return {"ramping": F.coalesce(change > limit, F.lit(False))}

    return over_halo(df, keys, order, ramp, before=steps, chunk_steps=chunk_steps).drop("_peak")


def build_strata(predictions: DataFrame, rated: str = "rated_w", keys: Sequence[str] = RUN,
                 order: str = "step", chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Attach every stratum label; ``step`` is the time the forecast is about."""
    time = clock.instant(F.col(order))
    season = (F.initcap(F.trim("season")) if "season" in predictions.columns
              else F.lit(None).cast("string"))
    labelled = predictions.withColumns({
        "season": F.coalesce(season, clock.season(time)),
        "time_of_day": bands.time_of_day(time),
        "power_level": bands.power_level(F.col("actual"), F.col(rated))})
    return add_ramp_flag(labelled, keys, order=order, chunk_steps=chunk_steps)


def stratified_table(strata: DataFrame, types: Sequence[str] = STRATA,
                     keys: Sequence[str] = RUN, rated: str = "rated_w",
                     reference: str = "reference_persistence",
                     min_size: int = MIN_STRATUM_SIZE) -> DataFrame:
    """Daylight metrics of every stratum of every run in one aggregation.

    The reference is rescored on the rows of the stratum. Strata below ``min_size``
    rows carry a flag; their metrics are those of the rows they have.
    """
    y, f, ref = F.col("actual"), F.col("predicted"), F.col(reference)
    labels = F.array(*[F.struct(F.lit(t).alias("stratum_type"),
                                F.col(t).cast("string").alias("stratum")) for t in types])
    rows = strata.where("daylight").select(
        *keys, "actual", "predicted", reference, rated, F.inline(labels)
    ).where(F.col("stratum").isNotNull())
    rmse, ref_rmse = scores.rmse(y, f), F.when(F.count_if(ref.isNull()) == 0, scores.rmse(y, ref))
    metrics = {
        "mae": scores.mae(y, f), "rmse": rmse,
        "nrmse_capacity": scores.relative(rmse, F.max(rated)), "r2": scores.r2(y, f),
        "smape": scores.smape(y, f), "bias": scores.bias(y, f),
        "persistence_rmse": ref_rmse, "skill_vs_persistence_rmse": skill(ref_rmse, rmse)}
    return rows.groupBy(*keys, "stratum_type", "stratum").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) < min_size).alias("under_sampled"),
        *[c.alias(n) for n, c in metrics.items()])
