"""Rollups to the working grid, joins between series, alignment of forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import bin_end
from ..plans.chunks import dense_grid
from ..schema import STEP_SECONDS


def rollup(df: DataFrame, time: str, columns: Sequence[str], how: str = "mean",
           keys: Sequence[str] = (), seconds: int = STEP_SECONDS,
           empty_bins: bool = False) -> DataFrame:
    """Right-closed, right-labelled rollup; ``step`` is the bin's end.

    With ``empty_bins`` every bin between the first and the last appears: means are
    null there and sums are zero. Partial aggregation runs before the shuffle, so a
    busy key or bin costs no more than a quiet one.
    """
    if how not in ("mean", "sum"):
        raise ValueError(f"unsupported aggregation: {how!r}")
    aggregate = F.avg if how == "mean" else F.sum
    binned = df.withColumn("step", bin_end(F.col(time), seconds)).groupBy(*keys, "step").agg(
        *[aggregate(c).alias(c) for c in columns])
    if how == "sum":
        binned = binned.na.fill(0.0, list(columns))
    if not empty_bins:
        return binned
    if keys:
        grid = dense_grid(binned, keys, "step")
        out = grid.join(binned, [*keys, "step"], "left")
    else:
        whole = binned.withColumn("_all", F.lit(0))
        out = dense_grid(whole, ["_all"], "step").drop("_all").join(binned, "step", "left")
    return out.na.fill(0.0, list(columns)) if how == "sum" else out


def attach_weather(power: DataFrame, weather: DataFrame,
                   on: Sequence[str] = ("step",)) -> DataFrame:
    """Left join of the weather table, which is unique on ``on``."""
    return power.join(weather.withColumn("has_weather", F.lit(True)), list(on), "left").withColumn(
        "has_weather", F.coalesce("has_weather", F.lit(False)))


def join_audit(joined: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Rows without weather, and stamps that the join multiplied (must be zero)."""
    per_stamp = joined.groupBy(*keys, "step").agg(
        F.count(F.lit(1)).alias("_n"), F.max("has_weather").alias("_hit"))
    return per_stamp.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.count_if(~F.col("_hit")).alias("n_without_weather"),
        F.count_if(F.col("_n") > 1).alias("n_multiplied"))


def aligned_models(predictions: DataFrame, n_models: int | Column,
                   keys: Sequence[str] = ("site", "horizon", "step")) -> DataFrame:
    """Keep the stamps every model has a forecast for.

    A count per stamp replaces a chain of joins between the models' tables.
    """
    complete = predictions.groupBy(*keys).agg(
        F.count_distinct("model").alias("_models")).where(F.col("_models") == n_models)
    return predictions.join(complete.drop("_models"), list(keys), "left_semi")


def paired_forecasts(left: DataFrame, right: DataFrame,
                     keys: Sequence[str] = ("site", "model", "horizon", "step")) -> DataFrame:
    """Pair two runs of the same model on the same stamps."""
    other = right.select(*keys, F.col("predicted").alias("predicted_other"))
    return left.join(other, list(keys))


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
