"""Scores of the prediction table, grouped by any keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import scores

RUN = ["site", "model", "horizon"]
REFERENCES = {"persistence": "reference_persistence",
              "smart_persistence": "reference_smart_persistence"}


def error_frame(predictions: DataFrame) -> DataFrame:
    e = F.col("predicted") - F.col("actual")
    return predictions.withColumns({"error": e, "abs_error": F.abs(e), "squared_error": e * e})


def compute_all(predictions: DataFrame, keys: Sequence[str] = RUN,
                rated: str | None = None) -> DataFrame:
    """Every point metric in one aggregation; map-side partials bound any hot key."""
    y, f = F.col("actual"), F.col("predicted")
    metrics = scores.metric_set(y, f, F.col(rated) if rated else None)
    return predictions.groupBy(*keys).agg(*[c.alias(n) for n, c in metrics.items()])


def in_scopes(predictions: DataFrame, daylight: str = "daylight") -> DataFrame:
    """Each row in the scopes it belongs to: all steps, and daylight."""
    scopes = F.when(F.col(daylight), F.array(F.lit("daylight"), F.lit("all_steps"))).otherwise(
        F.array(F.lit("all_steps")))
    return predictions.withColumn("scope", F.explode(scopes))


def score(predictions: DataFrame, keys: Sequence[str] = RUN, rated: str | None = "rated_w",
          references: dict[str, str] | None = None) -> DataFrame:
    """Daylight and all-step metrics with skill against every reference on the same rows."""
    y, f = F.col("actual"), F.col("predicted")
    metrics = scores.metric_set(y, f, F.col(rated) if rated else None)
    for name, column in (REFERENCES if references is None else references).items():
        metrics.update(scores.reference_set(y, f, F.col(column), name))
    complete = predictions.where(y.isNotNull() & f.isNotNull())
    return in_scopes(complete).groupBy(*keys, "scope").agg(
        *[c.alias(n) for n, c in metrics.items()])
