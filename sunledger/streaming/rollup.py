"""Readings that arrive as files, rolled up to the working grid as they come.

The batch rollup and this one share the bin rule: right-closed bins labelled by their
end. A bin is emitted once the watermark has passed it, so its value never changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.clock import bin_end, instant
from ..schema import STEP_SECONDS


def stream_rollup(readings: DataFrame, time: str, columns: Sequence[str],
                  keys: Sequence[str] = ("site",), how: str = "mean",
                  lateness: str = "1 hour", seconds: int = STEP_SECONDS) -> DataFrame:
    """Append-mode rollup of a streaming frame with a watermark on the bin end."""
    if how not in ("mean", "sum"):
        raise ValueError(f"unsupported aggregation: {how!r}")
    aggregate = F.avg if how == "mean" else F.sum
    binned = readings.withColumn("_bin", instant(bin_end(F.col(time), seconds), seconds))
    return (binned.withWatermark("_bin", lateness).groupBy(*keys, "_bin")
            .agg(*[aggregate(c).alias(c) for c in columns])
            .withColumnRenamed("_bin", "Time"))
