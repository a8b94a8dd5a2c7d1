"""Joining a small per-key summary back to the rows it came from."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise


def sized(summary: DataFrame) -> DataFrame:
    """Write a summary to the shared folder so that the planner knows its true size.

    An aggregate of a large table is planned as if it were large: both sides of the join
    would be shuffled by key, and a key with a third of the rows would fill one task.
    Read back from its file, a summary below ``spark.sql.autoBroadcastJoinThreshold`` is
    broadcast and the rows stay where they are; a larger one, which means many keys, is
    joined by shuffle, where adaptive execution splits a hot key.
    """
    return materialise(summary, "summary")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition under which null keys meet null keys."""
    return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))


def attached(rows: DataFrame, summary: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Rows with the columns of a per-key summary; rows whose key is null, or has no summary, stay."""
    small = sized(summary)
    return rows.join(small, same_keys(rows, small, keys), how).drop(*[small[k] for k in keys])
