"""Exact ranks and order statistics over groups of any size.

A mergeable quantile sketch per group gives split points; every interval between two of them
is cut into a thousand equal parts. Sketches merge on the map side, so that no group is
gathered, and they only decide where buckets lie: what is counted and ranked inside a bucket
is exact, however far off a sketch may be. Split points follow the values, so values that crowd
together spread as well as values of many magnitudes.

Order statistics then count rows per interval on the map side, find the intervals that hold a
wanted rank, and shuffle the rows of those alone. Ranks of all values are taken inside every bucket.
Bucket totals give every bucket its starting rank: buckets are summed up to intervals, intervals
are ordered per group, buckets inside their interval. Groups are told apart by a struct of their
keys, which keeps null keys.

The rows are read once and stored, so that all passes see the same values.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .chunks import KEY, boxed, once, unboxed
from .summaries import sized

SPLIT_BITS, PART_BITS = 8, 10
SPLITS = 1 << SPLIT_BITS
BUCKET, REGION = "_bucket", "_region"
Position = Callable[[Column], Column]


def known(df: DataFrame, value: str) -> DataFrame:
    """Rows with a rank: a value that is not a number, or has no bound, counts as null."""
    return df.where(F.col(value).isNotNull()
                    & (F.abs(F.col(value).cast("double")) < F.lit(float("inf"))))


def split_points(rows: DataFrame, value: str) -> DataFrame:
    """Per group at most ``SPLITS`` + 1 different values in rising order, least and greatest
    among them. A group of few values has no more split points than values."""
    shares = F.expr(f"array({', '.join(f'{i / SPLITS}D' for i in range(SPLITS + 1))})")
    sketch = F.percentile_approx(F.col(value).cast("double"), shares, F.lit(4 * SPLITS))
    # equal values may differ in the sign of zero
    return rows.groupBy(KEY).agg(F.array_distinct(F.transform(sketch, lambda s: s + F.lit(0.0)))
                                 .alias("_splits"))


def value_bucket(value: Column, interval: Column, splits: Column) -> Column:
    """Never falls as the value grows; never null, so that no filter is inferred from joins."""
    low, high = F.get(splits, interval - 1), F.get(splits, interval)
    # halves, because the distance of two doubles may have no bound
    part = F.floor(F.try_divide(value / 2 - low / 2, high / 2 - low / 2) * (1 << PART_BITS))
    part = F.greatest(F.lit(0), F.least(F.lit((1 << PART_BITS) - 1), F.coalesce(part, F.lit(0))))
    return interval.cast("long") * (1 << PART_BITS) + part


def located(rows: DataFrame, splits: DataFrame, value: str) -> DataFrame:
    """Rows with their interval, the number of split points at or below the value (found by
    halving), and their bucket."""
    at = F.col(value).cast("double")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(SPLIT_BITS + 1))])
    interval = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(
        F.get(F.col("_splits"), n + step - 1) <= at, step).otherwise(0))
    joined = once(rows.join(splits, KEY), {REGION: interval})
    return joined.withColumn(BUCKET, F.coalesce(value_bucket(
        at, F.col(REGION), F.col("_splits")), F.lit(0))).drop("_splits")


def interval_offsets(rows: DataFrame, size: Column) -> DataFrame:
    """Rows before each interval and in the whole group. ``size`` sums up the rows of an interval."""
    per_key = Window.partitionBy(KEY)
    before = per_key.orderBy(REGION).rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(KEY, REGION).agg(size.alias("_all")).select(
        KEY, REGION, "_all", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"),
        F.sum("_all").over(per_key).alias("n"))


def bucket_offsets(counts: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows before each bucket, of the intervals given."""
    totals = counts.groupBy(KEY, REGION, BUCKET).agg(F.sum("ties").alias("_in"))
    inside = (Window.partitionBy(KEY, REGION).orderBy(BUCKET)
              .rowsBetween(Window.unboundedPreceding, -1))
    return totals.withColumn("_inside", F.coalesce(F.sum("_in").over(inside), F.lit(0))).join(
        intervals, [KEY, REGION]).withColumn("_before", F.col("_start") + F.col("_inside")).drop(
        REGION, "_in", "_inside", "_start", "_all")


def rank_in_group(counts: DataFrame, offsets: DataFrame, value: str) -> DataFrame:
    within = (Window.partitionBy(KEY, BUCKET).orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    return counts.join(offsets, [KEY, BUCKET]).withColumn(
        "first_rank",
        F.col("_before") + F.coalesce(F.sum("ties").over(within), F.lit(0)) + 1)


def ranked_values(df: DataFrame, keys: Sequence[str], value: str,
                  extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per distinct value: ``ties``, 1-based ``first_rank`` and group size ``n``.

    ``extra`` names further aggregates over the rows that share a value.
    """
    counts = materialise(boxed(known(df, value), keys).groupBy(KEY, value).agg(
        F.count(F.lit(1)).alias("ties"), *[e.alias(n) for n, e in (extra or {}).items()]), "ranks")
    counts = located(counts, sized(split_points(counts, value)), value)
    offsets = bucket_offsets(counts, interval_offsets(counts, F.sum("ties")))
    out = rank_in_group(counts, offsets, value)
    return unboxed(out.select(KEY, value, "ties", "first_rank", "n", *(extra or {})), keys, keys)


def order_statistics(df: DataFrame, keys: Sequence[str], value: str,
                     positions: Mapping[str, Position]) -> DataFrame:
    """Values at (possibly fractional) 0-based positions, linear between neighbours.

    ``positions`` maps an output name to a function of the group size. Only intervals
    that hold a wanted rank are shuffled and ranked.
    """
    rows = materialise(boxed(known(df, value), keys).select(KEY, value), "ranks")
    rows = located(rows, sized(split_points(rows, value)), value)
    intervals = interval_offsets(rows, F.count(F.lit(1)))
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), (edge(at(F.col("n"))) + 1).alias("rank"),
                 F.lit(side).alias("side"))
        for name, at in positions.items() for side, edge in (("lo", F.floor), ("hi", F.ceil))])
    held = sized(intervals.withColumn("_wanted", F.filter(wanted, lambda t: (
        t["rank"] > F.col("_start")) & (t["rank"] <= F.col("_start") + F.col("_all"))))
        .where(F.size("_wanted") > 0))
    counts = (rows.join(held.select(KEY, REGION), [KEY, REGION])
              .groupBy(KEY, REGION, BUCKET, value).agg(F.count(F.lit(1)).alias("ties")))
    hits = (rank_in_group(counts, bucket_offsets(counts, held), value)
            .withColumn("_t", F.explode("_wanted"))
            .where((F.col("_t.rank") >= F.col("first_rank"))
                   & (F.col("_t.rank") < F.col("first_rank") + F.col("ties"))))

    def at_edge(name: str, side: str) -> Column:
        return F.max(F.when((F.col("_t.name") == name) & (F.col("_t.side") == side),
                            F.col(value))).alias(f"_{side}_{name}")

    edges = hits.groupBy(KEY).agg(
        F.max("n").alias("n"),
        *[at_edge(name, side) for name in positions for side in ("lo", "hi")])

    def blend(name: str, at: Position) -> Column:
        share = at(F.col("n")) - F.floor(at(F.col("n")))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (low + share * (high - low)).alias(name)

    out = edges.select(KEY, "n", *[blend(name, at) for name, at in positions.items()])
    return unboxed(out, keys, keys)


def at_share(p: float) -> Position:
    """Position of the linear-interpolation quantile ``p``."""
    return lambda n: F.lit(float(p)) * (n - 1)


def quantiles(df: DataFrame, keys: Sequence[str], value: str,
              shares: Mapping[str, float]) -> DataFrame:
    return order_statistics(df, keys, value, {k: at_share(p) for k, p in shares.items()})
