"""Missing-value profiles and bounded, split-aware imputation on the regular grid."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.chunks import carry
from ..plans.ranks import quantiles
from ..plans.summaries import sized
from ..schema import MAX_GAP_TARGET, MAX_GAP_WEATHER

SITE = ["site"]
Stage = Callable[[DataFrame], DataFrame]


def as_is(df: DataFrame) -> DataFrame:
    return df


def gap_runs(df: DataFrame, value: str, keys: Sequence[str] = SITE,
             order: str = "step") -> DataFrame:
    """One row per run of missing values. Rows of a run share the last present position."""
    present = F.when(F.col(value).isNotNull(), F.col(order))
    marked = carry(df.select(*keys, order, value), keys, order, {"_anchor": present})
    return (marked.where(F.col(value).isNull()).groupBy(*keys, "_anchor")
            .agg(F.count(F.lit(1)).alias("length"), F.min(order).alias("first_step")))


def missingness(df: DataFrame, value: str, keys: Sequence[str] = SITE,
                order: str = "step") -> DataFrame:
    """Missing count and share, number, longest and mean length of the gaps."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.count_if(F.col(value).isNull()).alias("n_missing"))
    runs = gap_runs(df, value, keys, order).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_gaps"), F.max("length").alias("longest_gap"),
        F.avg("length").alias("mean_gap_length"),
        F.count_distinct("length").alias("n_lengths"))
    return totals.join(runs, list(keys), "left").na.fill(
        {"n_gaps": 0, "longest_gap": 0, "mean_gap_length": 0.0, "n_lengths": 0}).withColumn(
        "missing_fraction", F.col("n_missing") / F.col("n_rows"))


def gap_histogram(df: DataFrame, value: str, keys: Sequence[str] = SITE,
                  order: str = "step") -> DataFrame:
    """Gap lengths and how often each occurs, for every series."""
    return gap_runs(df, value, keys, order).groupBy(*keys, "length").agg(
        F.count(F.lit(1)).alias("n_gaps"))


def gap_length_map(histogram: DataFrame, keys: Sequence[str] = SITE,
                   max_gaps: int | None = None) -> DataFrame:
    """Histogram as a map per series, from one aggregate.

    The map has one entry per different length. Gaps of k different lengths cover at least
    k * k / 2 steps, so a series of n steps has at most sqrt(2 n) entries.
    Only where ``max_gaps`` is given do series with more gaps get a null map.
    """
    maps = histogram.groupBy(*keys).agg(
        F.sum("n_gaps").alias("n_gaps"), F.count(F.lit(1)).alias("n_lengths"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("length", "n_gaps"))))
        .alias("histogram"))
    if max_gaps is None:
        return maps
    return maps.withColumn("histogram", F.when(F.col("n_gaps") <= max_gaps, F.col("histogram")))


def _anchor(column: str, order: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.struct(F.col(order).alias("at"),
                                                      F.col(column).alias("v")))


def with_anchors(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str,
                 later: bool = True) -> DataFrame:
    """Nearest present reading on both sides of every row, for all columns in one pass."""
    return carry(df, keys, order, {f"_p_{c}": _anchor(c, order) for c in columns},
                 {f"_n_{c}": _anchor(c, order) for c in columns} if later else {})


def drop_anchors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[f"{side}{c}" for c in columns for side in ("_p_", "_n_")])


def _line(column: str, steps: Column) -> Column:
    """Value on the line between both anchors, ``steps`` after the earlier one."""
    p, n = F.col(f"_p_{column}"), F.col(f"_n_{column}")
    return p["v"] + (n["v"] - p["v"]) * steps / (n["at"] - p["at"])


def bounded_line(column: str, order: str, limit: int, both: Column) -> Column:
    """The reading, or the line inside a gap within ``limit`` steps of an anchor."""
    since = F.col(order) - F.col(f"_p_{column}.at")
    until = F.col(f"_n_{column}.at") - F.col(order)
    near = (since <= limit) | (both & (until <= limit))
    return F.coalesce(F.col(column), F.when(since.isNotNull() & until.isNotNull() & near,
                                            _line(column, since)))


def bounded_hold(column: str, order: str, limit: int) -> Column:
    """The reading, or the earlier anchor for at most ``limit`` steps."""
    since = F.col(order) - F.col(f"_p_{column}.at")
    return F.coalesce(F.col(column), F.when(since <= limit, F.col(f"_p_{column}.v")))


def line_then_hold(column: str, order: str, limit: int, both: Column) -> Column:
    """The bounded line, then its last value repeated for ``limit`` more steps.

    In a gap with both anchors the forward line ends ``limit`` steps in, so the steps
    after it repeat the line's value there; a gap without a later anchor has no line
    and repeats the earlier reading.
    """
    since = F.col(order) - F.col(f"_p_{column}.at")
    ends = F.col(f"_n_{column}").isNotNull()
    held = (F.when(ends & (since <= 2 * limit), _line(column, F.lit(limit)))
            .when(~ends & (since <= limit), F.col(f"_p_{column}.v")))
    return F.coalesce(bounded_line(column, order, limit, both), held)


def interpolate(df: DataFrame, value: str, out: str, limit: int = MAX_GAP_TARGET,
                both: bool | Column = False, keys: Sequence[str] = SITE,
                order: str = "step", causal: bool = False) -> DataFrame:
    """Linear interpolation of interior gaps, at most ``limit`` steps from an anchor.

    Steps within ``limit`` of the earlier anchor are filled, with ``both`` also those
    within ``limit`` of the later one. ``causal`` repeats the earlier anchor instead, so
    that no fill uses a later reading.
    """
    known = with_anchors(df, [value], keys, order, later=not causal)
    side = both if isinstance(both, Column) else F.lit(both)
    fill = (bounded_hold(value, order, limit) if causal
            else bounded_line(value, order, limit, side))
    return drop_anchors(known.withColumn(out, fill), [value])


def fill_medians(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Replace what is still missing by the median of the known values per key."""
    long = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("_variable"), F.col(c).cast("double").alias("_value"))
        for c in columns])))
    medians = quantiles(long, [*keys, "_variable"], "_value", {"_median": 0.5})
    wide = medians.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_variable") == c, F.col("_median"))).alias(f"_m_{c}")
        for c in columns])
    return (df.join(sized(wide), list(keys), "left")
            .withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns})
            .drop(*[f"_m_{c}" for c in columns]))


def fill_weather(df: DataFrame, columns: Sequence[str], limit: int = MAX_GAP_WEATHER,
                 both: bool | Column = True, keys: Sequence[str] = SITE,
                 order: str = "step", stage: Stage = as_is) -> DataFrame:
    """Interpolate, then hold the last filled value, then the median of what is known.

    The filled rows are read by the medians and by the result; ``stage`` may write them.
    """
    side = both if isinstance(both, Column) else F.lit(both)
    known = with_anchors(df, columns, keys, order)
    filled = known.withColumns({c: line_then_hold(c, order, limit, side) for c in columns})
    return fill_medians(stage(drop_anchors(filled, columns)), columns, keys)


def impute(df: DataFrame, target: str, weather: Sequence[str], in_train: Column,
           target_limit: int = MAX_GAP_TARGET, weather_limit: int = MAX_GAP_WEATHER,
           keys: Sequence[str] = SITE, order: str = "step", causal: bool = False,
           stage: Stage = as_is) -> DataFrame:
    """Fill the training block from both sides and the later block forward only.

    The blocks never see each other's rows. ``causal`` repeats the last target in the
    later block instead of drawing a line to a later reading. ``imputed`` marks a filled
    target; targets that stay unknown are kept as nulls so that the grid stays regular,
    and are dropped once the features exist. ``stage`` may write the filled rows before
    the medians and the result read them.
    """
    block, columns = [*keys, "_train"], [target, *weather]
    train = F.col("_train")
    known = with_anchors(df.withColumn("_train", in_train), columns, block, order)
    line = bounded_line(target, order, target_limit, train)
    if causal:
        line = F.when(train, line).otherwise(bounded_hold(target, order, target_limit))
    filled = drop_anchors(known.withColumns({
        "imputed": F.col(target).isNull() & line.isNotNull(), target: line,
        **{c: line_then_hold(c, order, weather_limit, train) for c in weather}}), columns)
    if weather:
        filled = fill_medians(stage(filled), weather, block)
    return filled.drop("_train")


def missingness_table(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SITE,
                      order: str = "step") -> DataFrame:
    """Profile of several columns at once, one row per series and variable."""
    pairs: Mapping[str, Column] = {c: F.col(c) for c in columns}
    long = df.select(*keys, order, F.inline(F.array(*[
        F.struct(F.lit(n).alias("variable"), e.cast("double").alias("value"))
        for n, e in pairs.items()])))
    return missingness(long, "value", [*keys, "variable"], order)
