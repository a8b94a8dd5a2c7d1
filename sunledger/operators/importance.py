"""Perturbation importance: how much the error grows when one input is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.draws import draw, scattered
from ..plans.chunks import KEY, boxed, once, unboxed, with_position
from ..plans.summaries import attached
from ..session import materialise

Scorer = Callable[[DataFrame], DataFrame]
CONDITION_SIZE = 400


def shuffled_pairs(rows: DataFrame, row_id: str, groups: Mapping[str, Sequence[str]],
                   repeats: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Every row once per (feature, repeat) with that feature's columns from another row.

    Rows of a key are numbered once, in the order of their ids. A keyed permutation of the numbers
    tells each row to which one it gives its values, so nothing is sorted; what travels per
    feature and repeat is the feature's own columns. All columns of a feature move together.
    The join is by key and number, so a key may hold any share of the rows. It is by shuffle: the planner
    sizes what is given by the file of the numbered rows, not by the features and repeats made of it,
    and would send all of it through the driver as a broadcast.
    """
    columns = list(dict.fromkeys(c for cs in groups.values() for c in cs))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    numbered = attached(with_position(rows, keys, row_id, "_pos"), sizes, keys)
    numbered = materialise(boxed(numbered, keys), "numbered")
    places = {f: [columns.index(c) for c in cs] for f, cs in groups.items()}
    kind = numbered.schema[KEY].dataType.simpleString()

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("_pos").to_numpy() - 1
            size = batch.column("_size").to_numpy()
            values = [batch.column(f"_v{i}") for i in range(len(columns))]
            for index, (feature, own) in enumerate(places.items(), 1):
                flat = np.column_stack([values[i].to_numpy(zero_copy_only=False) for i in own]).ravel()
                moved = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, len(flat) + 1, len(own)), pa.int32()), pa.array(flat, from_pandas=True))
                for repeat in range(repeats):
                    which = np.full(len(number), index * repeats + repeat)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(KEY), pa.array(scattered(number, size, seed, which) + 1),
                         pa.array([feature] * len(number), pa.string()),
                         pa.array(np.full(len(number), repeat, np.int32)), moved],
                        names=[KEY, "_pos", "feature", "repeat", "_moved"])

    given = numbered.select(KEY, "_pos", "_size", *[F.col(c).cast("double").alias(f"_v{i}")
                                                    for i, c in enumerate(columns)])
    given = given.mapInArrow(give, f"{KEY} {kind}, _pos bigint, feature string, repeat int, _moved array<double>")
    paired = numbered.drop("_size").hint("merge").join(given.hint("merge"), [KEY, "_pos"])
    swapped = {}
    for c in columns:
        value = F.col(c)
        for f, cs in groups.items():
            if c in cs:
                value = F.when(F.col("feature") == f, F.col("_moved")[list(cs).index(c)].cast(
                    rows.schema[c].dataType)).otherwise(value)
        swapped[c] = value
    return unboxed(paired.withColumns(swapped).drop("_pos", "_moved"), keys, rows.columns)


def permutation_importance(rows: DataFrame, scorer: Scorer, row_id: str, actual: str,
                           groups: Mapping[str, Sequence[str]], repeats: int = 10,
                           keys: Sequence[str] = (), min_rows: int = CONDITION_SIZE,
                           seed: int = 42) -> DataFrame:
    """Mean and spread of the MAE increase per feature, and its share of the positive total.

    ``scorer`` adds ``predicted`` to a frame. ``keys`` condition the shuffle (regime,
    generation level); ``under_sampled`` marks conditions below ``min_rows``.
    """
    keys = [*keys, "_all"]
    gap = F.abs(F.col("predicted") - F.col(actual))
    scored = scorer(rows.withColumn("_all", F.lit(0))).withColumn("_base", gap)
    shuffled = shuffled_pairs(scored.drop("predicted"), row_id, groups, repeats, keys, seed)
    # every row is in every (feature, repeat) once, so the baseline needs no join
    per_repeat = scorer(shuffled).groupBy(*keys, "feature", "repeat").agg(
        F.avg(gap).alias("_mae"), F.avg("_base").alias("_base"),
        F.count(F.lit(1)).alias("n_windows"))
    delta = F.col("_mae") - F.col("_base")
    table = per_repeat.groupBy(*keys, "feature", "n_windows").agg(
        F.avg("_base").alias("baseline_mae"), F.avg(delta).alias("mean_mae_increase"),
        F.coalesce(F.stddev_samp(delta), F.lit(0.0)).alias("std_mae_increase"),
        F.count(F.lit(1)).alias("n_repeats"))
    gain = F.greatest(F.col("mean_mae_increase"), F.lit(0.0))
    total = F.sum(gain).over(Window.partitionBy(*keys))  # one row per feature
    return table.withColumns({
        "under_sampled": F.col("n_windows") < min_rows,
        "relative_increase": F.when(F.col("baseline_mae") > 0,
                                    F.col("mean_mae_increase") / F.col("baseline_mae")),
        "relative_importance": gain / F.when(total > 0, total).otherwise(F.lit(1.0)),
    }).drop("_all")


def dependence_sample(rows: DataFrame, row_id: str, features: Sequence[str], n: int = 2000,
                      seed: int = 42, actual: str = "actual",
                      predicted: str = "predicted") -> DataFrame:
    """A repeatable sample of ``n`` rows: inputs at the origin with the signed error."""
    error = F.col(predicted) - F.col(actual)
    ordered = once(rows, {"_order": draw(seed, F.col(row_id))})
    return (ordered.withColumns({"error": error, "abs_error": F.abs(error)})
            .orderBy("_order").limit(n)
            .select(row_id, actual, predicted, "error", "abs_error", *features))


# ---- fixed values: input families ------------------------------------------------
WEATHER_NAMES = ["temperature", "relative_humidity", "wind_speed", "clear_sky_index",
                 "rainfall", "visibility", "sea_level_pressure"]


def feature_family(name: Column) -> Column:
    def starts(*prefixes: str) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | name.startswith(p)
        return out

    return (F.when(starts("ghi") | name.isin(WEATHER_NAMES), "weather")
            .when(starts("pv_") | name.contains("rolling") | name.contains("lag_"), "pv_history")
            .when(starts("solar_", "sin_solar", "azimuth"), "solar_geometry")
            .when(starts("hour_", "doy_", "day_of", "month_"), "calendar")
            .otherwise("other"))


def group_importance(table: DataFrame, value: str = "relative_importance",
                     keys: Sequence[str] = ()) -> DataFrame:
    return table.withColumn("feature_group", feature_family(F.col("feature"))).groupBy(
        *keys, "feature_group").agg(F.sum(value).alias("total_importance"),
                                    F.count("feature").alias("n_variables"))


def importance_frame(per_model: Mapping[str, DataFrame]) -> DataFrame:
    """Long table of several models' importances."""
    out = None
    for model, table in per_model.items():
        part = table.withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def top_features(table: DataFrame, n: int = 10, by: str = "mean_mae_increase") -> DataFrame:
    return table.orderBy(F.col(by).desc(), "feature").limit(n)
