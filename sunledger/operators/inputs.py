"""Input sets: which model inputs a run may see, and least squares of all sets in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import INPUT_FAMILIES, INPUT_SETS, MINIMAL_INPUTS


def select_inputs(columns: Sequence[str], spec: str) -> list[str]:
    """The columns an input set keeps, in their order; an unknown set is an error.

    ``clear_sky_index``, which is no default input, counts as weather where a weather family is
    ablated, and survives the additive sets like any column of no family.
    """
    if spec == "minimal":
        known = {c for family in INPUT_FAMILIES.values() for c in family} | {"clear_sky_index"}
        return [c for c in columns if c in MINIMAL_INPUTS or c not in known]
    if spec not in INPUT_SETS:
        raise KeyError(f"unknown input set {spec!r}, known: {sorted([*INPUT_SETS, 'minimal'])}")
    gone = {c for family in INPUT_SETS[spec] for c in INPUT_FAMILIES[family]}
    if spec == "no_weather":
        gone.add("clear_sky_index")
    return [c for c in columns if c not in gone]


def cross_products(rows: DataFrame, inputs: Sequence[str], target: str,
                   keys: Sequence[str]) -> DataFrame:
    """Keys, ``n_fit`` and ``products``: the sums of all products of (1, inputs, target).

    Each batch of a task adds up its own products; Spark adds those by key and place. What is
    gathered per key is the square of the number of columns, whatever the number of rows.
    """
    columns = [*inputs, target]
    size = len(columns) + 1
    complete = rows.select(*keys, *[F.col(c).cast("double") for c in columns]).na.drop(
        subset=columns)
    schema = T.StructType([*[complete.schema[c] for c in keys],
                           T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            found = []
            for key, own in batch.groupby(list(keys), dropna=False, sort=False):
                x = np.column_stack([np.ones(len(own)), own[columns].to_numpy()])
                found.append((*key, (x.T @ x).ravel()))
            yield pd.DataFrame(found, columns=[*keys, "sums"])

    parts = complete.mapInPandas(add, schema).select(*keys, F.posexplode("sums").alias("at", "x"))
    listed = parts.groupBy(*keys, "at").agg(F.sum("x").alias("x")).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"])
        .alias("products"))
    return listed.select(*keys, F.col("products")[0].cast("long").alias("n_fit"), "products") \
        .where(F.size("products") == size * size)


def fit_input_sets(rows: DataFrame, inputs: Sequence[str], target: str, keys: Sequence[str],
                   specs: Sequence[str]) -> DataFrame:
    """``coefficients`` (intercept first, 0 for inputs a set leaves out) per key and set.

    The normal equations of every set are part of those of all inputs, so the rows are read
    once, however many sets there are.
    """
    sums = cross_products(rows, inputs, target, keys)
    size = len(inputs) + 2
    places = {s: [0, *[1 + list(inputs).index(c) for c in select_inputs(inputs, s)]] for s in specs}
    schema = T.StructType([*[sums.schema[c] for c in (*keys, "n_fit")],
                           T.StructField("feature_spec", T.StringType()),
                           T.StructField("n_inputs", T.LongType()),
                           T.StructField("coefficients", T.ArrayType(T.DoubleType()))])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.to_dict("records"):
                gram = np.asarray(row.pop("products")).reshape(size, size)
                scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
                for spec, at in places.items():
                    own = scale[at]
                    x = np.linalg.lstsq(gram[np.ix_(at, at)] / np.outer(own, own),
                                        gram[at, -1] / own, rcond=1e-12)[0] / own
                    whole = np.zeros(size - 1)
                    whole[at] = x
                    found.append({**row, "feature_spec": spec, "n_inputs": len(at) - 1,
                                  "coefficients": whole})
            yield pd.DataFrame(found, columns=schema.names)

    return sums.mapInPandas(solve, schema)


def predicted_by(inputs: Sequence[str], coefficients: str = "coefficients") -> Column:
    """Prediction of a fitted set; null where an input that it uses is null."""
    values = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in inputs])
    used = F.zip_with(values, coefficients, lambda v, w: F.when(w == 0, 0.0).otherwise(v * w))
    return F.aggregate(used, F.lit(0.0), lambda a, b: a + b)


def complete_rows(rows: DataFrame, keys: Sequence[str],
                  specs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows per key and set that have all inputs of the set."""
    pairs = F.array(*[F.struct(
        F.lit(s).alias("feature_spec"), F.lit(len(own)).cast("long").alias("n_inputs"),
        (~F.exists(F.array(*[F.col(c).isNull() for c in own]), lambda b: b)).alias("_whole"))
        for s, own in specs.items()])
    return rows.select(*keys, F.inline(pairs)).groupBy(*keys, "feature_spec", "n_inputs").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("_whole").alias("n_complete"))
