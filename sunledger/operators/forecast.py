"""Reference forecasts, linear and tree regressors, scoring, importances."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..plans.chunks import CHUNK_STEPS, over_halo
from ..schema import HORIZONS, SMART_MAX_RATIO, SMART_MIN_CLEAR
from .supervise import build_target

SITE = ["site"]
LABEL_COLUMNS = ["daylight", "regime", "season", "split", "ghi_clear"]


def smart_persistence(last: Column, clear_now: Column, clear_then: Column,
                      rated: Column) -> Column:
    """Last value scaled by the change of the clear-sky reference, within capacity."""
    ratio = F.when(clear_now > SMART_MIN_CLEAR, clear_then / clear_now).otherwise(F.lit(1.0))
    ratio = F.least(F.greatest(ratio, F.lit(0.0)), F.lit(SMART_MAX_RATIO))
    top = F.when(rated > 0, rated).otherwise(F.lit(float("inf")))
    forecast = F.least(F.greatest(last * ratio, F.lit(0.0)), top)
    known = last.isNotNull() & clear_then.isNotNull() & clear_now.isNotNull()
    return F.when(known, forecast).otherwise(F.lit(0.0))


def persistence_from_lag(df: DataFrame, value: str = "pv_power_w", lag: int = 0,
                         out: str = "persistence", keys: Sequence[str] = SITE,
                         order: str = "step") -> DataFrame:
    """The value ``lag`` steps before the origin; null at the head of a series."""
    if lag == 0:
        return df.withColumn(out, F.col(value))
    return over_halo(df, keys, order, lambda w: {out: F.lag(value, lag).over(w)}, before=lag)


def reference_forecasts(df: DataFrame, target: str = "pv_power_w",
                        horizons: Mapping[str, int] = HORIZONS, keys: Sequence[str] = SITE,
                        extra: Sequence[str] = (), order: str = "step",
                        chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Origin rows per horizon with the label, its flags and both reference forecasts.

    Needs ``ghi_clear``, ``rated_w`` and the label columns. References sit on the row of
    their origin, so no later alignment is needed. ``step`` becomes the label time.
    """
    labels = [c for c in LABEL_COLUMNS if c in df.columns]
    rows = build_target(df, target, horizons, keys, labels, order, chunk_steps)
    last = F.col(target)
    out = rows.select(
        *keys, "horizon", "target_lead_steps", F.col(order).alias("origin_step"),
        F.col("target_step").alias("step"), F.col("target").alias("actual"),
        *[F.col(f"label_{c}").alias(c) for c in labels if c != "ghi_clear"],
        "rated_w", last.alias("reference_persistence"),
        smart_persistence(last, F.col("ghi_clear"), F.col("label_ghi_clear"), F.col("rated_w"))
        .alias("reference_smart_persistence"),
        *extra)
    return out


def fan_out(rows: DataFrame, models: Mapping[str, Column]) -> DataFrame:
    """Long prediction table: one row per model."""
    pairs = F.array(*[F.struct(F.lit(name).alias("model"), e.alias("predicted"))
                      for name, e in models.items()])
    return rows.select("*", F.inline(pairs))


def simple_linear_fit(rows: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """Least squares on one input, all keys in one aggregation."""
    return rows.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_count(y, x).alias("n_fit"))


def grouped_linear_fit(rows: DataFrame, inputs: Sequence[str], target: str,
                       keys: Sequence[str]) -> DataFrame:
    """Least squares on several inputs per key from grouped sums of products.

    Spark sums the cross products of all keys in one pass; each key's small system is
    then solved where its sums are. Returns ``coefficients`` with the intercept first.
    """
    terms = [F.lit(1.0), *[F.col(c) for c in inputs]]
    k = len(terms)
    complete = rows.na.drop(subset=[*inputs, target])
    sums = complete.groupBy(*keys).agg(
        F.array(*[F.sum(terms[i] * terms[j]) for i in range(k) for j in range(i, k)]).alias("xx"),
        F.array(*[F.sum(t * F.col(target)) for t in terms]).alias("xy"),
        F.count(F.lit(1)).alias("n_fit"))
    upper = np.triu_indices(k)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for xx, xy in zip(batch["xx"], batch["xy"]):
                gram = np.zeros((k, k))
                gram[upper] = xx
                gram = gram + np.triu(gram, 1).T
                size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
                scaled = gram / np.outer(size, size)
                found.append(np.linalg.lstsq(scaled, np.asarray(xy) / size, rcond=1e-12)[0] / size)
            yield batch.drop(columns=["xx", "xy"]).assign(coefficients=found)

    schema = T.StructType([*[sums.schema[c] for c in keys], sums.schema["n_fit"],
                           T.StructField("coefficients", T.ArrayType(T.DoubleType()))])
    return sums.mapInPandas(solve, schema)


def linear_prediction(inputs: Sequence[str], coefficients: str = "coefficients") -> Column:
    out = F.col(coefficients)[0]
    for i, c in enumerate(inputs, start=1):
        out = out + F.col(coefficients)[i] * F.col(c)
    return out


# ---- fixed values: estimator settings of the study -------------------------
FOREST = dict(numTrees=200, featureSubsetStrategy="0.3", maxDepth=30, minInstancesPerNode=1)
BOOSTED = dict(maxIter=300, stepSize=0.05, maxDepth=3, minInstancesPerNode=20)
BOOSTED_SAMPLED = dict(maxIter=400, stepSize=0.05, maxDepth=6, subsamplingRate=0.9,
                       featureSubsetStrategy="0.6")


def regressor(name: str, seed: int = 42, **settings):
    """Spark ML estimator of a model family.

    ``boosted_sampled`` samples rows and columns but has no L2 penalty on its leaves.
    """
    common = dict(featuresCol="features", labelCol="target", predictionCol="predicted")
    if name == "linear_regression":
        return LinearRegression(**common, **{"regParam": 0.0, "standardization": True, **settings})
    if name == "random_forest":
        return RandomForestRegressor(**common, seed=seed, **{**FOREST, **settings})
    if name == "gradient_boosting":
        return GBTRegressor(**common, seed=seed, **{**BOOSTED, **settings})
    if name == "boosted_sampled":
        return GBTRegressor(**common, seed=seed, **{**BOOSTED_SAMPLED, **settings})
    raise KeyError(f"unknown model {name!r}")


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Vector of inputs; rows with a missing input are skipped. Column names may hold dots or @."""
    plain = {c: f"_x{i}" for i, c in enumerate(columns)}
    named = df.withColumns({n: F.col(f"`{c}`").cast("double") for c, n in plain.items()})
    vector = VectorAssembler(inputCols=list(plain.values()), outputCol=out, handleInvalid="skip")
    return vector.transform(named).drop(*plain.values())


def fit_predict(estimator, train: DataFrame, rows: DataFrame):
    """Fit on assembled training rows and score the others."""
    model = estimator.fit(train.where(F.col("target").isNotNull()))
    return model, model.transform(rows)


def tune(name: str, grid: Sequence[Mapping], train: DataFrame, val: DataFrame, seed: int = 42):
    """Fit every setting on the training block, keep the lowest validation MAE.

    Returns the fitted winner and one row of scores per setting. The validation split is
    the given one, never a random one.
    """
    best, table = None, []
    for settings in grid:
        model = regressor(name, seed, **settings).fit(train)
        mae = model.transform(val).agg(F.avg(F.abs(F.col("predicted") - F.col("target")))).first()[0]
        table.append((dict(settings), mae))
        if best is None or mae < best[1]:
            best = (model, mae, dict(settings))
    return best, table


def prediction_frame(scored: DataFrame, model: str) -> DataFrame:
    """Label-time rows with signed and absolute error, as written after scoring."""
    e = F.col("predicted") - F.col("actual")
    return scored.withColumns({"model": F.lit(model), "error": e, "abs_error": F.abs(e)})


def importance_rows(model, names: Sequence[str], spark) -> DataFrame:
    """(feature, step, value) rows of a fitted tree model over a flattened window."""
    values = model.featureImportances.toArray()
    if len(values) != len(names):
        raise ValueError(f"{len(values)} importances for {len(names)} columns")
    rows = []
    for name, value in zip(names, values):
        feature, _, back = name.partition("@t")
        rows.append((feature, int(back or 0), float(value)))
    return spark.createDataFrame(rows, "feature string, step int, value double")


def collapse_importance(per_step: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Importance per variable over all its steps, with its share of the total."""
    totals = per_step.groupBy(*keys, "feature").agg(F.sum("value").alias("importance"))
    whole = F.sum("importance").over(Window.partitionBy(*keys))  # one row per variable
    share = F.when(whole > 0, F.col("importance") / whole).otherwise(F.lit(0.0))
    return totals.withColumn("relative_importance", share)
