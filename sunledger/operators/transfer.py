"""Cross-site transfer: folds, pooled fits of all folds in one job, scores."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import scores
from ..functions.stats import skill
from ..plans.summaries import attached, sized
from ..schema import EPS
from ..session import materialise
from .inputs import cross_products

PROTOCOLS = ("within_site", "cross_site", "leave_one_site_out")
FOLD = ["protocol", "test_site"]


NAMED_SITES = 50  # a fold of more training sites is described, not listed


def panel_of(rows: DataFrame) -> DataFrame:
    """The sites of the data, one row each; rows without a site are one as well."""
    return rows.select("site").distinct()


def fold_table(rows: DataFrame, primary: str) -> DataFrame:
    """One row per fold with its training sites: every site on itself, the primary one on every
    other site, and all other sites on each. Folds are linear in the number of sites."""
    sites = sized(panel_of(rows))
    told = sites.agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("site")), 1, NAMED_SITES + 1)
                     .alias("names")).first()
    n = F.lit(told["n"]).cast("long")
    listed = F.array(*[F.lit(s) for s in told["names"]]).cast("array<string>")
    names = F.array_join(F.filter(listed, lambda s: ~s.eqNullSafe(F.col("site"))), ", ") \
        if told["n"] - 1 <= NAMED_SITES else \
        F.concat(F.lit("all sites but "), F.coalesce("site", F.lit("the unnamed one")))
    first = ~F.col("site").eqNullSafe(F.lit(primary))

    def fold(protocol: str, size: Column, members: Column, there: Column) -> Column:
        return F.struct(F.lit(protocol).alias("protocol"), size.alias("n_train_sites"),
                        members.alias("train_sites"), there.alias("_is"))

    one = F.lit(1).cast("long")
    folds = F.array(
        fold("within_site", one, F.col("site"), F.lit(True)),
        fold("cross_site", one, F.lit(primary), first & F.lit(not sites.where(F.col("site") == primary).isEmpty())),
        fold("leave_one_site_out", n - 1, names, n > 1))
    return sites.select(F.col("site").alias("test_site"), F.inline(folds)).where("_is") \
        .select(*FOLD, "n_train_sites", "train_sites")


def _added(kind: T.DataType, a: Column, b: Column, sign: int) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.zip_with(a, b, lambda x, y: x + sign * y)
    return a + sign * b


def fold_sums(sums: DataFrame, sites: DataFrame, primary: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sums of every fold's training rows from the sums of every site.

    ``sums`` has one row per site and key; all other columns are numbers, or arrays of numbers of one
    length, that add up. All sites but one are the total less that one, so each sum is read twice, not
    once per fold. Sites of the data without training rows are tested all the same.
    """
    values = [c for c in sums.columns if c not in ("site", *keys)]
    kinds = {c: sums.schema[c].dataType for c in values}
    own = materialise(sums, "site_sums")

    whole = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_sites"), *[
        F.sum(c).alias(c) for c in values if not isinstance(kinds[c], T.ArrayType)])
    for c in values:  # arrays add up place by place
        if isinstance(kinds[c], T.ArrayType):
            parts = own.select(*keys, F.posexplode(c).alias("_at", "_x")).groupBy(*keys, "_at").agg(
                F.sum("_x").alias("_x")).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(
                    F.struct("_at", "_x"))), lambda s: s["_x"]).alias(c))
            whole = attached(whole, parts, keys)
    tests = sized(panel_of(sites))
    # every site under every key (horizon, column) of the sums: linear in the sites
    every = attached(tests.crossJoin(F.broadcast(own.select(*keys).distinct())) if keys else tests,
                     own.withColumnsRenamed({c: f"_own_{c}" for c in values}), ["site", *keys])
    every = attached(every, whole, keys) if keys else every.crossJoin(F.broadcast(whole))
    lead = own.where(F.col("site") == primary).select(*keys, *[F.col(c).alias(f"_lead_{c}") for c in values])
    every = attached(every, lead, keys) if keys else every.join(F.broadcast(lead), F.lit(True), "left")
    has = F.col(f"_own_{values[0]}").isNotNull()

    def part(protocol: str, is_one: Column, of) -> Column:
        return F.struct(F.lit(protocol).alias("protocol"), *[of(c).alias(c) for c in values], is_one.alias("_is"))

    def rest(c: str) -> Column:
        return F.when(has, _added(kinds[c], F.col(c), F.col(f"_own_{c}"), -1)).otherwise(F.col(c))

    folds = F.array(
        part("within_site", has, lambda c: F.col(f"_own_{c}")),
        part("cross_site", ~F.col("site").eqNullSafe(F.lit(primary)) & F.col(f"_lead_{values[0]}").isNotNull(),
             lambda c: F.col(f"_lead_{c}")),
        part("leave_one_site_out", F.col("_sites") > has.cast("int"), rest))
    return every.select(F.col("site").alias("test_site"), *keys, F.inline(folds)).where("_is") \
        .select("protocol", "test_site", *keys, *values)


def pooled_scalers(train: DataFrame, sites: DataFrame, primary: str, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per fold from the training sites' training rows."""
    sums = train.groupBy("site").agg(
        *[e.alias(f"_{s}_{i}") for i, c in enumerate(columns) for s, e in (
            ("n", F.count(c)), ("x", F.sum(F.col(c).cast("double"))), ("q", F.sum(F.col(c).cast("double") * F.col(c))))])
    long = sums.select("site", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_n_{i}").alias("n_rows"), F.coalesce(f"_x_{i}", F.lit(0.0)).alias("x"),
                 F.coalesce(f"_q_{i}", F.lit(0.0)).alias("q")) for i, c in enumerate(columns)])))
    n, mean = F.col("n_rows"), F.col("x") / F.col("n_rows")
    return fold_sums(long, sites, primary, ["column"]).where("n_rows > 0").select(
        *FOLD, "column", "n_rows", mean.alias("mean"),
        F.sqrt(F.greatest(F.col("q") / n - mean * mean, F.lit(0.0))).alias("std"))


def pooled_fits(train: DataFrame, sites: DataFrame, primary: str, inputs: Sequence[str], target: str,
                keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Least squares of every fold on inputs scaled by the fold's own training rows.

    One matrix of products per site; those of a fold are sums and differences of these. Returns ``means``
    and ``stds`` of the inputs, ``coefficients`` of the scaled inputs, the ``intercept`` and the ``rank``. An
    input that does not vary in the fold gets 0; with a rank below the number of inputs, other weights
    would fit as well. Rows keep to their site, so no label or window crosses a seam.
    """
    per_site = cross_products(train, inputs, target, ["site", *keys])
    pooled = fold_sums(per_site, sites, primary, keys).where("n_fit > 0")
    size, names = len(inputs) + 2, [*FOLD, *keys]
    arrays = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[pooled.schema[c] for c in (*names, "n_fit")], T.StructField("means", arrays),
                           T.StructField("stds", arrays), T.StructField("coefficients", arrays),
                           T.StructField("intercept", T.DoubleType()), T.StructField("rank", T.LongType())])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.to_dict("records"):
                n, products = row["n_fit"], np.asarray(row.pop("products")).reshape(size, size)
                mean = products[0, 1:] / n
                spread = products[1:, 1:] / n - np.outer(mean, mean)
                std = np.sqrt(np.maximum(np.diag(spread)[:-1], 0.0))
                live = std > EPS
                out, rank = np.zeros(len(inputs)), 0
                scale = std[live]
                if live.any():
                    out[live], _, rank, _ = np.linalg.lstsq(
                        spread[:-1, :-1][np.ix_(live, live)] / np.outer(scale, scale),
                        spread[:-1, -1][live] / scale, rcond=1e-12)
                found.append({**row, "means": mean[:-1], "stds": std, "coefficients": out, "intercept": mean[-1],
                              "rank": int(rank)})
            yield pd.DataFrame(found, columns=schema.names)

    return pooled.select(*names, "n_fit", "products").mapInPandas(solve, schema)


def _scaled(inputs: Sequence[str]) -> Column:
    out = F.col("intercept")
    for i, c in enumerate(inputs):
        out = out + F.when(F.col("stds")[i] > EPS, F.col("coefficients")[i] * (
            F.col(c) - F.col("means")[i]) / F.col("stds")[i]).otherwise(F.lit(0.0))
    return out


def plain_line(fits: DataFrame) -> DataFrame:
    """Slope and intercept in the units of the readings, for fits on one input."""
    slope = F.when(F.col("stds")[0] > EPS, F.col("coefficients")[0] / F.col("stds")[0]).otherwise(F.lit(0.0))
    return fits.withColumn("slope", slope).withColumn(
        "intercept", F.col("intercept") - F.col("slope") * F.col("means")[0])


def transfer_predictions(test: DataFrame, fits: DataFrame, inputs: Sequence[str],
                         keys: Sequence[str] = ("horizon",),
                         model: str = "linear_regression") -> DataFrame:
    """Every held-out row under every protocol that tests its site, scaled as its fold was."""
    rows = test.withColumnRenamed("site", "test_site")
    scored = attached(rows, fits, ["test_site", *keys], "inner")
    return scored.withColumns({"model": F.lit(model), "predicted": _scaled(inputs)})


def transfer_scores(predictions: DataFrame, keys: Sequence[str] = (
        "protocol", "model", "horizon", "test_site")) -> DataFrame:
    """Daylight metrics with the site's own capacity and skill against its persistence."""
    y, f, ref = F.col("actual"), F.col("predicted"), F.col("reference_persistence")
    rows = predictions.where(F.col("daylight") & y.isNotNull() & f.isNotNull())
    metrics: Mapping[str, Column] = scores.metric_set(y, f, F.col("rated_w"))
    ref_rmse = scores.rmse(y, ref)
    return rows.groupBy(*keys).agg(
        *[c.alias(n) for n, c in metrics.items()], F.max("rated_w").alias("rated_w"),
        ref_rmse.alias("persistence_rmse"),
        skill(ref_rmse, metrics["rmse"]).alias("skill_vs_persistence_rmse"))


def transfer_table(scored: DataFrame, folds: DataFrame) -> DataFrame:
    """Scores with the training sites of their fold, in reading order."""
    front = ["protocol", "model", "horizon", "test_site", "train_sites", "rated_w"]
    out = attached(scored, folds, FOLD, "inner")
    return out.select(*front, *[c for c in out.columns if c not in front]).orderBy(
        "protocol", "horizon", "model", "test_site")
