"""Comparative statistics of serially correlated forecast errors.

Inputs are rows with the key columns, an order column and error columns. Rows of a key
may be any number: positions come from chunked plans, ranks from bucketed ones, and a resample
is read from prefix sums, where the rows are, instead of being built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.draws import mixed
from ..functions.stats import two_sided_p
from ..plans.chunks import CHUNK_STEPS, over_halo, with_position
from ..plans.ranks import ranked_values
from ..plans.summaries import same_keys, sized
from ..session import materialise
from ..schema import BLOCK_LENGTHS, BLOCK_STEPS, CONFIDENCE, RESAMPLES

RUN = ["site", "model", "horizon"]
LOSSES = {"mae": lambda e: F.abs(e), "rmse": lambda e: e * e}


def loss_difference(a: Column, b: Column, loss: str) -> Column:
    """Positive where ``a`` loses more than ``b``."""
    if loss not in LOSSES:
        raise KeyError(f"unknown loss {loss!r}; use 'mae' or 'rmse'")
    return LOSSES[loss](a) - LOSSES[loss](b)


def loss_rows(df: DataFrame, a: str = "error", b: str = "reference_error",
              losses: Sequence[str] = ("mae", "rmse")) -> DataFrame:
    """One row per loss with its differential ``d``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("loss"),
                               loss_difference(F.col(a), F.col(b), n).alias("d"))
                      for n in losses])
    return df.select("*", F.inline(pairs))


# ---- moving-block bootstrap ---------------------------------------------------

WHOLE_ROWS, MOST_PARTS = 1 << 16, 64


def in_parts(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column],
             back: int = 0, ahead: int = 0, whole_rows: int = WHOLE_ROWS) -> tuple[DataFrame, bool]:
    """Rows with ``_order``, the values as doubles, the size ``n`` of their key and a ``_part``.

    A key of up to ``whole_rows`` rows is one part. If any is longer (the second result), keys are
    cut into parts of ``_long`` rows by position ``_pos``, at most 64, and a row goes to each part that
    reaches ``back`` rows before its first or ``ahead`` rows behind its last one.
    """
    rows = df.select(*keys, F.col(order).alias("_order"), *[e.cast("double").alias(n) for n, e in values.items()])
    sizes = sized(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    cut = (sizes.agg(F.max("n")).first()[0] or 0) > whole_rows
    if cut:
        rows = with_position(rows, keys, "_order", "_pos")
    rows = rows.join(sizes, same_keys(rows, sizes, keys)).drop(*[sizes[k] for k in keys])
    if not cut:
        return rows.withColumn("_part", F.lit(0).cast("long")), False
    parts = F.least(F.ceil(F.col("n") / whole_rows), F.lit(MOST_PARTS))
    rows = rows.withColumn("_long", F.ceil(F.col("n") / parts))
    low = F.floor((F.col("_pos") - 1 - ahead) / F.col("_long"))
    high = F.floor((F.col("_pos") - 1 + back) / F.col("_long"))
    last = F.floor((F.col("n") - 1) / F.col("_long"))
    return rows.withColumn("_part", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, last)))), True


def _part_of(key, table, cut: bool, names: Sequence[str]) -> tuple[int, int, int, int, list[np.ndarray]]:
    """Size of the key, first and last (exclusive) own position, position of the first row, and values."""
    n, at = table.column("n")[0].as_py(), np.argsort(table.column("_order").to_numpy(), kind="stable")
    values = [table.column(c).to_numpy(zero_copy_only=False)[at] for c in names]
    if not cut:
        return n, 0, n, 0, values
    size = table.column("_long")[0].as_py()
    start = key[-1].as_py() * size
    return n, start, min(n, start + size), table.column("_pos").to_numpy().min() - 1, values


def _repeated(table, keys: Sequence[str], many: int) -> dict:
    return {k: table.column(k).take(pa.array(np.zeros(many, np.int64))) for k in keys}


def resample_sums(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column],
                  n_resamples: int = RESAMPLES, blocks: int | Sequence[int] = BLOCK_STEPS,
                  seed: int = 42, order: str = "step", whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """Sums of ``values`` over every moving-block resample of every key.

    The draws are numbers of their indices, so every task makes them for itself: no draw and no
    resample is ever shuffled. A part (see ``in_parts``) adds up the blocks that start in it. What leaves
    a part is one number per resample, block length and value, whatever the number of rows. All
    values share the same blocks.
    """
    lengths = sorted({max(1, b) for b in ([blocks] if isinstance(blocks, int) else blocks)})
    named = {f"_p_{n}": e for n, e in values.items()}
    rows, cut = in_parts(df, keys, order, named, ahead=lengths[-1] - 1, whole_rows=whole_rows)
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    columns, labels = list(named), list(values)
    outs = ["block_length", "resample", "n", *labels]

    def draw_part(key, table):
        n, start, stop, _, own = _part_of(key, table, cut, columns)
        sums = [np.append(0.0, np.cumsum(v)) for v in own]
        out = {c: [] for c in outs}
        for length in lengths:
            size = min(length, n)
            many = -(-n // size)
            block = np.arange(many)
            spans = np.minimum(size, n - block * size)
            at_once = max(1, (1 << 20) // many)
            for low in range(0, n_resamples, at_once):
                resample = np.arange(low, min(low + at_once, n_resamples))
                begin = (mixed(seed, resample[:, None], block[None, :], np.array(length))
                         % np.uint64(n - size + 1)).astype(np.int64)
                here = (begin >= start) & (begin < stop)
                # a block that starts elsewhere counts from its start to its start
                begin = np.where(here, begin - start, 0)
                end = begin + np.where(here, spans, 0)
                out["resample"].append(resample)
                out["block_length"].append(np.full(len(resample), length))
                out["n"].append(np.full(len(resample), n))
                for name, total in zip(labels, sums):
                    out[name].append((total[end] - total[begin]).sum(axis=1))
        many = len(lengths) * n_resamples
        return pa.table({**_repeated(table, keys, many), **{c: np.concatenate(v) for c, v in out.items()}})

    drawn = rows.groupBy(*keys, "_part").applyInArrow(draw_part, ", ".join(
        [*kinds, "block_length bigint", "resample bigint", "n bigint", *[f"`{v}` double" for v in labels]]))
    if not cut:
        return drawn
    return drawn.groupBy(*keys, "block_length", "resample", "n").agg(*[F.sum(v).alias(v) for v in labels])


ERROR_SUMS = {"rmse": lambda e: e * e, "mae": lambda e: F.abs(e), "bias": lambda e: e}


def _finish(metric: str, total: Column, n: Column) -> Column:
    mean = total / n
    # a sum of squares read as a difference of prefix sums may be a tiny negative
    return F.sqrt(F.greatest(mean, F.lit(0.0))) if metric == "rmse" else mean


def interval_of(draws: DataFrame, keys: Sequence[str], value: str,
                confidence: float = CONFIDENCE) -> DataFrame:
    """Percentile interval over resamples; a group holds one number per resample."""
    tail = (1.0 - confidence) / 2.0
    return draws.groupBy(*keys).agg(
        F.percentile(value, F.lit(tail)).alias("ci_low"),
        F.percentile(value, F.lit(1.0 - tail)).alias("ci_high"),
        F.count(value).alias("n_resamples"), F.stddev_samp(value).alias("se"))


def bootstrap_metric(df: DataFrame, error: str = "error", metric: str = "rmse",
                     keys: Sequence[str] = RUN, n_resamples: int = RESAMPLES,
                     block: int = BLOCK_STEPS, seed: int = 42, order: str = "step",
                     confidence: float = CONFIDENCE) -> DataFrame:
    value = ERROR_SUMS[metric](F.col(error))
    points = df.groupBy(*keys).agg(
        _finish(metric, F.sum(value), F.count(F.lit(1))).alias("point_estimate"))
    draws = resample_sums(df, keys, {"total": value}, n_resamples, block, seed, order)
    draws = draws.withColumn("draw", _finish(metric, F.col("total"), F.col("n")))
    return points.join(interval_of(draws, keys, "draw", confidence), list(keys))


def bootstrap_skill(df: DataFrame, error: str = "error", reference: str = "reference_error",
                    metric: str = "rmse", keys: Sequence[str] = RUN,
                    n_resamples: int = RESAMPLES, block: int = BLOCK_STEPS, seed: int = 42,
                    order: str = "step", confidence: float = CONFIDENCE) -> DataFrame:
    """Skill interval with model and reference on the same blocks."""
    model, base = ERROR_SUMS[metric](F.col(error)), ERROR_SUMS[metric](F.col(reference))

    def skill(m: Column, r: Column, n: Column) -> Column:
        floor = _finish(metric, r, n)
        return F.when(floor > 0, 1.0 - _finish(metric, m, n) / floor)

    points = df.groupBy(*keys).agg(
        skill(F.sum(model), F.sum(base), F.count(F.lit(1))).alias("point_estimate"))
    draws = resample_sums(df, keys, {"m": model, "r": base}, n_resamples, block, seed, order)
    draws = draws.withColumn("draw", skill(F.col("m"), F.col("r"), F.col("n")))
    return points.join(interval_of(draws, keys, "draw", confidence), list(keys))


def block_length_sensitivity(df: DataFrame, value: str = "d", keys: Sequence[str] = RUN,
                             blocks: Sequence[int] = BLOCK_LENGTHS,
                             n_resamples: int = RESAMPLES, seed: int = 42,
                             order: str = "step", confidence: float = CONFIDENCE) -> DataFrame:
    """Width of the interval of a mean differential by block length."""
    draws = resample_sums(df, keys, {"total": F.col(value)}, n_resamples, list(blocks), seed, order)
    draws = draws.withColumn("draw", F.col("total") / F.col("n"))
    table = interval_of(draws, [*keys, "block_length"], "draw", confidence).withColumn(
        "ci_width", F.col("ci_high") - F.col("ci_low"))
    widest = F.max("ci_width").over(Window.partitionBy(*keys))
    return table.withColumns({"block_hours": F.col("block_length") * 15 / 60.0,
                              "relative_width": F.col("ci_width") / widest})


# ---- tests ----------------------------------------------------------------------

def lagged_products(df: DataFrame, value: str, max_lag: int, keys: Sequence[str],
                    order: str = "step", chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Per key: n, mean and the centred autocovariance sums ``s0 .. s<max_lag>``."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    rows = with_position(df.select(*keys, order, value), keys, order, "_pos", chunk_steps)
    rows = rows.join(sized(means), list(keys)).withColumn("_c", F.col(value) - F.col("mean"))

    def delayed(w: WindowSpec) -> dict[str, Column]:
        return {f"_l{k}": F.lag("_c", k).over(w) for k in range(1, max_lag + 1)}

    if max_lag:
        rows = over_halo(rows, keys, "_pos", delayed, before=max_lag, chunk_steps=chunk_steps)
    return rows.groupBy(*keys, "n", "mean").agg(
        F.sum(F.col("_c") * F.col("_c")).alias("s0"),
        *[F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"s{k}")
          for k in range(1, max_lag + 1)])


def diebold_mariano(df: DataFrame, value: str = "d", keys: Sequence[str] = (*RUN, "loss"),
                    horizon: int = 1, small_sample: bool = True, alpha: float = 0.05,
                    order: str = "step", chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Test of equal accuracy on a loss differential.

    Bartlett long-run variance with bandwidth ``horizon - 1``. With ``small_sample`` the
    variance divides by ``n - 1 - 2 (horizon - 1)``. ``hln_statistic`` carries the
    published small-sample factor for the same bandwidth.
    """
    h = max(0, horizon - 1)
    sums = lagged_products(df, value, max(h, 1), keys, order, chunk_steps)
    spread = F.col("s0")
    for k in range(1, h + 1):
        spread = spread + 2.0 * (1.0 - k / (h + 1.0)) * F.col(f"s{k}")
    n = F.col("n")
    divisor = F.greatest(n - 1 - 2 * h, F.lit(1)) if small_sample else n
    out = sums.withColumn("_var", spread / (divisor * n))
    live = F.col("_var") > 0
    out = out.withColumn("statistic", F.when(live, F.col("mean") / F.sqrt("_var"))
                         .otherwise(F.lit(0.0)))
    factor = F.sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n)
    plain = F.when(live, F.col("mean") / F.sqrt(spread / (n * n))).otherwise(F.lit(0.0))
    return out.withColumns({
        "p_value": F.when(live, two_sided_p(F.col("statistic"))).otherwise(F.lit(1.0)),
        "lag_1_autocorrelation": F.when((F.col("s0") > 0) & (n > 2), F.col("s1") / F.col("s0"))
        .otherwise(F.lit(0.0)),
        "hln_statistic": plain * factor,
        "model_is_better": F.col("mean") < 0,
    }).select(*keys, "n", F.col("mean").alias("mean_differential"), "statistic", "p_value",
              (F.col("p_value") < alpha).alias("significant"), "lag_1_autocorrelation",
              "hln_statistic", "model_is_better")


def holm(df: DataFrame, p: str = "p_value",
         family: Sequence[str] | None = None,
         out: str = "p_value_adjusted", tie: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values within a family of tests (one row per test).

    By default a family is one site, horizon and loss (of these the columns that exist), so
    that a further site changes no other p-value.
    """
    family = family or [c for c in ("site", "horizon", "loss") if c in df.columns]
    ordered = Window.partitionBy(*family).orderBy(p, *tie)
    size = F.count(p).over(Window.partitionBy(*family))
    step = F.least((size - F.row_number().over(ordered) + 1) * F.col(p), F.lit(1.0))
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_step", step).withColumn(
        out, F.max("_step").over(running)).drop("_step")


def signed_rank(df: DataFrame, value: str = "d", keys: Sequence[str] = (*RUN, "loss"),
                few: int = 6, decimals: int | None = None) -> DataFrame:
    """Wilcoxon signed-rank test and matched-pairs rank-biserial effect.

    Zero differences are dropped, ties share their average rank, and the normal
    approximation carries the tie correction. Without any pair the test is null; ``few_pairs``
    marks tests of fewer than ``few``, where the approximation is rough.
    ``decimals`` treats differences that agree to so many places as tied, so that noise
    in the last bits of computed forecasts breaks no tie.
    """
    if decimals is not None:
        df = df.withColumn(value, F.round(value, decimals))
    size = df.groupBy(*keys).agg(F.count(value).alias("n_all"))
    d = F.col(value)
    ranked = ranked_values(
        df.where(d != 0).withColumn("_size", F.abs(d)), keys, "_size",
        {"_up": F.count_if(d > 0), "_down": F.count_if(d < 0)})
    rank = F.col("first_rank") + (F.col("ties") - 1) / 2.0
    ties = F.col("ties").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("_up") * rank).alias("w_plus"), F.sum(F.col("_down") * rank).alias("w_minus"),
        F.sum("ties").alias("n_pairs"), F.sum(ties * ties * ties - ties).alias("_ties"))
    joined = size.join(sums, list(keys), "left").na.fill(
        {"n_pairs": 0, "w_plus": 0.0, "w_minus": 0.0, "_ties": 0.0})
    n = F.col("n_pairs").cast("double")
    low = F.least("w_plus", "w_minus")
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0
    z = (low - n * (n + 1) / 4.0) / F.sqrt(F.when(variance > 0, variance))
    total = F.col("w_plus") + F.col("w_minus")
    enough = F.col("n_pairs") > 0
    return joined.select(
        *keys, F.when(enough, low).alias("statistic"),
        F.when(enough, two_sided_p(z)).alias("p_value"),
        F.when(enough & (total > 0), (F.col("w_plus") - F.col("w_minus")) / total)
        .otherwise(F.lit(0.0)).alias("effect_size_rank_biserial"),
        "n_pairs", (F.col("n_all") - F.col("n_pairs")).alias("n_zero_differences"),
        (F.col("n_pairs") < few).alias("few_pairs"))


FFT_ROWS = 1 << 14


def lag_sums(values: np.ndarray, first: int, max_lag: int) -> np.ndarray:
    """Sums of v[t] v[t - k] over t from ``first`` on, for k = 0 .. max_lag, by overlap-save: blocks
    of rows and the ``max_lag`` rows before them, correlated as products of their transforms."""
    out = np.zeros(max_lag + 1)
    width = 1 << int(np.ceil(np.log2(max(FFT_ROWS, 2 * max_lag) + max_lag)))
    step = width - max_lag
    padded = np.append(np.zeros(max_lag), values)
    for low in range(first, len(values), step):
        own = values[low:low + step]
        with_past = padded[low:low + len(own) + max_lag]  # from max_lag rows before ``low``
        size = min(width, 1 << int(np.ceil(np.log2(len(with_past) + max_lag + 1))))
        corr = np.fft.irfft(np.conj(np.fft.rfft(own, size)) * np.fft.rfft(with_past, size), size)
        out += corr[max_lag::-1]
    return out


def autocorrelation(df: DataFrame, value: str = "d", max_lag: int = 96,
                    keys: Sequence[str] = RUN, order: str = "step",
                    whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """Autocorrelation at every lag up to ``max_lag`` (null beyond the series); null values count
    as the mean. What leaves a part of a series is one sum per lag."""
    means = sized(df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.count(value).alias("_known")))
    rows = df.select(*keys, order, value).join(means, same_keys(df, means, keys)).drop(*[means[k] for k in keys])
    centred = {"_c": F.coalesce(F.col(value) - F.col("_mean"), F.lit(0.0)), "_n": F.col("_known")}
    parts, cut = in_parts(rows, keys, order, centred, back=max_lag, whole_rows=whole_rows)
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]

    def lags_of(key, table):
        _, start, _, begin, (own, known) = _part_of(key, table, cut, ["_c", "_n"])
        return pa.table({**_repeated(table, keys, max_lag + 1),
                         "n": np.full(max_lag + 1, int(known[0])), "lag": np.arange(max_lag + 1),
                         "_s": lag_sums(own, start - begin, max_lag)})

    sums = parts.groupBy(*keys, "_part").applyInArrow(lags_of, ", ".join(
        [*kinds, "n bigint", "lag bigint", "_s double"]))
    if cut:
        sums = sums.groupBy(*keys, "n", "lag").agg(F.sum("_s").alias("_s"))
    # at most max_lag + 1 sums a key
    whole = F.max(F.when(F.col("lag") == 0, F.col("_s"))).over(Window.partitionBy(*keys))
    ratio = F.when((F.col("lag") < F.col("n")) & (whole > 0), F.col("_s") / whole)
    return sums.select(*keys, "n", "lag", ratio.alias("autocorrelation"),
                      (F.col("lag") * 15 / 60.0).alias("lag_hours"))


def effective_sample_size(profile: DataFrame, keys: Sequence[str] = RUN,
                          limit: float = 0.05, max_lag: int | None = None) -> DataFrame:
    """Integrated autocorrelation time and the sample size it leaves.

    Lags are summed up to the first one below ``limit``; all of the profile's when none is,
    or the first ``max_lag`` of them. When no lag reaches the limit the first lag alone counts.
    """
    n = F.col("n")
    top = F.least(F.lit(max_lag), n - 2) if max_lag else n - 2
    rows = profile.where((F.col("lag") >= 1) & (F.col("lag") <= top))
    lags = rows.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct(
        "lag", F.col("autocorrelation").alias("r")))).alias("_lags"))
    cut = F.get(F.filter("_lags", lambda x: F.abs(x["r"]) < limit), F.lit(0))["lag"]
    any_hit = F.exists("_lags", lambda x: F.abs(x["r"]) >= limit)
    counted = F.filter("_lags", lambda x: F.when(any_hit, F.col("_cut").isNull() | (
        x["lag"] < F.col("_cut"))).otherwise(x["lag"] == 1))
    total = F.aggregate(counted, F.lit(0.0), lambda acc, x: acc + F.coalesce(x["r"], F.lit(0.0)))
    tau = F.greatest(F.lit(1.0), 1.0 + 2.0 * total)
    return lags.withColumn("_cut", cut).select(
        *keys, "n", tau.alias("integrated_autocorrelation_time"),
        (n / tau).alias("effective_sample_size"))


# ---- bundles ----------------------------------------------------------------------

def compare_models(errors: DataFrame, keys: Sequence[str] = RUN,
                   family: Sequence[str] | None = None, n_resamples: int = RESAMPLES,
                   block: int = BLOCK_STEPS, horizon: int = 1, seed: int = 42,
                   order: str = "step", rank_decimals: int | None = None) -> DataFrame:
    """Skill interval, Diebold-Mariano with Holm, and signed ranks for all runs and losses, with
    both significances and whether the two losses agree.

    Only steps that every model of a site and horizon has take part.
    """
    group = [k for k in keys if k != "model"]
    models = errors.groupBy(*group).agg(F.count_distinct("model").alias("_all"))
    stamps = errors.groupBy(*group, order).agg(F.count_distinct("model").alias("_here"))
    whole = stamps.join(models, group).where(F.col("_here") == F.col("_all"))
    errors = errors.join(whole.select(*group, order), [*group, order], "left_semi")
    skill = bootstrap_skill(errors, keys=keys, n_resamples=n_resamples, block=block, seed=seed,
                            order=order).select(
        *keys, F.col("point_estimate").alias("skill"), F.col("ci_low").alias("skill_low"),
        F.col("ci_high").alias("skill_high"))
    rows = loss_rows(errors)
    test_keys = [*keys, "loss"]
    dm = holm(diebold_mariano(rows, keys=test_keys, horizon=horizon, order=order),
              family=family, tie=keys)
    ranks = signed_rank(rows, keys=test_keys, decimals=rank_decimals).select(
        *test_keys, F.col("statistic").alias("wilcoxon_statistic"),
        F.col("p_value").alias("wilcoxon_p"), "effect_size_rank_biserial", "n_pairs")
    # one row a model and loss: whether both losses say the same before and after the correction
    run = Window.partitionBy(*keys)
    dm = dm.withColumns({
        "significant_holm": F.col("p_value_adjusted") < 0.05,
        "losses_agree": F.min("significant").over(run) == F.max("significant").over(run)})
    return dm.join(ranks, test_keys, "left").join(skill, list(keys), "left")


def best_differentials(predictions: DataFrame, family: Sequence[str] = ("site", "horizon"),
                       baseline: str = "persistence", order: str = "step") -> DataFrame:
    """Of the best model of each family its ``error`` and its loss differentials against the
    baseline, as rows of ``series`` and ``d``. The best is that of the lowest RMSE."""
    rows = predictions.where(F.col("model") != baseline)
    best = sized(best_run(rows, family).select(*family, F.col("best_model").alias("_best")))
    e, r = F.col("predicted") - F.col("actual"), F.col("reference_persistence") - F.col("actual")
    listed = F.array(*[F.struct(F.lit(n).alias("series"), d.alias("d")) for n, d in {
        "error": e, **{n: loss_difference(e, r, n) for n in LOSSES}}.items()])
    return rows.join(best, same_keys(rows, best, family) & (F.col("model") == F.col("_best"))).select(
        *[rows[k] for k in family], "model", order, F.inline(listed))


def ablation_statistics(runs: DataFrame, keys: Sequence[str] = RUN, spec: str = "feature_spec",
                        full: str = "full", n_resamples: int = RESAMPLES, block: int = BLOCK_STEPS,
                        seed: int = 42, order: str = "step", family: Sequence[str] = ("site",)
                        ) -> DataFrame:
    """Every reduced input set against the same model with all inputs, on the same steps.

    ``runs`` holds ``actual`` and ``predicted`` per key, input set and step. Skill and the paired
    test take the full run as the reference, so 0 means that what was left out adds nothing.
    Holm's family is all comparisons of a site.
    """
    each = [*keys, spec]
    whole = runs.where(F.col(spec) == full).select(
        *keys, order, (F.col("predicted") - F.col("actual")).alias("reference_error"))
    errors = materialise(runs.where(F.col(spec) != full).select(
        *each, order, (F.col("predicted") - F.col("actual")).alias("error")).join(
        whole, [*keys, order]), "paired")

    def rmse(e: str) -> Column:
        return F.sqrt(F.avg(F.col(e) * F.col(e)))

    points = errors.groupBy(*each).agg(F.count(F.lit(1)).alias("n_daylight"), rmse("error").alias("rmse"),
                                       rmse("reference_error").alias("full_rmse"))
    skill = bootstrap_skill(errors, keys=each, n_resamples=n_resamples, block=block, seed=seed, order=order).select(
        *each, F.col("point_estimate").alias("skill"), F.col("ci_low").alias("skill_low"),
        F.col("ci_high").alias("skill_high"))
    dm = holm(diebold_mariano(loss_rows(errors, losses=["mae"]), keys=each, order=order), family=family, tie=each)
    out = points.join(skill, each).join(dm.select(*each, "statistic", "p_value", "lag_1_autocorrelation",
                                                  "p_value_adjusted"), each)
    return out.withColumn("rmse_increase_pct", F.when(
        F.col("full_rmse") > 0, 100.0 * (F.col("rmse") / F.col("full_rmse") - 1.0)))


def best_run(predictions: DataFrame, family: Sequence[str], model: str = "model") -> DataFrame:
    """Model with the lowest RMSE of each family."""
    e = F.col("predicted") - F.col("actual")
    per_run = predictions.groupBy(*family, model).agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    return per_run.groupBy(*family).agg(
        F.min_by(model, F.struct("rmse", model)).alias("best_model"),
        F.min("rmse").alias("best_rmse"))
