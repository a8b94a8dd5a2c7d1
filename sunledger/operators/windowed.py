"""Least squares on lookback windows, for all horizons and input sets, without building a window.

A window of ``lookback`` steps over F inputs is a row of lookback x F values, and its normal equations
hold the products of any two inputs at any two lags. Nearly all of them repeat: the sum over all
origins t of x[t-k] x[t-l]' is the sum of x[s] x[s-d]' with d = l - k, taken over s = t - k, and moving
k only moves the two ends of the range of s. So one product of the inputs with themselves per lag d is
enough (a block-Toeplitz matrix), and what differs is corrected at the ends of every run of
origins. Every input set is a sub-block of the matrix of all inputs.

Scale: series are cut into chunks, which copy the few rows they need from their neighbours. A chunk
becomes one row of sums, whose size does not depend on the number of rows; sums of chunks are added
in two levels, so that a site of any length is never read by one task. Predictions are sums of products
over the lags inside a chunk.

An origin counts for a horizon when all inputs are known at the origin and at the steps before it, no
grid step between them is missing, and the label ``h`` steps later is known. With the split among the
keys neither window nor label crosses a border. Columns that others determine (lag 1 of a series now is
lag 0 one step before) make the matrix singular: the solution is the one of least norm in scaled
inputs, by eigenvalues above ``rcond`` times the largest.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.chunks import CHUNK, chunk_of, halo
from ..plans.summaries import attached, same_keys, sized
from ..schema import EPS, HORIZONS, LOOKBACK_STEPS
from ..session import materialise
from .inputs import select_inputs

CHUNK_ROWS = 16_384
CHUNKS_AT_ONCE = 64
RCOND = 1e-10


def standardised(rows: DataFrame, inputs: Sequence[str], keys: Sequence[str],
                 training: Column) -> DataFrame:
    """Inputs less their mean over their deviation in the training rows of each key; inputs that do
    not vary there become 0. Keys without training rows keep no row of known inputs."""
    stats = rows.groupBy(*keys).agg(F.struct(*[
        F.struct(F.avg(F.when(training, F.col(c))).alias("mean"),
                 F.stddev_pop(F.when(training, F.col(c))).alias("std")).alias(c)
        for c in inputs]).alias("_stats"))
    joined = attached(rows, stats, keys)
    return joined.withColumns({
        c: F.when(F.col(f"_stats.{c}.std") > EPS, (F.col(c) - F.col(f"_stats.{c}.mean"))
                  / F.col(f"_stats.{c}.std")).when(F.col(f"_stats.{c}.std").isNotNull() & F.col(c).isNotNull(), 0.0)
        for c in inputs}).drop("_stats")


class _Series:
    """The rows of a chunk and its halo as arrays on the grid, absent rows as NaN."""

    def __init__(self, table: pa.Table, order: str, columns: Sequence[str], target: str, chunk: int,
                 chunk_rows: int, horizons: Sequence[int], lookback: int):
        steps = table.column(order).to_numpy().astype(np.int64)
        self.low, high = steps.min() - lookback, steps.max() + lookback + max(horizons)
        size = int(high - self.low + 1)
        self.x = np.full((size, len(columns) + 1), np.nan)
        at = steps - self.low
        self.x[at, 0] = 1.0
        for i, c in enumerate(columns, 1):
            self.x[at, i] = table.column(c).to_numpy(zero_copy_only=False)
        self.y = np.full(size, np.nan)
        self.y[at] = table.column(target).to_numpy(zero_copy_only=False)
        known = np.cumsum(np.append(0, np.isfinite(self.x).all(axis=1)))
        whole = np.zeros(size, bool)
        whole[lookback - 1:] = known[lookback:] - known[:-lookback] == lookback
        self.ahead = np.array([np.append(self.y[h:], np.full(h, np.nan)) for h in horizons])
        self.origins = whole & np.isfinite(self.ahead)
        self.ahead = np.where(self.origins, self.ahead, 0.0)
        self.x = np.nan_to_num(self.x, nan=0.0, posinf=0.0, neginf=0.0)
        # rows that this chunk counts; the others are the halo
        self.first = int(max(chunk * chunk_rows, steps.min()) - self.low)
        self.last = int(min((chunk + 1) * chunk_rows - 1, steps.max()) - self.low + 1)


def _pairs(lookback: int) -> list[tuple[int, int]]:
    return [(k, d) for k in range(1, lookback) for d in range(lookback - k)]


def chunk_sums(series: _Series, lookback: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Per horizon: products per lag distance, products with the label per lag, end corrections."""
    x, a, b = series.x, series.first, series.last
    n_h, width = len(series.origins), x.shape[1]
    own = np.concatenate([x[a:b] * m[a:b, None] for m in series.origins], axis=1)
    base = np.stack([(own.T @ x[a - d:b - d]).reshape(n_h, width, width) for d in range(lookback)], axis=1)
    label = np.stack([(series.ahead[:, a:b] @ x[a - k:b - k]) for k in range(lookback)], axis=1)
    squares = np.sum(series.ahead[:, a:b] ** 2, axis=1)
    label = np.concatenate([label.reshape(n_h, -1), squares[:, None]], axis=1)
    ends = None
    for h, mask in enumerate(series.origins.astype(np.float64)):
        for i, (k, d) in enumerate(_pairs(lookback)):
            if d == 0:
                moved = mask[a + k:b + k] - mask[a:b]
                at = a + np.flatnonzero(moved)
                weighted = x[at] * moved[at - a, None]
            if len(at):
                ends = np.zeros((n_h, len(_pairs(lookback)), width, width)) if ends is None else ends
                ends[h, i] += weighted.T @ x[at - d]
    return base, label, ends


_SUMS = "base binary, label binary, ends binary"
_SUMS_ARROW = [("base", pa.binary()), ("label", pa.binary()), ("ends", pa.binary())]


def _added(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray | None], pa.RecordBatch]:
    total: list[np.ndarray | None] = [None, None, None]
    batch = None
    for batch in batches:
        for i, (name, _) in enumerate(_SUMS_ARROW):
            for value in batch.column(name):
                if value.is_valid:
                    part = np.frombuffer(value.as_buffer(), np.float64)
                    total[i] = part.copy() if total[i] is None else total[i] + part
    return total, batch


def lagged_sums(rows: DataFrame, inputs: Sequence[str], target: str, horizons: Mapping[str, int] = HORIZONS,
                lookback: int = LOOKBACK_STEPS, keys: Sequence[str] = ("site", "split"), order: str = "step",
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per key: the sums from which the normal equations of all windows are put together."""
    steps = list(horizons.values())
    wide = halo(rows.select(*keys, order, *inputs, target), order, lookback - 1, lookback - 1 + max(steps), chunk_rows)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def of_chunk(key, table):
        chunk = key[-1].as_py()
        series = _Series(table, order, inputs, target, chunk, chunk_rows, steps, lookback)
        parts = chunk_sums(series, lookback) if series.last > series.first else (None, None, None)
        schema = pa.schema([*[table.schema.field(k) for k in keys], ("bundle", pa.int64()), *_SUMS_ARROW])
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "bundle": [chunk // CHUNKS_AT_ONCE],
                         **{n: [None if p is None else p.tobytes()] for (n, _), p in zip(_SUMS_ARROW, parts)}},
                        schema=schema)

    def add(by: Sequence[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, last = _added(batches)
            first = last.slice(0, 1)
            yield pa.RecordBatch.from_arrays(
                [*[first.column(k) for k in by],
                 *[pa.array([None if t is None else t.tobytes()], pa.binary()) for t in total]],
                schema=pa.schema([*[last.schema.field(k) for k in by], *_SUMS_ARROW]))
        return run

    parts = wide.groupBy(*keys, CHUNK).applyInArrow(of_chunk, f"{kinds}, bundle bigint, {_SUMS}")
    parts = parts.groupBy(*keys, "bundle").applyInArrow(add([*keys, "bundle"]), f"{kinds}, bundle bigint, {_SUMS}")
    return parts.groupBy(*keys).applyInArrow(add(keys), f"{kinds}, {_SUMS}")


def normal_equations(base: np.ndarray, label: np.ndarray, ends: np.ndarray | None, lookback: int
                     ) -> tuple[np.ndarray, np.ndarray, float]:
    """Gram matrix and right side of one horizon; the constant first, then lags, oldest first."""
    width = base.shape[-1] - 1
    size = 1 + lookback * width
    gram, right = np.zeros((size, size)), np.zeros(size)
    fix = {} if ends is None else dict(zip(_pairs(lookback), ends))

    def place(lag: int) -> slice:
        return slice(1 + (lookback - 1 - lag) * width, 1 + (lookback - lag) * width)

    by_lag = label[:-1].reshape(lookback, width + 1)
    gram[0, 0], right[0] = base[0][0, 0], by_lag[0, 0]
    for k in range(lookback):
        gram[0, place(k)] = gram[place(k), 0] = base[k][0, 1:]
        right[place(k)] = by_lag[k, 1:]
        for d in range(lookback - k):
            block = (base[d] + fix[k, d] if (k, d) in fix else base[d])[1:, 1:]
            gram[place(k), place(k + d)] = block
            gram[place(k + d), place(k)] = block.T
    return gram, right, float(label[-1])


def least_norm(gram: np.ndarray, right: np.ndarray, at: np.ndarray, rcond: float = RCOND
               ) -> tuple[np.ndarray, int]:
    """Coefficients of the columns ``at`` (of all; 0 elsewhere, the constant first) and their rank."""
    out, n = np.zeros(len(right)), gram[0, 0]
    means = gram[0, at] / n
    centred = gram[np.ix_(at, at)] - n * np.outer(means, means)
    spread = np.sqrt(np.maximum(np.diag(centred), 0.0))
    live = spread > 1e-9 * np.sqrt(n)
    at, means, spread = at[live], means[live], spread[live]
    rank = 0
    if len(at):
        values, vectors = np.linalg.eigh(centred[np.ix_(live, live)] / np.outer(spread, spread))
        good = values > rcond * values[-1]
        rank = int(good.sum())
        side = (right[at] - right[0] * means) / spread
        out[at] = (vectors[:, good] @ ((vectors[:, good].T @ side) / values[good])) / spread
    out[0] = right[0] / n - means @ out[at]
    return out, rank


def fit_windows(sums: DataFrame, inputs: Sequence[str], specs: Sequence[str] = ("full",),
                horizons: Mapping[str, int] = HORIZONS, lookback: int = LOOKBACK_STEPS,
                keys: Sequence[str] = ("site",)) -> DataFrame:
    """``coefficients`` (the constant first, then ``flat_names`` order) per key, horizon and input set."""
    names, width, n_h = list(horizons), len(inputs) + 1, len(horizons)
    chosen = {s: np.array([1 + k * len(inputs) + list(inputs).index(c) for k in range(lookback)
                           for c in select_inputs(inputs, s)], int) for s in specs}
    # a horizon is a task: solving is the cube of the number of columns
    spread = sums.select(*keys, *[n for n, _ in _SUMS_ARROW],
                         F.explode(F.sequence(F.lit(0), F.lit(n_h - 1))).alias("_h")).repartition(*keys, "_h")
    kinds = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                h = one.column("_h")[0].as_py()
                base, label, ends = (
                    None if not one.column(n)[0].is_valid else np.frombuffer(one.column(n)[0].as_buffer(), np.float64)
                    for n, _ in _SUMS_ARROW)
                if base is None:
                    continue
                base = base.reshape(n_h, lookback, width, width)[h]
                label = label.reshape(n_h, -1)[h]
                ends = None if ends is None else ends.reshape(n_h, -1, width, width)[h]
                gram, right, _ = normal_equations(base, label, ends, lookback)
                if gram[0, 0] < 1:
                    continue
                fits = [least_norm(gram, right, at) for at in chosen.values()]
                many = len(fits)
                yield pa.RecordBatch.from_arrays(
                    [*[one.column(k).take(pa.array([0] * many)) for k in keys], pa.array([names[h]] * many),
                     pa.array(list(chosen)), pa.array([len(a) // lookback for a in chosen.values()], pa.int64()),
                     pa.array([int(gram[0, 0])] * many, pa.int64()), pa.array([r for _, r in fits], pa.int64()),
                     pa.array([c for c, _ in fits], pa.list_(pa.float64()))],
                    names=[*keys, "horizon", "feature_spec", "n_inputs", "n_fit", "rank", "coefficients"])

    return spread.mapInArrow(solve, f"{kinds}, horizon string, feature_spec string, n_inputs bigint, n_fit bigint, "
                                    "rank bigint, coefficients array<double>")


def predict_windows(rows: DataFrame, fits: DataFrame, inputs: Sequence[str], target: str,
                    carried: Sequence[str] = (), horizons: Mapping[str, int] = HORIZONS,
                    lookback: int = LOOKBACK_STEPS, keys: Sequence[str] = ("site",), split: str = "split",
                    order: str = "step", chunk_rows: int = CHUNK_ROWS, by_input: bool = False) -> DataFrame:
    """Predictions of every fit at every origin that has a window and a label.

    ``carried`` columns are read at the label time. ``by_input`` adds ``parts``: what each input adds to
    the prediction with all its lags, in the order of the inputs.
    """
    groups = [*keys, split]
    wide = halo(rows.select(*groups, order, *inputs, target, *[c for c in carried if c not in inputs]),
                order, lookback - 1, max(horizons.values()), chunk_rows)
    chunks = sized(rows.select(*groups, chunk_of(order, chunk_rows).alias(CHUNK)).distinct())
    models = chunks.join(fits, same_keys(chunks, fits, keys)).select(
        *[chunks[k] for k in groups], CHUNK, "horizon", "feature_spec", "coefficients")
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in groups]
    types = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried]
    names = list(horizons)

    def added(series: _Series, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of what every input adds at the origins ``at``."""
        by_lag = weights.reshape(lookback, len(inputs))[::-1]
        return sum((series.x[at - k, 1:] * by_lag[k] for k in range(lookback)), np.zeros((len(at), len(inputs))))

    def score(key, left, right):
        out = []
        fields = [*[left.schema.field(k) for k in groups], pa.field("horizon", pa.string()),
                  pa.field("feature_spec", pa.string()), pa.field("origin_step", pa.int64()),
                  pa.field("step", pa.int64()), pa.field("actual", pa.float64()), pa.field("predicted", pa.float64()),
                  *[left.schema.field(c) for c in carried],
                  *([pa.field("parts", pa.list_(pa.float64()))] if by_input else [])]
        schema = pa.schema(fields)
        if left.num_rows and right.num_rows:
            series = _Series(left, order, inputs, target, key[-1].as_py(), chunk_rows, list(horizons.values()), lookback)
            row_of = np.full(len(series.y), -1)
            row_of[left.column(order).to_numpy() - series.low] = np.arange(left.num_rows)
            weights = np.array(right.column("coefficients").to_pylist()).T
            a, b = series.first, series.last
            total = np.repeat(weights[:1], max(b - a, 0), axis=0)
            for k in range(lookback):
                at = 1 + (lookback - 1 - k) * len(inputs)
                total += series.x[a - k:b - k, 1:] @ weights[at:at + len(inputs)]
            for m, (horizon, spec) in enumerate(zip(right.column("horizon").to_pylist(),
                                                    right.column("feature_spec").to_pylist())):
                h = names.index(horizon)
                at = a + np.flatnonzero(series.origins[h, a:b])
                ahead = horizons[horizon]
                rows_ = pa.array(row_of[at + ahead])
                out.append(pa.table(
                    [*[left.column(k).slice(0, 1).take(pa.array(np.zeros(len(at), np.int64))) for k in groups],
                     pa.array([horizon] * len(at), pa.string()), pa.array([spec] * len(at), pa.string()),
                     pa.array(at + series.low), pa.array(at + series.low + ahead), pa.array(series.ahead[h, at]),
                     pa.array(total[at - a, m]), *[left.column(c).take(rows_) for c in carried],
                     *([pa.array(list(added(series, weights[1:, m], at)), pa.list_(pa.float64()))]
                       if by_input else [])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return wide.groupBy(*groups, CHUNK).cogroup(models.groupBy(*groups, CHUNK)).applyInArrow(
        score, ", ".join([*kinds, "horizon string", "feature_spec string", "origin_step bigint", "step bigint",
                          "actual double", "predicted double", *types,
                          *(["parts array<double>"] if by_input else [])]))


def window_regression(rows: DataFrame, inputs: Sequence[str], target: str = "pv_power_w",
                      specs: Sequence[str] = ("full",), carried: Sequence[str] = (),
                      horizons: Mapping[str, int] = HORIZONS, lookback: int = LOOKBACK_STEPS,
                      keys: Sequence[str] = ("site",), split: str = "split", order: str = "step",
                      train: str = "train", test: str = "test", chunk_rows: int = CHUNK_ROWS,
                      by_input: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fits of every input set on the training rows, and their predictions in the test rows."""
    kept = [c for c in (*carried, target) if c not in inputs]
    if target in inputs:
        raise ValueError("name the target's own lags as inputs; the target itself is not scaled")
    wanted = rows.select(*keys, split, order, *inputs, *kept).where(F.col(split).isin(train, test))
    ready = materialise(standardised(wanted, inputs, keys, F.col(split) == train), "standardised")
    sums = lagged_sums(ready.where(F.col(split) == train), inputs, target, horizons, lookback,
                       [*keys, split], order, chunk_rows)
    fits = materialise(fit_windows(sums, inputs, specs, horizons, lookback, keys), "fits")
    return fits, predict_windows(ready.where(F.col(split) == test), fits, inputs, target, carried, horizons,
                                 lookback, keys, split, order, chunk_rows, by_input)


def step_weights(fits: DataFrame, inputs: Sequence[str], lookback: int = LOOKBACK_STEPS) -> DataFrame:
    """``feature, step, value`` of every fit: the size of the weight of each input at each lag. Inputs are
    scaled, so sizes compare."""
    names = F.array(*[F.lit(c) for c in inputs])
    kept = [c for c in fits.columns if c != "coefficients"]
    at = F.col("_at") - 1
    return fits.select(*kept, F.posexplode("coefficients").alias("_at", "_w")).where("_at > 0").select(
        *kept, names[(at % len(inputs)).cast("int")].alias("feature"),
        (F.lit(lookback - 1) - F.floor(at / len(inputs))).cast("int").alias("step"), F.abs("_w").alias("value"))
