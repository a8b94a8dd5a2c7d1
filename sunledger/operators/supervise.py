"""Targets, chronological splits, scaling and lookback windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from ..functions import clock
from ..plans.chunks import CHUNK_STEPS, over_halo, with_position
from ..plans.summaries import sized
from ..schema import EPS, HORIZONS, LOOKBACK_STEPS, STEP_SECONDS

SITE = ["site"]


@dataclass(frozen=True)
class Boundaries:
    """Inclusive first and last local times of the three splits."""

    train: tuple[str, str]
    val: tuple[str, str]
    test: tuple[str, str]

    def __post_init__(self):
        edges = [*self.train, *self.val, *self.test]
        if edges != sorted(edges) or self.train[1] >= self.val[0] or self.val[1] >= self.test[0]:
            raise ValueError(f"split boundaries must be ordered and disjoint: {edges}")

    def label(self, time: Column) -> Column:
        """Split of a time, null outside all of them."""
        out = F.lit(None).cast("string")
        for name in ("train", "val", "test"):
            first, last = getattr(self, name)
            inside = time.between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"))
            out = F.when(inside, F.lit(name)).otherwise(out)
        return out


def assign_split(df: DataFrame, boundaries: Boundaries, order: str = "step",
                 strategy: str = "chronological") -> DataFrame:
    if strategy != "chronological":
        raise ValueError(f"only a chronological split keeps the future unseen, not {strategy!r}")
    return df.withColumn("split", boundaries.label(clock.instant(F.col(order))))


def split_audit(df: DataFrame, keys: Sequence[str] = SITE, order: str = "step") -> DataFrame:
    """Sizes, shares and ranges of the splits, rows outside them, and the seams in steps."""
    def of(name: str, aggregate, value) -> Column:
        return aggregate(F.when(F.col("split") == name, value))

    at = F.col(order)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("split").isNull()).alias("n_outside"),
        *[of(s, F.count, F.lit(1)).alias(f"n_{s}") for s in ("train", "val", "test")],
        *[of(s, edge, at).alias(f"{s}_{label}") for s in ("train", "val", "test")
          for label, edge in (("first", F.min), ("last", F.max))])
    kept = F.col("n_rows") - F.col("n_outside")
    return out.withColumns({
        **{f"fraction_{s}": F.col(f"n_{s}") / kept for s in ("train", "val", "test")},
        "train_val_gap_steps": F.col("val_first") - F.col("train_last"),
        "val_test_gap_steps": F.col("test_first") - F.col("val_last")})


def embargo_violations(audit: DataFrame, embargo_steps: int = 0) -> DataFrame:
    """Series whose splits lie closer together than one step plus the embargo."""
    least = 1 + embargo_steps
    return audit.where((F.col("train_val_gap_steps") < least)
                       | (F.col("val_test_gap_steps") < least))


def build_target(df: DataFrame, target: str = "pv_power_w",
                 horizons: Mapping[str, int] = HORIZONS, keys: Sequence[str] = SITE,
                 carry_columns: Sequence[str] = (), order: str = "step",
                 chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """One row per origin and horizon with the value at ``step + h``.

    ``carry_columns`` are read at the label time as ``label_<name>``. Origins whose
    label does not exist are dropped. The table must be gap-free within ``keys``.
    """
    out = over_halo(df, keys, order, _labels(target, horizons, carry_columns),
                    after=max(horizons.values()), chunk_steps=chunk_steps)
    return _per_horizon(out, horizons, carry_columns, order)


def _labels(target: str, horizons: Mapping[str, int], carry_columns: Sequence[str]):
    """Window build of one struct ``_h<steps>`` per horizon."""
    def ahead(w: WindowSpec) -> dict[str, Column]:
        def label(h: int) -> Column:
            fields = [F.lead(target, h).over(w).alias("target"),
                      *[F.lead(c, h).over(w).alias(f"label_{c}") for c in carry_columns]]
            return F.struct(*fields)
        return {f"_h{h}": label(h) for h in horizons.values()}
    return ahead


def _per_horizon(out: DataFrame, horizons: Mapping[str, int], carry_columns: Sequence[str],
                 order: str) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(name).alias("horizon"), F.lit(h).alias("target_lead_steps"),
                 F.lit(h * STEP_SECONDS / 3600.0).alias("target_lead_hours"),
                 F.col(f"_h{h}.target").alias("target"),
                 *[F.col(f"_h{h}.label_{c}").alias(f"label_{c}") for c in carry_columns])
        for name, h in horizons.items()])
    kept = [c for c in out.columns if c not in {f"_h{h}" for h in horizons.values()}]
    return (out.select(*kept, F.inline(rows)).where(F.col("target").isNotNull())
            .withColumn("target_step", F.col(order) + F.col("target_lead_steps")))


def causality_audit(supervised: DataFrame, observed: DataFrame, value: str = "pv_power_w",
                    keys: Sequence[str] = SITE, order: str = "step",
                    tolerance: float = 1e-9) -> DataFrame:
    """Compare every label with the reading at its label time, found by clock, not by row."""
    truth = observed.select(*keys, F.col(order).alias("target_step"), F.col(value).alias("_seen"))
    joined = supervised.join(truth, [*keys, "target_step"], "left")
    wrong = F.col("_seen").isNull() | (F.abs(F.col("_seen") - F.col("target")) > tolerance)
    return joined.groupBy(*keys, "horizon").agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.count_if(F.col("target_step") <= F.col(order)).alias("n_not_after_origin"),
        F.count_if(wrong).alias("n_mismatched"))


def fit_scalers(train: DataFrame, columns: Sequence[str],
                keys: Sequence[str] = SITE) -> DataFrame:
    """Mean and population deviation of every column, one row per key and column."""
    stats = train.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[e.alias(f"_{s}_{i}") for i, c in enumerate(columns) for s, e in (
            ("m", F.avg(c)), ("d", F.stddev_pop(c)), ("n", F.count(c)))])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_m_{i}").alias("mean"),
                 F.col(f"_d_{i}").alias("std"), F.col(f"_n_{i}").alias("n_known"),
                 F.col("_rows").alias("n_rows")) for i, c in enumerate(columns)])
    out = stats.select(*keys, F.inline(rows))
    return out.withColumn("status", F.when(F.col("n_known") < F.col("n_rows"), "non_finite")
                          .when(F.coalesce("std", F.lit(0.0)) <= EPS, "zero_variance")
                          .otherwise("ok"))


def scaler_row(scalers: DataFrame, columns: Sequence[str],
               keys: Sequence[str] = SITE) -> DataFrame:
    """One row per key with a (mean, std) struct per column."""
    return scalers.groupBy(*keys).agg(*[
        F.max(F.when(F.col("column") == c, F.struct("mean", "std"))).alias(f"_scale_{c}")
        for c in columns])


def apply_scalers(df: DataFrame, scalers: DataFrame, columns: Sequence[str],
                  keys: Sequence[str] = SITE, invert: bool = False) -> DataFrame:
    wide = sized(scaler_row(scalers, columns, keys))

    def scaled(c: str) -> Column:
        mean, std = F.col(f"_scale_{c}.mean"), F.col(f"_scale_{c}.std")
        return F.col(c) * std + mean if invert else (F.col(c) - mean) / std

    return (df.join(wide, list(keys)).withColumns({c: scaled(c) for c in columns})
            .drop(*[f"_scale_{c}" for c in columns]))


def window_origins(df: DataFrame, horizon_steps: int, lookback: int = LOOKBACK_STEPS,
                   stride: int = 1, keys: Sequence[str] = SITE, order: str = "step",
                   truncated_target: bool = False) -> DataFrame:
    """Origins that have a full lookback and a label row, with their row indices.

    ``truncated_target`` also counts the rows lost when labels are cut off before the
    windows are built, which loses ``2 h`` rows instead of ``h``.
    """
    if lookback < 1 or horizon_steps < 1 or stride < 1:
        raise ValueError("lookback, horizon and stride must be at least 1")
    lost = 2 * horizon_steps if truncated_target else horizon_steps
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    start = F.col("pos") - lookback
    rows = with_position(df.select(*keys, order), keys, order).join(sized(sizes), list(keys))
    return (rows.where((start >= 0) & (F.col("pos") + lost <= F.col("_n"))
                       & (F.pmod(start, F.lit(stride)) == 0))
            .select(*keys, order, start.alias("start_row"), (F.col("pos") - 1).alias("origin_row"),
                    (F.col("pos") - 1 + horizon_steps).alias("label_row")))


def build_windows(df: DataFrame, features: Sequence[str], target: str = "pv_power_w",
                  horizons: Mapping[str, int] = HORIZONS, lookback: int = LOOKBACK_STEPS,
                  keys: Sequence[str] = SITE, label_columns: Sequence[str] = (),
                  order: str = "step", chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Lookback window per origin as an array of structs, oldest step first, with labels.

    With the split among ``keys`` no window and no label crosses a split's border. Labels and
    windows share one shuffle; the arrays are built last.
    """
    def window(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(-(lookback - 1), 0)
        return {"window": F.collect_list(F.struct(*features)).over(frame)}

    out = over_halo(df, keys, order, _labels(target, horizons, label_columns), window,
                    before=lookback - 1, after=max(horizons.values()), chunk_steps=chunk_steps)
    return _per_horizon(out.where(F.size("window") == lookback), horizons, label_columns, order)


def describe_windows(windows: DataFrame, keys: Sequence[str] = ("site", "horizon"),
                     daylight: str = "label_daylight", order: str = "step") -> DataFrame:
    return windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.max(F.size("window")).alias("lookback_steps"),
        F.min(order).alias("first_origin"), F.max(order).alias("last_origin"),
        F.min("target_step").alias("first_target"), F.max("target_step").alias("last_target"),
        F.avg(F.col(daylight).cast("double")).alias("daylight_fraction"))


def flat_names(features: Sequence[str], lookback: int = LOOKBACK_STEPS) -> list[str]:
    """``feature@t-k`` for every step of the window, oldest step first."""
    return [f"{f}@t-{k}" if k else f"{f}@t" for k in range(lookback - 1, -1, -1)
            for f in features]


def flatten_windows(df: DataFrame, features: Sequence[str], lookback: int = LOOKBACK_STEPS,
                    keys: Sequence[str] = SITE, order: str = "step",
                    chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Lookback window as one lag column per feature and step."""
    def columns(w: WindowSpec) -> dict[str, Column]:
        names = iter(flat_names(features, lookback))
        return {next(names): (F.lag(f, k).over(w) if k else F.col(f))
                for k in range(lookback - 1, -1, -1) for f in features}

    out = over_halo(df, keys, order, columns, before=lookback - 1, chunk_steps=chunk_steps)
    return out.na.drop(subset=[f"`{n}`" for n in flat_names(features, lookback)])
