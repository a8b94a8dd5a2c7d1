"""Point metrics as aggregate expressions over (actual, predicted)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import EPS
from .stats import skill


def error(actual: Column, predicted: Column) -> Column:
    return predicted - actual


def mae(y: Column, f: Column) -> Column:
    return F.avg(F.abs(f - y))


def mse(y: Column, f: Column) -> Column:
    return F.avg((f - y) * (f - y))


def rmse(y: Column, f: Column) -> Column:
    return F.sqrt(mse(y, f))


def bias(y: Column, f: Column) -> Column:
    return F.avg(f - y)


def peak_error(y: Column, f: Column) -> Column:
    return F.max(F.abs(f - y))


def r2(y: Column, f: Column) -> Column:
    """1 - SSE/SST over complete pairs, 0 when the target does not vary."""
    total = F.var_pop(F.when(f.isNotNull(), y)) * F.count(f - y)
    return F.when(total <= EPS, F.lit(0.0)).otherwise(
        1.0 - F.sum((f - y) * (f - y)) / total)


def smape(y: Column, f: Column) -> Column:
    """Percent; a pair of zeros counts as a perfect forecast."""
    scale = F.abs(y) + F.abs(f)
    return 100.0 * F.avg(F.when(scale > EPS, 2.0 * F.abs(f - y) / scale)
                         .when(scale.isNotNull(), F.lit(0.0)))


def relative(value: Column, normaliser: Column) -> Column:
    """Null where the normaliser is degenerate."""
    return F.when(normaliser > EPS, value / normaliser)


def metric_set(y: Column, f: Column, rated: Column | None = None) -> dict[str, Column]:
    """All point metrics; ``rated`` is constant within a group."""
    out = {
        "n": F.count(f - y), "mae": mae(y, f), "mse": mse(y, f), "rmse": rmse(y, f),
        "r2": r2(y, f), "smape": smape(y, f), "bias": bias(y, f),
        "peak_error": peak_error(y, f),
        "nrmse_mean": relative(rmse(y, f), F.avg(F.when(f.isNotNull(), F.abs(y)))),
    }
    if rated is not None:
        out["nrmse_capacity"] = relative(rmse(y, f), F.max(rated))
    return out


def reference_set(y: Column, f: Column, ref: Column, name: str) -> dict[str, Column]:
    """Reference scores and skill on the rows of the model; dropped as a whole when
    any of those rows lacks the reference."""
    complete = F.count_if((f - y).isNotNull() & ref.isNull()) == 0
    scored = F.when(f.isNotNull(), ref)
    ref_rmse, ref_mae = F.when(complete, rmse(y, scored)), F.when(complete, mae(y, scored))
    return {
        f"{name}_rmse": ref_rmse, f"{name}_mae": ref_mae,
        f"skill_vs_{name}_rmse": skill(ref_rmse, rmse(y, f)),
        f"skill_vs_{name}_mae": skill(ref_mae, mae(y, f)),
    }
