"""Small statistical expressions Spark has no built-in for."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..schema import EPS, T_CRITICAL_975


def two_sided_p(z: Column) -> Column:
    """Probability of a standard normal beyond |z| on either side.

    Below 2.8 the sum of the rising series of the error function, beyond that the continued
    fraction of the tail itself, so that small probabilities keep their digits.
    """
    size = F.abs(z.cast("double"))
    half = size * size / 2.0
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * 2.0 * half / (2.0 * k + 1.0)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, add, lambda acc: acc["sum"])
    near = 1.0 - size * math.sqrt(2.0 / math.pi) * F.exp(-half) * series
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1)), size,
                           lambda acc, k: size + k / acc)
    far = math.sqrt(2.0 / math.pi) * F.exp(-half) / fraction
    return F.when(size < 2.8, near).when(size >= 2.8, far)


def t_critical(degrees: Column) -> Column:
    """Two-sided 95% Student t; beyond the table its Cornish-Fisher expansion."""
    z = 1.959963984540054
    d = degrees.cast("double")
    tail = (z + (z**3 + z) / (4 * d) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * d * d)
            + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * d * d * d))
    table = F.array(*[F.lit(v) for v in T_CRITICAL_975.values()])
    return (F.when(degrees < 1, F.lit(0.0))
            .when(degrees <= len(T_CRITICAL_975), F.get(table, (degrees - 1).cast("int")))
            .otherwise(tail))


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness of a group (null below three values)."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis of a group (null below four values)."""
    n = F.count(value).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(value) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def skill(reference: Column, model: Column) -> Column:
    """1 - model/reference; null where the reference is degenerate."""
    return F.when(reference > EPS, 1.0 - model / reference)
