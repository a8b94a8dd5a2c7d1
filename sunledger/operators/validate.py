"""Validation checks, coverage summaries and descriptive profiles per series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import sample_kurtosis, sample_skewness
from ..plans.chunks import carry, dense_grid
from ..plans.ranks import quantiles
from ..plans.summaries import sized
from ..schema import CAPACITY_HIGH, CAPACITY_LOW

SITE = ["site"]
ISSUE_COLUMNS = ["severity", "stage", "check", "message", "detail"]
SUMMARY_SHARES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75,
                  "p95": 0.95, "p99": 0.99}


def numeric(raw: Column) -> Column:
    """Number or null; NaN counts as missing."""
    value = raw.try_cast("double")
    return F.when(~F.isnan(value), value)


def coercion_losses(df: DataFrame, column: str, keys: Sequence[str] = SITE) -> DataFrame:
    """Values that were present but did not parse as numbers."""
    lost = F.col(column).isNotNull() & numeric(F.col(column)).isNull()
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(lost).alias("n_non_numeric"))


def average_duplicates(df: DataFrame, value: str, keys: Sequence[str] = SITE,
                       order: str = "step") -> DataFrame:
    return df.groupBy(*keys, order).agg(F.avg(value).alias(value))


def duplicate_summary(df: DataFrame, keys: Sequence[str] = SITE,
                      order: str = "step") -> DataFrame:
    """Stamps that occur more than once and the surplus rows they bring."""
    per_stamp = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("_n"))
    return per_stamp.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_stamps"),
        F.count_if(F.col("_n") > 1).alias("n_duplicated_stamps"),
        F.sum(F.col("_n") - 1).alias("n_surplus_rows"))


def power_checks(df: DataFrame, time: str, raw: str, keys: Sequence[str] = SITE) -> DataFrame:
    """One row of counts per series from a raw power table."""
    value = numeric(F.col(raw))
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        n.alias("n_rows"),
        F.count_if(F.col(time).isNull()).alias("n_unparsed"),
        F.count_if(F.col(raw).isNotNull() & value.isNull()).alias("n_non_numeric"),
        F.count_if(value < 0).alias("n_negative"),
        F.count_if(value.isNull()).alias("n_missing"),
        F.count_if(value == 0).alias("n_zero"))


def _issue(severity: str, check: str, message: Column, when: Column,
           **detail: Column) -> Column:
    pairs = [part for k, v in detail.items() for part in (F.lit(k), v.cast("string"))]
    return F.when(when, F.struct(
        F.lit(severity).alias("severity"), F.lit(check).alias("check"),
        message.alias("message"), F.create_map(*pairs).alias("detail")))


def _as_log(df: DataFrame, stage: Column, issues: Sequence[Column]) -> DataFrame:
    rows = df.select(stage.alias("stage"), F.explode(F.array_compact(F.array(*issues))).alias("i"))
    return rows.select("i.severity", "stage", "i.check", "i.message", "i.detail")


def power_issues(checks: DataFrame, key: str = "site") -> DataFrame:
    """Issue log from :func:`power_checks`: errors, warnings and information rows."""
    n = F.col("n_rows")

    def share(name: str) -> Column:
        return F.col(name) / n

    def text(pattern: str, *columns: Column) -> Column:
        return F.format_string(pattern, *columns)

    return _as_log(checks, F.concat(F.lit("schema/pv/"), F.col(key)), [
        _issue("error", "empty_frame", F.lit("no rows"), n == 0, n_rows=n),
        _issue("error", "timestamp_parse", text("%d timestamps could not be parsed",
               F.col("n_unparsed")), F.col("n_unparsed") > 0, fraction=share("n_unparsed")),
        _issue("warning", "non_numeric_values", text("%d values were not numeric",
               F.col("n_non_numeric")), F.col("n_non_numeric") > 0,
               fraction=share("n_non_numeric")),
        _issue("warning", "negative_power", text("%d negative power readings",
               F.col("n_negative")), F.col("n_negative") > 0, fraction=share("n_negative")),
        _issue("info", "missing_target", text("%.4f%% of target values are missing",
               100 * share("n_missing")), n > 0, n_missing=F.col("n_missing"), n_rows=n),
        _issue("info", "zero_fraction", text("%.2f%% of readings are exactly zero",
               100 * share("n_zero")), n > 0, fraction=share("n_zero")),
    ])


def weather_checks(long: DataFrame, keys: Sequence[str] = ("variable",)) -> DataFrame:
    """Per variable: rows, missing share, min, median and max of the finite values.

    ``long`` holds one row per reading with a numeric or null ``value``.
    """
    counts = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    medians = quantiles(long, keys, "value", {"median": 0.5}).drop("n")
    return counts.join(medians, list(keys), "left").withColumns({
        "missing_fraction": F.col("n_missing") / F.col("n_rows"),
        "status": F.when(F.col("minimum").isNull(), "all_invalid").otherwise("range")})


def weather_issues(checks: DataFrame, key: str = "variable") -> DataFrame:
    """Issue log from :func:`weather_checks`."""
    some = F.col("status") != "all_invalid"
    return _as_log(checks, F.concat(F.lit("schema/weather/"), F.col(key)), [
        _issue("info", "missing_values", F.format_string("%.4f%% of the readings are unknown", 100 * F.col(
            "missing_fraction")), F.col("n_missing") > 0, fraction=F.col("missing_fraction")),
        _issue("error", "all_invalid", F.lit("not one reading is a number"), ~some, n_rows=F.col("n_rows")),
        _issue("info", "range", F.format_string("from %.3f over %.3f to %.3f", "minimum", "median", "maximum"), some,
               minimum=F.col("minimum"), median=F.col("median"), maximum=F.col("maximum")),
    ])


def absent_variables(long: DataFrame, declared: Sequence[str]) -> DataFrame:
    """Declared variables for which no reading exists."""
    spark = long.sparkSession
    names = spark.createDataFrame([(v,) for v in declared], "variable string")
    return names.join(long.select("variable").distinct(), "variable", "left_anti")


def spacing_checks(df: DataFrame, expected_steps: int = 1, keys: Sequence[str] = SITE,
                   order: str = "step") -> DataFrame:
    """Most frequent spacing (the smallest on a tie) and the count of other spacings."""
    spaced = _spacings(df, keys, order)
    per_delta = spaced.groupBy(*keys, "delta").agg(F.count(F.lit(1)).alias("c"))
    return per_delta.groupBy(*keys).agg(
        F.max_by("delta", F.struct(F.col("c"), -F.col("delta"))).alias("modal_steps"),
        F.sum("c").alias("n_intervals"),
        F.coalesce(F.sum(F.when(F.col("delta") != expected_steps, F.col("c"))), F.lit(0))
        .alias("n_irregular"),
    ).withColumn("resolution_mismatch", F.col("modal_steps") != expected_steps)


def _spacings(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Distance of every row to the row before it, however far back that is."""
    known = carry(df.select(*keys, order), keys, order, {"_before": F.col(order)}, strict=True)
    return (known.where(F.col("_before").isNotNull())
            .withColumn("delta", F.col(order) - F.col("_before")))


def capacity_check(df: DataFrame, stations: DataFrame, value: str = "pv_power_w",
                   keys: Sequence[str] = SITE) -> DataFrame:
    """Observed maximum against rated capacity."""
    peaks = df.groupBy(*keys).agg(F.max(value).alias("observed_max_w"))
    rated = stations.select(*keys, "rated_w")
    ratio = F.when(F.col("rated_w") > 0, F.col("observed_max_w") / F.col("rated_w"))
    return peaks.join(rated, list(keys), "left").withColumn("ratio", ratio).withColumn(
        "status", F.when(F.col("observed_max_w").isNull(), "all_invalid")
        .when(F.col("ratio").isNull(), "no_capacity")
        .when(F.col("ratio") > CAPACITY_HIGH, "capacity_exceeded")
        .when(F.col("ratio") < CAPACITY_LOW, "capacity_undershoot")
        .otherwise("ok"))


def missing_stamps(df: DataFrame, keys: Sequence[str] = SITE, order: str = "step") -> DataFrame:
    """Grid positions between the first and last row that have no row."""
    return dense_grid(df, keys, order).join(df.select(*keys, order), [*keys, order], "left_anti")


def coverage_summary(df: DataFrame, keys: Sequence[str] = SITE,
                     order: str = "step") -> DataFrame:
    """Observed and missing grid positions and the longest run of missing ones.

    A gap is bounded by two rows, so its length is the distance of neighbouring rows
    less one; no grid has to be built.
    """
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observed"),
        F.min(order).alias("first_step"), F.max(order).alias("last_step"))
    gaps = _spacings(df, keys, order).groupBy(*keys).agg(
        F.max(F.col("delta") - 1).alias("_gap"))
    expected = F.col("last_step") - F.col("first_step") + 1
    return counts.join(gaps, list(keys), "left").select(
        *keys, "n_observed", expected.alias("n_expected"),
        (expected - F.col("n_observed")).alias("n_missing"),
        ((expected - F.col("n_observed")) / expected).alias("missing_fraction"),
        "first_step", "last_step",
        F.coalesce("_gap", F.lit(0)).alias("largest_gap_steps"))


def issues_by_severity(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n_issues"))


def raise_on_errors(issues: DataFrame, show: int = 20) -> None:
    """Fail when any error-level issue exists."""
    errors = issues.where("severity = 'error'").select("stage", "check", "message")
    found = errors.take(show + 1)
    if found:
        more = errors.count() - show if len(found) > show else 0
        raise ValueError("validation failed: " + "; ".join(
            f"{r.stage}/{r.check}: {r.message}" for r in found[:show])
            + (f"; and {more} more" if more else ""))


def assertions(facts: DataFrame, keys: Sequence[str],
               claims: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Turn one row of facts per key into (name, passed, observed) rows.

    ``claims`` maps a name to the observed expression and the condition it must meet.
    """
    rows = [F.struct(F.lit(name).alias("assertion"), F.coalesce(ok, F.lit(False)).alias("passed"),
                     observed.cast("double").alias("observed"))
            for name, (observed, ok) in claims.items()]
    return facts.select(*keys, F.inline(F.array(*rows)))


def numeric_summary(df: DataFrame, value: str, keys: Sequence[str] = SITE) -> DataFrame:
    """Count, mean, sample deviation, exact percentiles and sign counts per key."""
    v = F.col(value)
    moments = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.count_if(v == 0).alias("n_zero"), F.count_if(v < 0).alias("n_negative"))
    return moments.join(quantiles(df, keys, value, SUMMARY_SHARES).drop("n"), list(keys), "left")


def outlier_profile(df: DataFrame, value: str, keys: Sequence[str] = SITE) -> DataFrame:
    """Quartiles, Tukey fences, rows beyond them, and bias-corrected shape measures."""
    v = F.col(value)
    fences = quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    fences = fences.withColumn("iqr", F.col("q3") - F.col("q1")).withColumns({
        "lower_fence": F.col("q1") - 1.5 * F.col("iqr"),
        "upper_fence": F.col("q3") + 1.5 * F.col("iqr")})
    constant = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"]
    return df.join(sized(fences), list(keys)).groupBy(*keys).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
        *[F.max(c).alias(c) for c in constant],
        F.count_if(v > F.col("upper_fence")).alias("n_above"),
        F.count_if(v < F.col("lower_fence")).alias("n_below"),
        sample_skewness(v).alias("skewness"), sample_kurtosis(v).alias("kurtosis"))


def site_panel(featured: DataFrame, stations: DataFrame, primary: str,
               order: str = "step") -> DataFrame:
    """Capacity, role, coverage and split sizes of each site; sites without a station row and stations
    without rows stay, and say so."""
    sizes = featured.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(order).alias("first_step"), F.max(order).alias("last_step"),
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")])
    rated = sized(stations.select("site", "rated_w"))
    both = sizes.join(rated, sizes["site"].eqNullSafe(rated["site"]), "full")
    site = F.coalesce(sizes["site"], rated["site"])
    return both.select(
        site.alias("site"), "rated_w", F.col("rated_w").isNotNull().alias("metadata_found"),
        *[F.coalesce(c, F.lit(0)).alias(c) if c.startswith("n_") else F.col(c) for c in sizes.columns[1:]],
        F.when(site == primary, "primary").otherwise("holdout").alias("role"))
