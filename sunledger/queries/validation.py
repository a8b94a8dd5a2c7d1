"""Validation and description of raw and gridded readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import supervise, validate
from ..plans.chunks import densify
from ..sources.raw import parse_time
from .base import PRIMARY, Given, query

STYLES = ["yyyy-MM-dd HH:mm:ss", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy-MM-dd HH:mm",
          "yyyy/MM/dd HH:mm:ss.SSSSSS", "'day' D 'of' yyyy"]


@query("timestamp_parse", """
    SELECT style, count(*) AS n_rows,
           count(*) FILTER (style < 5) AS n_parsed,
           count(*) FILTER (style IN (0, 1, 4) OR (style IN (2, 3) AND second(ts) = 0)) AS n_exact
    FROM (SELECT date_trunc('second', ts) AS ts, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1
            WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE CASE WHEN value < 50 THEN 4 ELSE 5 END END AS style
          FROM events)
    GROUP BY style""", ints="style")
def timestamp_parse(g: Given):
    kind, at = F.col("event_type"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    style = (F.when(kind == "click", 0).when(kind == "error", 1).when(kind == "purchase", 2)
             .when(kind == "signup", 3).when(F.col("value") < 50, 4).otherwise(5))
    text = F.lit(None).cast("string")
    for i, pattern in enumerate(STYLES):
        text = F.when(F.col("style") == i, F.date_format("at", pattern)).otherwise(text)
    rows = g.table("events").select(style.alias("style"), at.alias("at"))
    parsed = rows.withColumn("parsed", parse_time(text))
    return parsed.groupBy("style").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("parsed").alias("n_parsed"),
        F.count_if(F.col("parsed") == F.col("at")).alias("n_exact"))


def _raw_power(g: Given):
    """Raw text readings with the faults a logger makes."""
    value = F.col("value")
    text = (F.when(value < 1, F.col("props")).when(value > 300, F.lit(None).cast("string"))
            .when(value < 2, F.concat(F.lit("-"), value.cast("string")))
            .when(value < 3, F.lit("0")).otherwise(value.cast("string")))
    time = F.when(value.between(20, 20.5), F.lit(None)).otherwise(F.col("ts"))
    return g.table("events").select(F.col("event_type").alias("site"), time.alias("Time"),
                                    text.alias("power_text"))


RAW_POWER = """
    SELECT event_type AS site, CASE WHEN value BETWEEN 20 AND 20.5 THEN NULL ELSE ts END AS t,
           CASE WHEN value < 1 THEN 'text' WHEN value > 300 THEN 'absent' WHEN value < 2 THEN 'negative'
                WHEN value < 3 THEN 'zero' ELSE 'fine' END AS kind
    FROM events"""


@query("numeric_coercion", f"""
    SELECT site, count(*) AS n_rows, count(*) FILTER (kind = 'text') AS n_non_numeric
    FROM ({RAW_POWER}) GROUP BY site""")
def numeric_coercion(g: Given):
    return validate.coercion_losses(_raw_power(g), "power_text")


@query("duplicate_stamps", """
    SELECT site, count(*) AS n_stamps, count(*) FILTER (n > 1) AS n_duplicated_stamps,
           sum(n - 1) AS n_surplus_rows
    FROM (SELECT site, step, count(*) AS n FROM readings GROUP BY site, step) GROUP BY site
    """, ints="n_surplus_rows")
def duplicate_stamps(g: Given):
    return validate.duplicate_summary(g.readings())


@query("duplicates_averaged", "SELECT site, step, pv_power_w AS value FROM telemetry",
       doubles="value")
def duplicates_averaged(g: Given):
    return validate.average_duplicates(g.readings(), "value")


POWER_CHECKS = f"""
    SELECT site, count(*) AS n_rows, count(*) FILTER (t IS NULL) AS n_unparsed,
           count(*) FILTER (kind = 'text') AS n_non_numeric,
           count(*) FILTER (kind = 'negative') AS n_negative,
           count(*) FILTER (kind IN ('text', 'absent')) AS n_missing,
           count(*) FILTER (kind = 'zero') AS n_zero
    FROM ({RAW_POWER}) GROUP BY site"""


@query("power_checks", POWER_CHECKS)
def power_checks(g: Given):
    return validate.power_checks(_raw_power(g), "Time", "power_text")


ISSUES = f"""
    SELECT u.severity, 'schema/pv/' || site AS stage, u.check, u.message
    FROM ({POWER_CHECKS}) c, LATERAL (
        SELECT 'error' AS severity, 'timestamp_parse' AS check,
               printf('%d timestamps could not be parsed', n_unparsed) AS message, n_unparsed > 0 AS on_
        UNION ALL SELECT 'warning', 'non_numeric_values',
               printf('%d values were not numeric', n_non_numeric), n_non_numeric > 0
        UNION ALL SELECT 'warning', 'negative_power',
               printf('%d negative power readings', n_negative), n_negative > 0
        UNION ALL SELECT 'info', 'missing_target',
               printf('%.4f%% of target values are missing', 100 * n_missing / n_rows), true
        UNION ALL SELECT 'info', 'zero_fraction',
               printf('%.2f%% of readings are exactly zero', 100 * n_zero / n_rows), true) u
    WHERE on_"""


def _issues(g: Given):
    return validate.power_issues(validate.power_checks(_raw_power(g), "Time", "power_text"))


@query("power_issue_log", ISSUES)
def power_issue_log(g: Given):
    return _issues(g).drop("detail")


@query("issues_by_severity", f"""
    SELECT severity, count(*) AS n_issues FROM ({ISSUES}) GROUP BY severity""")
def issues_by_severity(g: Given):
    return validate.issues_by_severity(_issues(g))


WEATHER_CHECKS = """
    SELECT variable, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_missing,
           min(value) AS minimum, quantile_cont(value, 0.5) AS median, max(value) AS maximum,
           count(*) FILTER (value IS NULL) / count(*) AS missing_fraction,
           CASE WHEN min(value) IS NULL THEN 'all_invalid' ELSE 'range' END AS status
    FROM (SELECT 'value' AS variable, CASE WHEN value >= 1 THEN value END AS value FROM events
          UNION ALL SELECT 'user', user_id FROM events
          UNION ALL SELECT 'visibility', NULL FROM events)
    GROUP BY variable"""


@query("weather_checks", WEATHER_CHECKS, doubles="minimum median maximum missing_fraction")
def weather_checks(g: Given):
    value = F.when(F.col("value") >= 1, F.col("value"))
    readings = {"value": value, "user": F.col("user_id").cast("double"),
                "visibility": F.lit(None).cast("double")}
    long = g.table("events").select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("variable"), e.alias("value")) for n, e in readings.items()])))
    return validate.weather_checks(long)


@query("weather_issue_log", f"""
    SELECT 'schema/weather/' || variable AS stage, unnest(CASE
             WHEN status = 'all_invalid' THEN ['error', 'info'] WHEN n_missing > 0 THEN ['info', 'info'] ELSE ['info'] END)
             AS severity,
           unnest(CASE WHEN status = 'all_invalid' THEN ['all_invalid', 'missing_values']
             WHEN n_missing > 0 THEN ['missing_values', 'range'] ELSE ['range'] END) AS "check"
    FROM ({WEATHER_CHECKS})""")
def weather_issue_log(g: Given):
    return validate.weather_issues(weather_checks(g)).select("stage", "severity", "check")


@query("weather_absent", """
    SELECT * FROM (VALUES ('rainfall'), ('visibility')) v(variable)
    WHERE variable NOT IN (SELECT event_type FROM events)""")
def weather_absent(g: Given):
    long = g.readings().withColumnRenamed("site", "variable")
    return validate.absent_variables(long, ["click", "view", "rainfall", "visibility"])


SPACED = """
    SELECT site, step, step - lag(step) OVER (PARTITION BY site ORDER BY step) AS delta FROM telemetry"""


@query("spacing_checks", f"""
    SELECT site, arg_max(delta, (c, -delta)) AS modal_steps, sum(c) AS n_intervals,
           coalesce(sum(c) FILTER (delta <> 1), 0) AS n_irregular,
           arg_max(delta, (c, -delta)) <> 1 AS resolution_mismatch
    FROM (SELECT site, delta, count(*) AS c FROM ({SPACED}) WHERE delta IS NOT NULL GROUP BY site, delta)
    GROUP BY site""", ints="modal_steps n_intervals n_irregular")
def spacing_checks(g: Given):
    return validate.spacing_checks(g.telemetry())


@query("capacity_check", """
    SELECT site, max(value) AS observed_max_w, any_value(rated_w) AS rated_w,
           max(value) / any_value(rated_w) AS ratio,
           CASE WHEN max(value) / any_value(rated_w) > 1.25 THEN 'capacity_exceeded'
                WHEN max(value) / any_value(rated_w) < 0.35 THEN 'capacity_undershoot' ELSE 'ok' END AS status
    FROM readings LEFT JOIN stations USING (site) GROUP BY site""", doubles="observed_max_w ratio")
def capacity_check(g: Given):
    return validate.capacity_check(g.readings(), g.stations(), "value")


@query("coverage_summary", f"""
    SELECT site, count(*) AS n_observed, max(step) - min(step) + 1 AS n_expected,
           max(step) - min(step) + 1 - count(*) AS n_missing,
           (max(step) - min(step) + 1 - count(*)) / (max(step) - min(step) + 1) AS missing_fraction,
           min(step) AS first_step, max(step) AS last_step,
           coalesce(max(delta - 1), 0) AS largest_gap_steps
    FROM ({SPACED}) GROUP BY site""", doubles="missing_fraction")
def coverage_summary(g: Given):
    return validate.coverage_summary(g.telemetry())


@query("missing_stamps", """
    SELECT site, step FROM grid WHERE (site, step) NOT IN (SELECT site, step FROM telemetry)""")
def missing_stamps(g: Given):
    return validate.missing_stamps(g.telemetry())


@query("reindex_to_grid", "SELECT site, step, pv_power_w FROM gappy", doubles="pv_power_w")
def reindex_to_grid(g: Given):
    return densify(g.telemetry(), ["site"], "step")


@query("dataset_assertions", """
    SELECT site, u.assertion, u.passed, u.observed
    FROM (SELECT site, count(*) AS n, count(DISTINCT t::DATE) AS d, avg((pv_power_w = 0)::INT) AS z,
                 count(*) FILTER (ghi IS NULL OR temperature IS NULL) AS bad,
                 max(step) - min(step) + 1 AS span,
                 avg((clear_sky_index IS NULL)::INT) AS undefined
          FROM sky GROUP BY site) f, LATERAL (
        SELECT 'rows at least 1000' AS assertion, n >= 1000 AS passed, n AS observed
        UNION ALL SELECT 'distinct days at least 28', d >= 28, d
        UNION ALL SELECT 'zero fraction below 0.6', z < 0.6, z
        UNION ALL SELECT 'inputs are finite', bad = 0, bad
        UNION ALL SELECT 'grid has no missing step', n = span, span - n
        UNION ALL SELECT 'clearness undefined only part of the time', undefined < 0.9, undefined) u
    """, doubles="observed")
def dataset_assertions(g: Given):
    zero = F.avg((F.col("pv_power_w") == 0).cast("double"))
    facts = g.sky().groupBy("site").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.to_date(clock.instant(F.col("step")))).alias("d"), zero.alias("z"),
        F.count_if(F.col("ghi").isNull() | F.col("temperature").isNull()).alias("bad"),
        (F.max("step") - F.min("step") + 1).alias("span"),
        F.avg(F.col("clear_sky_index").isNull().cast("double")).alias("undefined"))
    c = F.col
    return validate.assertions(facts, ["site"], {
        "rows at least 1000": (c("n"), c("n") >= 1000),
        "distinct days at least 28": (c("d"), c("d") >= 28),
        "zero fraction below 0.6": (c("z"), c("z") < 0.6),
        "inputs are finite": (c("bad"), c("bad") == 0),
        "grid has no missing step": (c("span") - c("n"), c("span") == c("n")),
        "clearness undefined only part of the time": (c("undefined"), c("undefined") < 0.9)})


@query("numeric_summary", """
    SELECT site, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
           max(value) AS max, count(*) FILTER (value = 0) AS n_zero,
           count(*) FILTER (value < 0) AS n_negative,
           quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.05) AS p05,
           quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
           quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95,
           quantile_cont(value, 0.99) AS p99
    FROM readings GROUP BY site""", doubles="mean std min max p01 p05 p25 p50 p75 p95 p99")
def numeric_summary(g: Given):
    return validate.numeric_summary(g.readings(), "value")


@query("outlier_profile", """
    SELECT site, count(v) AS n, min(v) AS min, max(v) AS max, any_value(q1) AS q1,
           any_value(median) AS median, any_value(q3) AS q3, any_value(q3 - q1) AS iqr,
           any_value(q1 - 1.5 * (q3 - q1)) AS lower_fence, any_value(q3 + 1.5 * (q3 - q1)) AS upper_fence,
           count(*) FILTER (v > q3 + 1.5 * (q3 - q1)) AS n_above,
           count(*) FILTER (v < q1 - 1.5 * (q3 - q1)) AS n_below,
           skewness(v) AS skewness, kurtosis(v) AS kurtosis
    FROM (SELECT l_returnflag AS site, l_extendedprice AS v FROM lineitem)
    JOIN (SELECT l_returnflag AS site, quantile_cont(l_extendedprice, 0.25) AS q1,
                 quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
          FROM lineitem GROUP BY 1) USING (site)
    GROUP BY site""",
       doubles="min max q1 median q3 iqr lower_fence upper_fence skewness kurtosis")
def outlier_profile(g: Given):
    rows = g.table("lineitem").select(F.col("l_returnflag").alias("site"),
                                      F.col("l_extendedprice").alias("v"))
    return validate.outlier_profile(rows, "v")


@query("site_panel", """
    SELECT coalesce(k.site, p.site) AS site, p.rated_w, p.site IS NOT NULL AS metadata_found,
           coalesce(n_rows, 0) AS n_rows, first_step, last_step, coalesce(n_train, 0) AS n_train,
           coalesce(n_val, 0) AS n_val, coalesce(n_test, 0) AS n_test,
           CASE WHEN coalesce(k.site, p.site) = 'click' THEN 'primary' ELSE 'holdout' END AS role
    FROM (SELECT site, count(*) AS n_rows, min(step) AS first_step, max(step) AS last_step,
            count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
            count(*) FILTER (split = 'test') AS n_test FROM sky GROUP BY site) k
    FULL JOIN stations p ON p.site = k.site""")
def site_panel(g: Given):
    return validate.site_panel(g.sky().select("site", "step", "split"), g.stations(), PRIMARY)


@query("split_audit", """
    SELECT *, n_train / (n_rows - n_outside) AS fraction_train, n_val / (n_rows - n_outside) AS fraction_val,
           n_test / (n_rows - n_outside) AS fraction_test, val_first - train_last AS train_val_gap_steps,
           test_first - val_last AS val_test_gap_steps
    FROM (SELECT site, count(*) AS n_rows, count(*) FILTER (split IS NULL) AS n_outside,
            count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
            count(*) FILTER (split = 'test') AS n_test,
            min(step) FILTER (split = 'train') AS train_first, max(step) FILTER (split = 'train') AS train_last,
            min(step) FILTER (split = 'val') AS val_first, max(step) FILTER (split = 'val') AS val_last,
            min(step) FILTER (split = 'test') AS test_first, max(step) FILTER (split = 'test') AS test_last
          FROM sky GROUP BY site)""", doubles="fraction_train fraction_val fraction_test")
def split_audit(g: Given):
    return supervise.split_audit(g.sky().select("site", "step", "split"))
