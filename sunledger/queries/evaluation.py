"""Scores, strata, conformal intervals and diagnostic aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conformal, diagnostics, metrics, strata
from .base import TABLES, Given, query

E = "(predicted - actual)"


def _metrics(rated: str | None = None, f: str = "predicted") -> dict[str, str]:
    e = f"({f} - actual)"
    out = {
        "n": f"count({e})", "mae": f"avg(abs({e}))", "mse": f"avg({e} * {e})",
        "rmse": f"sqrt(avg({e} * {e}))",
        "r2": f"CASE WHEN var_pop(actual) * count(*) <= 1e-9 THEN 0.0 ELSE "
              f"1 - sum({e} * {e}) / (var_pop(actual) * count(*)) END",
        "smape": f"100 * avg(CASE WHEN abs(actual) + abs({f}) > 1e-9 "
                 f"THEN 2 * abs({e}) / (abs(actual) + abs({f})) ELSE 0 END)",
        "bias": f"avg({e})", "peak_error": f"max(abs({e}))",
        "nrmse_mean": f"CASE WHEN avg(abs(actual)) > 1e-9 THEN sqrt(avg({e} * {e})) / avg(abs(actual)) END",
    }
    if rated:
        out["nrmse_capacity"] = f"sqrt(avg({e} * {e})) / max({rated})"
    return out


def _select(parts: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in parts.items())


METRIC_NAMES = " ".join(k for k in _metrics("rated_w") if k != "n")
PLAIN_NAMES = " ".join(k for k in _metrics() if k != "n")


@query("point_metrics", f"SELECT site, {_select(_metrics())} FROM shipments GROUP BY site",
       doubles=PLAIN_NAMES, digits=4)
def point_metrics(g: Given):
    return metrics.compute_all(g.shipments(), ["site"])


@query("metric_set_by_run", f"""
    SELECT site, model, horizon, split, {_select(_metrics('rated_w'))}
    FROM forecasts WHERE split IS NOT NULL GROUP BY site, model, horizon, split""", doubles=METRIC_NAMES)
def metric_set_by_run(g: Given):
    return metrics.compute_all(g.predictions(None).where("split is not null"),
                               ["site", "model", "horizon", "split"], "rated_w")


def _against(name: str, column: str) -> dict[str, str]:
    rmse, mae = f"sqrt(avg(({column} - actual) ** 2))", f"avg(abs({column} - actual))"
    return {
        f"{name}_rmse": rmse, f"{name}_mae": mae,
        f"skill_vs_{name}_rmse": f"CASE WHEN {rmse} > 1e-9 THEN 1 - sqrt(avg({E} * {E})) / {rmse} END",
        f"skill_vs_{name}_mae": f"CASE WHEN {mae} > 1e-9 THEN 1 - avg(abs({E})) / {mae} END",
    }


SCORES = {**_metrics("rated_w"), **_against("persistence", "reference_persistence"),
          **_against("smart_persistence", "reference_smart_persistence")}


@query("forecast_scores", f"""
    SELECT site, model, horizon, scope, {_select(SCORES)}
    FROM predictions, LATERAL (SELECT 'all_steps' AS scope UNION ALL SELECT 'daylight' WHERE daylight)
    GROUP BY site, model, horizon, scope""", doubles=" ".join(k for k in SCORES if k != "n"))
def forecast_scores(g: Given):
    return metrics.score(g.predictions())


@query("skill_scores", f"""
    SELECT site, horizon, count(*) AS n,
           1 - sqrt(avg({E} * {E})) / sqrt(avg((reference - actual) ** 2)) AS skill_rmse,
           1 - avg(abs({E})) / avg(abs(reference - actual)) AS skill_mae
    FROM shipments GROUP BY site, horizon""", doubles="skill_rmse skill_mae")
def skill_scores(g: Given):
    from ..functions import scores, stats
    y, f, r = F.col("actual"), F.col("predicted"), F.col("reference")
    return g.shipments().groupBy("site", "horizon").agg(
        F.count(F.lit(1)).alias("n"),
        stats.skill(scores.rmse(y, r), scores.rmse(y, f)).alias("skill_rmse"),
        stats.skill(scores.mae(y, r), scores.mae(y, f)).alias("skill_mae"))


@query("error_frame", f"""
    SELECT site, row_id, {E} AS error, abs({E}) AS abs_error, {E} * {E} AS squared_error FROM shipments
    """, doubles="error abs_error squared_error", digits=3)
def error_frame(g: Given):
    return metrics.error_frame(g.shipments()).select("site", "row_id", "error", "abs_error",
                                                     "squared_error")


def _band(value: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {lo} AND {value} < {hi} THEN '{n}'"
                              for n, lo, hi in bands) + " END"


HOURS = [("Early morning (05-08)", 5, 8), ("Morning ramp (08-10)", 8, 10),
         ("Mid-morning (10-12)", 10, 12), ("Solar noon (12-14)", 12, 14),
         ("Afternoon (14-16)", 14, 16), ("Evening ramp (16-18)", 16, 18),
         ("Late evening (18-20)", 18, 20)]
LEVELS = [("0-10% of capacity", 0.0, 0.1), ("10-25% of capacity", 0.1, 0.25),
          ("25-50% of capacity", 0.25, 0.5), ("50-75% of capacity", 0.5, 0.75),
          ("75-100% of capacity", 0.75, 1.0001)]
TABLES["strata"] = f"""
    SELECT * EXCLUDE (season), upper(season[1]) || lower(season[2:]) AS season,
           {_band('hour(make_timestamp(step * 900000000))', HOURS)} AS time_of_day,
           {_band('actual / rated_w', LEVELS)} AS power_level,
           coalesce(abs(actual - lag(actual) OVER w) > 0.1 * max(abs(actual)) OVER (
               PARTITION BY site, model, horizon), false) AS ramping
    FROM predictions WINDOW w AS (PARTITION BY site, model, horizon ORDER BY step)"""


@query("strata_labels", """
    SELECT site, model, horizon, step, regime, season, time_of_day, power_level, ramping FROM strata""")
def strata_labels(g: Given):
    return strata.build_strata(g.predictions()).select(
        "site", "model", "horizon", "step", "regime", "season", "time_of_day", "power_level",
        "ramping")


@query("band_counts", f"""
    SELECT site, {_band('hour(ts)', HOURS)} AS time_of_day, {_band('value / 100.0', LEVELS)} AS power_level,
           count(*) AS n FROM readings GROUP BY 1, 2, 3""")
def band_counts(g: Given):
    from ..functions import bands
    return g.readings().groupBy(
        "site", bands.time_of_day(F.col("ts")).alias("time_of_day"),
        bands.power_level(F.col("value"), F.lit(100.0)).alias("power_level")).agg(
        F.count(F.lit(1)).alias("n"))


@query("seasonal_counts", """
    SELECT l_returnflag AS site, CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'Winter'
             WHEN month(l_shipdate) IN (3, 4, 5) THEN 'Spring' WHEN month(l_shipdate) IN (6, 7, 8) THEN 'Summer'
             ELSE 'Autumn' END AS season, count(*) AS n, avg(l_extendedprice) AS mean_price
    FROM lineitem GROUP BY 1, 2""", doubles="mean_price", digits=4)
def seasonal_counts(g: Given):
    from ..functions.clock import season
    return g.table("lineitem").groupBy(
        F.col("l_returnflag").alias("site"), season(F.col("l_shipdate")).alias("season")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean_price"))


@query("ramp_flags", """
    SELECT site, step, coalesce(abs(v - lag(v) OVER w) > 0.1 * max(abs(v)) OVER (PARTITION BY site), false)
             AS ramping
    FROM (SELECT site, step, pv_power_w AS v FROM dense) WINDOW w AS (PARTITION BY site ORDER BY step)""")
def ramp_flags(g: Given):
    return strata.add_ramp_flag(g.dense(), ["site"], "pv_power_w").select("site", "step", "ramping")


STRATA_METRICS = {
    **{k: v for k, v in _metrics("rated_w").items()
       if k in ("mae", "rmse", "nrmse_capacity", "r2", "smape", "bias")},
    "persistence_rmse": "sqrt(avg((reference_persistence - actual) ** 2))",
    "skill_vs_persistence_rmse": _against("persistence", "reference_persistence")[
        "skill_vs_persistence_rmse"]}


def stratified_sql(types: list[str], where: str = "daylight") -> str:
    long = " UNION ALL ".join(
        f"SELECT *, '{t}' AS stratum_type, {t}::VARCHAR AS stratum FROM strata WHERE {where}"
        for t in types)
    metrics = ", ".join(f"{e} AS {n}" for n, e in STRATA_METRICS.items())
    return f"""
    SELECT site, model, horizon, stratum_type, stratum, count(*) AS n, count(*) < 200 AS under_sampled,
           {metrics}
    FROM ({long}) WHERE stratum IS NOT NULL GROUP BY site, model, horizon, stratum_type, stratum"""


STRATA_DOUBLES = " ".join(STRATA_METRICS)


@query("stratified_metrics", stratified_sql(strata.STRATA), doubles=STRATA_DOUBLES)
def stratified_metrics(g: Given):
    return strata.stratified_table(strata.build_strata(g.predictions()))


@query("stratified_regimes", stratified_sql(["regime"]), doubles=STRATA_DOUBLES)
def stratified_regimes(g: Given):
    return strata.stratified_table(strata.build_strata(g.predictions()), ["regime"])


DAYS = 2
TABLES["calibrated"] = f"""
    SELECT *, step < min(step) OVER (PARTITION BY site, model, horizon) + {DAYS * 96} AS is_calibration
    FROM predictions"""
TABLES["widths"] = """
    SELECT site, model, horizon, alpha, min(r) AS q, min(n) AS n_calibration, min(nd) AS n_calibration_daylight
    FROM (SELECT site, model, horizon, abs(predicted - actual) AS r,
            row_number() OVER (PARTITION BY site, model, horizon ORDER BY abs(predicted - actual)) AS rn,
            count(*) OVER (PARTITION BY site, model, horizon) AS n,
            count(*) FILTER (daylight) OVER (PARTITION BY site, model, horizon) AS nd
          FROM calibrated WHERE is_calibration)
    CROSS JOIN (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) a(alpha)
    WHERE rn = least(ceil((n + 1) * (1.0::DOUBLE - alpha)), n)
    GROUP BY site, model, horizon, alpha"""
TABLES["intervals"] = """
    SELECT c.*, alpha, q AS interval_half_width_w, predicted - q AS lower, predicted + q AS upper,
           actual BETWEEN predicted - q AND predicted + q AS inside, n_calibration, n_calibration_daylight, few
    FROM calibrated c JOIN widths USING (site, model, horizon)
    JOIN (SELECT site, model, horizon, least(count(*) FILTER (is_calibration), count(*) FILTER (NOT is_calibration))
                   < 100 AS few FROM calibrated GROUP BY ALL) USING (site, model, horizon)
    WHERE NOT is_calibration"""


@query("conformal_widths", """
    SELECT site, alpha, min(r) AS interval_half_width_w
    FROM (SELECT site, abs(predicted - actual) AS r, count(*) OVER (PARTITION BY site) AS n,
                 row_number() OVER (PARTITION BY site ORDER BY abs(predicted - actual)) AS rn FROM shipments)
    CROSS JOIN (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) a(alpha)
    WHERE rn = least(ceil((n + 1) * (1.0::DOUBLE - alpha)), n) GROUP BY site, alpha""",
       doubles="interval_half_width_w")
def conformal_widths(g: Given):
    rows = g.shipments().withColumn("residual", F.abs(F.col("predicted") - F.col("actual")))
    return conformal.conformal_quantiles(rows, "residual", [0.05, 0.1, 0.2], ["site"])


@query("calibration_split", """
    SELECT site, model, horizon, is_calibration, count(*) AS n, min(step) AS first_step, max(step) AS last_step
    FROM calibrated GROUP BY site, model, horizon, is_calibration""")
def calibration_split(g: Given):
    return conformal.split_calibration(g.predictions(), DAYS).groupBy(
        "site", "model", "horizon", "is_calibration").agg(
        F.count(F.lit(1)).alias("n"), F.min("step").alias("first_step"),
        F.max("step").alias("last_step"))


@query("coverage_table", """
    SELECT site, model, horizon, alpha, scope, max(interval_half_width_w) AS interval_half_width_w,
           avg(inside::INT) AS empirical_coverage, count(*) AS n, max(n_calibration) AS n_calibration,
           max(n_calibration_daylight) AS n_calibration_daylight, bool_or(few) AS under_sampled, 1 - alpha AS nominal_coverage,
           avg(inside::INT) - (1 - alpha) AS coverage_error
    FROM intervals, LATERAL (SELECT 'evaluation_all_steps' AS scope
                             UNION ALL SELECT 'evaluation_daylight' WHERE daylight)
    GROUP BY site, model, horizon, alpha, scope""",
       doubles="interval_half_width_w empirical_coverage nominal_coverage coverage_error")
def coverage_table(g: Given):
    return conformal.coverage_table(g.predictions(), days=DAYS)


@query("interval_frame", """
    SELECT site, model, horizon, step, actual, predicted, lower, upper, inside FROM intervals
    WHERE alpha = 0.1""", doubles="actual predicted lower upper")
def interval_frame(g: Given):
    return conformal.interval_frame(g.predictions(), days=DAYS).select(
        "site", "model", "horizon", "step", "actual", "predicted", "lower", "upper", "inside")


DATE = "make_timestamp({} * 900000000)::DATE"


@query("daily_mae", f"""
    SELECT site, model, horizon, day_index, avg(abs({E})) AS mae, count(*) AS n
    FROM (SELECT *, {DATE.format('step')} - {DATE.format('min(step) OVER (PARTITION BY site, model, horizon)')}
            AS day_index FROM predictions)
    WHERE daylight AND day_index < 14 GROUP BY site, model, horizon, day_index""", doubles="mae", ints="day_index")
def daily_mae(g: Given):
    return diagnostics.daily_mae(g.predictions(), 14)


def _hist(source: str, value: str, keys: str, bins: int) -> str:
    return f"""
    SELECT {keys}, bin, count(*) AS n, any_value(lo) + bin * (any_value(hi) - any_value(lo)) / {bins} AS bin_low,
           count(*) / (any_value(n) * (any_value(hi) - any_value(lo)) / {bins}) AS density
    FROM (SELECT *, least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1})::BIGINT AS bin
          FROM (SELECT {keys}, {value} AS v, min({value}) OVER k AS lo, max({value}) OVER k AS hi,
                       count({value}) OVER k AS n FROM {source} WINDOW k AS (PARTITION BY {keys})))
    GROUP BY {keys}, bin"""


@query("residual_histogram", _hist("(SELECT * FROM predictions WHERE daylight)",
                                   f"{E} / rated_w", "site, model, horizon", 60),
       doubles="bin_low density")
def residual_histogram(g: Given):
    return diagnostics.residual_histogram(g.predictions())


@query("residual_bands", """
    SELECT site, bin, count(*) AS n, quantile_cont(e, 0.25) AS q25, quantile_cont(e, 0.5) AS median,
           quantile_cont(e, 0.75) AS q75
    FROM (SELECT site, predicted - actual AS e,
            least(floor((predicted - lo) / (hi - lo) * 15), 14)::BIGINT AS bin
          FROM (SELECT *, min(predicted) OVER (PARTITION BY site) AS lo,
                       max(predicted) OVER (PARTITION BY site) AS hi FROM shipments))
    GROUP BY site, bin""", doubles="q25 median q75")
def residual_bands(g: Given):
    rows = g.shipments().withColumn("daylight", F.lit(True))
    return diagnostics.residual_bands(rows, keys=["site"])


@query("monthly_coverage", """
    SELECT site, model, horizon, alpha, strftime(make_timestamp(step * 900000000), '%Y-%m') AS month,
           avg(inside::INT) AS coverage, count(*) AS n
    FROM intervals GROUP BY 1, 2, 3, 4, 5""", doubles="alpha coverage")
def monthly_coverage(g: Given):
    return diagnostics.monthly_coverage(conformal.interval_frame(
        g.predictions(), (0.1, 0.2), DAYS))


@query("daily_daylight_share", """
    SELECT site, strftime(t, '%Y-%m-%d') AS date, avg(daylight::INT) AS daylight_share FROM sky
    GROUP BY 1, 2""", doubles="daylight_share")
def daily_daylight_share(g: Given):
    return diagnostics.daily_daylight_share(g.sky())


@query("generation_histogram", _hist("(SELECT * FROM sky WHERE daylight)", "pv_power_w", "site", 80),
       doubles="bin_low density")
def generation_histogram(g: Given):
    return diagnostics.generation_histogram(g.sky())
