"""Rollups, joins, features, regimes, targets, scaling and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import features, inputs, regimes, resample, supervise
from ..plans.chunks import over_halo
from ..schema import INPUT_SETS, MODEL_INPUTS, ROLLING_WINDOWS, TARGET_LAGS
from .base import TABLES, Given, query

W = "PARTITION BY site ORDER BY step"
W2 = "PARTITION BY site, split ORDER BY step"


@query("rollup_mean", """
    SELECT event_type AS site, (epoch_us(ts) + 899999999) // 900000000 AS step, avg(value) AS value
    FROM events GROUP BY 1, 2""", doubles="value")
def rollup_mean(g: Given):
    return resample.rollup(g.table("events").withColumnRenamed("event_type", "site"), "ts",
                           ["value"], keys=["site"])


@query("rollup_sum_with_empty_bins", """
    SELECT m AS step, coalesce(v, 0.0) AS value, coalesce(u, 0) AS user_id
    FROM (SELECT unnest(range(lo, hi + 1)) AS m FROM (
            SELECT min((epoch_us(ts) + 59999999) // 60000000) AS lo,
                   max((epoch_us(ts) + 59999999) // 60000000) AS hi FROM events))
    LEFT JOIN (SELECT (epoch_us(ts) + 59999999) // 60000000 AS m, sum(value) AS v, sum(user_id) AS u
               FROM events GROUP BY 1) USING (m)""", doubles="value user_id")
def rollup_sum_with_empty_bins(g: Given):
    return resample.rollup(g.table("events"), "ts", ["value", "user_id"], "sum", seconds=60,
                           empty_bins=True)


@query("attach_weather", """
    SELECT t.site, t.step, t.pv_power_w, w.ghi, w.step IS NOT NULL AS has_weather
    FROM telemetry t LEFT JOIN (SELECT * FROM weather WHERE ghi > 40) w USING (step)
    """, doubles="pv_power_w ghi")
def attach_weather(g: Given):
    return resample.attach_weather(g.telemetry(), g.weather().where("ghi > 40").select(
        "step", "ghi"))


@query("weather_join_audit", """
    SELECT site, count(*) AS n_rows, count(*) FILTER (w.step IS NULL) AS n_without_weather,
           0::BIGINT AS n_multiplied
    FROM telemetry t LEFT JOIN (SELECT * FROM weather WHERE ghi > 40) w USING (step) GROUP BY site""")
def weather_join_audit(g: Given):
    joined = resample.attach_weather(g.telemetry(), g.weather().where("ghi > 40").select(
        "step", "ghi"))
    return resample.join_audit(joined)


SPARSE = """(SELECT * FROM predictions WHERE NOT (model = 'persistence' AND predicted > 100)
                                     AND NOT (model = 'linear_regression' AND actual < 5))"""


def _sparse(g: Given):
    model = F.col("model")
    return g.predictions().where(~((model == "persistence") & (F.col("predicted") > 100))
                                 & ~((model == "linear_regression") & (F.col("actual") < 5)))


@query("aligned_models", f"""
    SELECT site, horizon, model, count(*) AS n, sum(predicted) AS total
    FROM {SPARSE} WHERE (site, horizon, step) IN (
        SELECT (site, horizon, step) FROM {SPARSE} GROUP BY site, horizon, step HAVING count(DISTINCT model) = 3)
    GROUP BY site, horizon, model""", doubles="total", digits=4)
def aligned_models(g: Given):
    return resample.aligned_models(_sparse(g), 3).groupBy("site", "horizon", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("predicted").alias("total"))


@query("paired_forecasts", f"""
    SELECT a.site, a.model, a.horizon, count(*) AS n, avg(a.predicted - b.predicted) AS mean_difference
    FROM predictions a JOIN {SPARSE} b USING (site, model, horizon, step)
    GROUP BY a.site, a.model, a.horizon""", doubles="mean_difference")
def paired_forecasts(g: Given):
    pairs = resample.paired_forecasts(g.predictions(), _sparse(g))
    return pairs.groupBy("site", "model", "horizon").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("predicted") - F.col("predicted_other")).alias("mean_difference"))


@query("stacked_frames", """
    SELECT origin, count(*) AS n, count(pv_power_w) AS n_power, count(ghi) AS n_ghi, count(site) AS n_site
    FROM (SELECT 'power' AS origin, site, step, pv_power_w, NULL AS ghi FROM telemetry
          UNION ALL SELECT 'weather', NULL, step, NULL, ghi FROM weather) GROUP BY origin""")
def stacked_frames(g: Given):
    rows = resample.stack([
        g.telemetry().withColumn("origin", F.lit("power")),
        g.weather().select("step", "ghi").withColumn("origin", F.lit("weather"))])
    return rows.groupBy("origin").agg(
        F.count(F.lit(1)).alias("n"), F.count("pv_power_w").alias("n_power"),
        F.count("ghi").alias("n_ghi"), F.count("site").alias("n_site"))


@query("calendar_features", """
    SELECT event_id, hour(ts) AS hour, dayofyear(ts) AS dayofyear, year(ts) AS year, month(ts) AS month,
           day(ts) AS day, isodow(ts) - 1 AS dayofweek, isodow(ts) >= 6 AS is_weekend,
           hour(ts) + minute(ts) / 60.0 AS hours_since_midnight,
           sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24) AS hour_sin,
           cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24) AS hour_cos,
           sin(2 * pi() * dayofyear(ts) / 365.25) AS doy_sin, cos(2 * pi() * dayofyear(ts) / 365.25) AS doy_cos,
           minute(ts) AS minute
    FROM (SELECT event_id, make_timestamp((epoch_us(ts) + 899999999) // 900000000 * 900000000) AS ts
          FROM events)""", doubles="hours_since_midnight hour_sin hour_cos doy_sin doy_cos",
       ints="hour dayofyear year month day dayofweek minute")
def calendar_features(g: Given):
    rows = g.table("events").select("event_id", clock.bin_end(F.col("ts")).alias("step"))
    return rows.select("event_id", *[e.alias(n) for n, e in features.calendar().items()])


@query("solar_features", """
    SELECT site, step, solar_elevation, sin(radians(solar_elevation)) AS sin_solar_elevation,
           daylight, split FROM sky""", doubles="solar_elevation sin_solar_elevation")
def solar_features(g: Given):
    return g.sky().select("site", "step", "solar_elevation", "sin_solar_elevation", "daylight",
                          "split")


@query("weather_features", f"""
    SELECT site, step, pv_power_w, lag(ghi, 2) OVER ({W}) AS ghi,
           sin(radians(lag(temperature, 2) OVER ({W}))) AS wind_direction_sin,
           cos(radians(lag(temperature, 2) OVER ({W}))) AS wind_direction_cos
    FROM sky""", doubles="pv_power_w ghi wind_direction_sin wind_direction_cos")
def weather_features(g: Given):
    rows = g.sky().select("site", "step", "pv_power_w", "ghi", "wind_speed",
                          F.col("temperature").alias("wind_direction"))
    return features.weather_inputs(rows, ["ghi", "wind_direction"], lag_steps=2)


@query("target_lags", "SELECT site, step, " + ", ".join(
    f"lag(pv_power_w, {k}) OVER ({W}) AS pv_power_w_lag_{k}" for k in TARGET_LAGS) + " FROM dense",
    doubles=" ".join(f"pv_power_w_lag_{k}" for k in TARGET_LAGS))
def target_lags(g: Given):
    return over_halo(g.dense(), ["site"], "step", features.lags("pv_power_w", TARGET_LAGS),
                     before=96).drop("pv_power_w")


def _rolled(column: str, size: int, stat: str, name: str) -> str:
    fn = {"mean": "avg", "std": "stddev_pop", "max": "max", "min": "min"}[stat]
    w = f"OVER ({W} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) {w} = {size} THEN {fn}({column}) {w} END AS {name}"


ROLLED = [(w, s) for w in ROLLING_WINDOWS for s in ("mean", "std", "max", "min")]


@query("rolling_features", "SELECT site, step, " + ", ".join(
    _rolled("pv_power_w", w, s, f"pv_rolling_{s}_{w}") for w, s in ROLLED) + " FROM gappy",
    doubles=" ".join(f"pv_rolling_{s}_{w}" for w, s in ROLLED))
def rolling_features(g: Given):
    build = features.trailing("pv_power_w", ROLLING_WINDOWS, ("mean", "std", "max", "min"),
                              "pv_rolling_{stat}_{window}")
    return over_halo(g.gappy(), ["site"], "step", build, before=23).drop("pv_power_w")


@query("weather_rolling", "SELECT site, step, " + ", ".join(
    _rolled(c, w, "mean", f"{c}_rollmean_{w}") for c in ("ghi", "temperature") for w in (4, 24))
    + " FROM sky", doubles="ghi_rollmean_4 ghi_rollmean_24 temperature_rollmean_4 temperature_rollmean_24")
def weather_rolling(g: Given):
    rows = g.sky().select("site", "step", "ghi", "temperature")
    build = features.merged(*[features.trailing(c, [4, 24], ["mean"], c + "_rollmean_{window}")
                              for c in ("ghi", "temperature")])
    return over_halo(rows, ["site"], "step", build, before=23).drop("ghi", "temperature")


@query("irradiance_derivatives", f"""
    SELECT site, step, ghi - lag(ghi, 1) OVER w AS ghi_delta_1, ghi - lag(ghi, 1) OVER w AS ghi_slope_1,
           ghi - lag(ghi, 4) OVER w AS ghi_delta_4, (ghi - lag(ghi, 4) OVER w) / 4 AS ghi_slope_4
    FROM sky WINDOW w AS ({W})""", doubles="ghi_delta_1 ghi_slope_1 ghi_delta_4 ghi_slope_4")
def irradiance_derivatives(g: Given):
    return over_halo(g.sky().select("site", "step", "ghi"), ["site"], "step",
                     features.derivatives("ghi"), before=4).drop("ghi")


@query("clear_sky_input", """
    SELECT site, step, clear_sky_index, coalesce(clear_sky_index, 0.0) AS clear_sky_input FROM sky
    """, doubles="clear_sky_index clear_sky_input")
def clear_sky_input(g: Given):
    rows = g.sky().select("site", "step", "pv_power_w", "clear_sky_index")
    return features.build_features(rows).select("site", "step", "clear_sky_index",
                                                "clear_sky_input")


TABLES["featured"] = f"""
    SELECT s.*, {', '.join(f"lag(pv_power_w, {k}) OVER w AS pv_power_w_lag_{k}" for k in TARGET_LAGS)},
           {', '.join(_rolled('pv_power_w', w, s, f'pv_rolling_{s}_{w}') for w in ROLLING_WINDOWS for s in ('mean', 'std'))},
           {', '.join(_rolled(c, w, 'mean', f'{c}_rollmean_{w}') for c in ('ghi', 'temperature') for w in (4, 24))},
           ghi - lag(ghi, 1) OVER w AS ghi_delta_1, ghi - lag(ghi, 1) OVER w AS ghi_slope_1,
           ghi - lag(ghi, 4) OVER w AS ghi_delta_4, (ghi - lag(ghi, 4) OVER w) / 4 AS ghi_slope_4,
           sin(radians(solar_elevation)) AS sin_solar_elevation,
           sin(2 * pi() * (hour(t) + minute(t) / 60.0) / 24) AS hour_sin,
           cos(2 * pi() * (hour(t) + minute(t) / 60.0) / 24) AS hour_cos,
           sin(2 * pi() * dayofyear(t) / 365.25) AS doy_sin, cos(2 * pi() * dayofyear(t) / 365.25) AS doy_cos
    FROM sky s WINDOW w AS ({W})"""


@query("feature_table", f"""
    SELECT site, step, {', '.join(MODEL_INPUTS)} FROM featured""", doubles=" ".join(MODEL_INPUTS))
def feature_table(g: Given):
    return features.build_features(g.sky()).select("site", "step", *MODEL_INPUTS)


SPECS = [*INPUT_SETS, "minimal"]
CHOSEN = {s: inputs.select_inputs(MODEL_INPUTS, s) for s in SPECS}


@query("input_set_rows", f"""
    SELECT site, n_rows, unnest(sets, recursive := true)
    FROM (SELECT site, count(*) AS n_rows, [{', '.join(f"""{{'feature_spec': '{s}', 'n_inputs': {len(own)},
            'n_complete': count(*) FILTER (WHERE {' AND '.join(f'{c} IS NOT NULL' for c in own)})}}"""
                                               for s, own in CHOSEN.items())}] AS sets
          FROM featured GROUP BY site)""", ints="n_inputs")
def input_set_rows(g: Given):
    """What each input set keeps, and the rows that have all of it."""
    return inputs.complete_rows(features.build_features(g.sky()), ["site"], CHOSEN)


@query("warm_up_dropped", f"""
    SELECT site, count(*) AS n_rows, min(step) AS first_step,
           count(*) FILTER (pv_power_w_lag_96 IS NULL) AS n_incomplete, min(season) AS season,
           min(year(t)) AS year
    FROM (SELECT *, row_number() OVER ({W}) AS rn FROM featured) WHERE rn > 96 GROUP BY site""", ints="year")
def warm_up_dropped(g: Given):
    rows = features.build_features(g.sky().select("site", "step", "pv_power_w"))
    kept = features.drop_warm_up(rows.select("site", "step", "pv_power_w_lag_96"), 96)
    return kept.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("step").alias("first_step"),
        F.count_if(F.col("pv_power_w_lag_96").isNull()).alias("n_incomplete"),
        F.min("season").alias("season"), F.min("year").alias("year"))


@query("weather_regimes", "SELECT site, step, sigma_cv, regime FROM sky", doubles="sigma_cv")
def weather_regimes(g: Given):
    rows = g.sky().select("site", "step", "ghi", "solar_elevation", "clear_sky_input")
    return regimes.attach_regimes(rows, kt="clear_sky_input").select(
        "site", "step", "sigma_cv", "regime")


@query("regime_distribution", """
    SELECT site, regime, count(*) AS n, sum(count(*)) OVER (PARTITION BY site) AS n_total,
           count(*) / sum(count(*)) OVER (PARTITION BY site) AS share
    FROM sky WHERE regime <> 'Night' GROUP BY site, regime""", doubles="share", ints="n_total")
def regime_distribution(g: Given):
    return regimes.regime_distribution(g.sky())


@query("regime_distribution_all", """
    SELECT site, regime, count(*) AS n, sum(count(*)) OVER (PARTITION BY site) AS n_total,
           count(*) / sum(count(*)) OVER (PARTITION BY site) AS share
    FROM sky GROUP BY site, regime""", doubles="share", ints="n_total")
def regime_distribution_all(g: Given):
    return regimes.regime_distribution(g.sky(), daylight_only=False)


@query("supervised_targets", """
    SELECT o.site, o.step, horizon, h AS target_lead_steps, h * 0.25 AS target_lead_hours,
           l.pv_power_w AS target, l.daylight AS label_daylight, l.step AS target_step
    FROM sky o CROSS JOIN horizons
    JOIN sky l ON l.site = o.site AND l.step = o.step + h AND l.split = o.split""",
       doubles="target target_lead_hours", ints="target_lead_steps")
def supervised_targets(g: Given):
    rows = g.sky().where("split is not null").select("site", "split", "step", "pv_power_w",
                                                     "daylight")
    return supervise.build_target(rows, keys=["site", "split"], carry_columns=["daylight"]).select(
        "site", "step", "horizon", "target_lead_steps", "target_lead_hours", "target",
        "label_daylight", "target_step")


@query("causality_audit", """
    SELECT o.site, horizon, count(*) AS n_labels, 0::BIGINT AS n_not_after_origin,
           0::BIGINT AS n_mismatched
    FROM sky o CROSS JOIN horizons JOIN sky l ON l.site = o.site AND l.step = o.step + h
    GROUP BY o.site, horizon""")
def causality_audit(g: Given):
    rows = g.sky().select("site", "step", "pv_power_w")
    return supervise.causality_audit(supervise.build_target(rows), rows)


SCALED = ["pv_power_w", "ghi", "temperature", "solar_elevation"]


@query("scalers", " UNION ALL ".join(f"""
    SELECT site, '{c}' AS "column", avg({c}) AS mean, stddev_pop({c}) AS std, count({c}) AS n_known,
           count(*) AS n_rows, CASE WHEN count({c}) < count(*) THEN 'non_finite'
           WHEN coalesce(stddev_pop({c}), 0) <= 1e-9 THEN 'zero_variance' ELSE 'ok' END AS status
    FROM sky WHERE split = 'train' GROUP BY site""" for c in [*SCALED, "clear_sky_index", "rated_w"]),
       doubles="mean std")
def scalers(g: Given):
    return supervise.fit_scalers(g.sky().where("split = 'train'"),
                                 [*SCALED, "clear_sky_index", "rated_w"])


@query("scaled_inputs", f"""
    SELECT site, step, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in SCALED)}
    FROM sky JOIN (SELECT site, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in SCALED)}
                   FROM sky WHERE split = 'train' GROUP BY site) USING (site)""", doubles=" ".join(SCALED))
def scaled_inputs(g: Given):
    rows = g.sky().select("site", "step", "split", *SCALED)
    fitted = supervise.fit_scalers(rows.where("split = 'train'"), SCALED)
    return supervise.apply_scalers(rows.drop("split"), fitted, SCALED)


@query("scaling_inverted", f"SELECT site, step, {', '.join(SCALED)} FROM sky",
       doubles=" ".join(SCALED))
def scaling_inverted(g: Given):
    rows = g.sky().select("site", "step", "split", *SCALED)
    fitted = supervise.fit_scalers(rows.where("split = 'train'"), SCALED)
    there = supervise.apply_scalers(rows.drop("split"), fitted, SCALED)
    return supervise.apply_scalers(there, fitted, SCALED, invert=True)


def _origins(lost: int, stride: int) -> str:
    return f"""
    SELECT site, split, step, rn - 24 AS start_row, rn - 1 AS origin_row, rn - 1 + 4 AS label_row
    FROM (SELECT site, split, step, row_number() OVER (PARTITION BY site, split ORDER BY step) AS rn,
                 count(*) OVER (PARTITION BY site, split) AS n FROM sky WHERE split IS NOT NULL)
    WHERE rn >= 24 AND rn + {lost} <= n AND (rn - 24) % {stride} = 0"""


@query("window_origins", _origins(4, 3))
def window_origins(g: Given):
    rows = g.sky().where("split is not null")
    return supervise.window_origins(rows, 4, stride=3, keys=["site", "split"])


@query("window_counts_truncated", f"""
    SELECT site, split, count(*) AS n_windows FROM ({_origins(8, 1)}) GROUP BY site, split""")
def window_counts_truncated(g: Given):
    rows = g.sky().where("split is not null")
    return supervise.window_origins(rows, 4, keys=["site", "split"], truncated_target=True).groupBy(
        "site", "split").agg(F.count(F.lit(1)).alias("n_windows"))


@query("lookback_windows", f"""
    SELECT o.site, o.step, horizon, l.step AS target_step, l.pv_power_w AS target,
           l.regime AS label_regime, n AS n_steps, oldest, s AS window_sum
    FROM (SELECT *, count(*) OVER w AS n, first_value(pv_power_w) OVER w AS oldest,
                 sum(ghi) OVER w AS s FROM sky
          WINDOW w AS ({W2} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) o
    CROSS JOIN horizons JOIN sky l ON l.site = o.site AND l.split = o.split AND l.step = o.step + h
    WHERE n = 24""", doubles="target oldest window_sum", ints="n_steps")
def lookback_windows(g: Given):
    rows = g.sky().where("split IS NOT NULL").select("site", "split", "step", "pv_power_w", "ghi",
                                                     "regime")
    windows = supervise.build_windows(rows, ["pv_power_w", "ghi"], keys=["site", "split"],
                                      label_columns=["regime"])
    total = F.aggregate("window.ghi", F.lit(0.0), lambda a, v: a + v)
    return windows.select(
        "site", "step", "horizon", "target_step", "target", "label_regime",
        F.size("window").alias("n_steps"), F.col("window")[0]["pv_power_w"].alias("oldest"),
        total.alias("window_sum"))


@query("window_description", f"""
    SELECT o.site, horizon, count(*) AS n_samples, 24::BIGINT AS lookback_steps, min(o.step) AS first_origin,
           max(o.step) AS last_origin, min(l.step) AS first_target, max(l.step) AS last_target,
           avg(l.daylight::INT) AS daylight_fraction
    FROM (SELECT *, row_number() OVER ({W2}) AS rn FROM sky) o
    CROSS JOIN horizons JOIN sky l ON l.site = o.site AND l.split = o.split AND l.step = o.step + h
    WHERE rn >= 24 GROUP BY o.site, horizon""", doubles="daylight_fraction")
def window_description(g: Given):
    rows = g.sky().where("split IS NOT NULL").select("site", "split", "step", "pv_power_w",
                                                     "daylight")
    return supervise.describe_windows(supervise.build_windows(
        rows, ["pv_power_w"], keys=["site", "split"], label_columns=["daylight"]))


@query("flattened_windows", f"""
    SELECT site, step, lag(pv_power_w, 23) OVER w AS "pv_power_w@t-23", lag(ghi, 23) OVER w AS "ghi@t-23",
           pv_power_w AS "pv_power_w@t", ghi AS "ghi@t"
    FROM sky WHERE split IS NOT NULL WINDOW w AS ({W2}) QUALIFY row_number() OVER w >= 24""")
def flattened_windows(g: Given):
    rows = g.sky().where("split IS NOT NULL").select("site", "split", "step", "pv_power_w", "ghi")
    flat = supervise.flatten_windows(rows, ["pv_power_w", "ghi"], keys=["site", "split"])
    return flat.select("site", "step", *[F.col(f"`{c}`") for c in (
        "pv_power_w@t-23", "ghi@t-23", "pv_power_w@t", "ghi@t")])


