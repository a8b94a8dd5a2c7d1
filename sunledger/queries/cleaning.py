"""Gaps, imputation, outlier repair, solar geometry and clear-sky scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import clean, gaps, sky
from ..plans.chunks import densify
from .base import TABLES, Given, query

RUNS = """
    SELECT site, anchor, count(*) AS length FROM (
        SELECT site, step, pv_power_w, max(CASE WHEN pv_power_w IS NOT NULL THEN step END) OVER (
                 PARTITION BY site ORDER BY step ROWS UNBOUNDED PRECEDING) AS anchor FROM gappy)
    WHERE pv_power_w IS NULL GROUP BY site, anchor"""


@query("missingness", f"""
    SELECT site, n_rows, n_missing, coalesce(n_gaps, 0) AS n_gaps, coalesce(longest_gap, 0) AS longest_gap,
           coalesce(mean_gap_length, 0.0) AS mean_gap_length, coalesce(n_lengths, 0) AS n_lengths,
           n_missing / n_rows AS missing_fraction
    FROM (SELECT site, count(*) AS n_rows, count(*) FILTER (pv_power_w IS NULL) AS n_missing
          FROM gappy GROUP BY site)
    LEFT JOIN (SELECT site, count(*) AS n_gaps, max(length) AS longest_gap, avg(length) AS mean_gap_length,
                      count(DISTINCT length) AS n_lengths FROM ({RUNS}) GROUP BY site) USING (site)
    """, doubles="mean_gap_length missing_fraction")
def missingness(g: Given):
    return gaps.missingness(g.gappy(), "pv_power_w")


@query("gap_histogram", f"SELECT site, length, count(*) AS n_gaps FROM ({RUNS}) GROUP BY site, length")
def gap_histogram(g: Given):
    return gaps.gap_histogram(g.gappy(), "pv_power_w")


@query("gap_length_map", f"""
    SELECT site, sum(n) AS n_gaps, count(*) AS n_lengths,
           string_agg(length || ':' || n, ',' ORDER BY length) AS histogram
    FROM (SELECT site, length, count(*) AS n FROM ({RUNS}) GROUP BY site, length) GROUP BY site
    """, ints="n_gaps")
def gap_length_map(g: Given):
    mapped = gaps.gap_length_map(gaps.gap_histogram(g.gappy(), "pv_power_w"))
    entries = F.transform(F.map_entries("histogram"), lambda e: F.concat_ws(
        ":", e["key"].cast("string"), e["value"].cast("string")))
    return mapped.withColumn("histogram", F.concat_ws(",", entries))


def _anchored(source: str, column: str, block: str) -> str:
    last, nxt = "ROWS UNBOUNDED PRECEDING", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    w = f"PARTITION BY {block} ORDER BY step"
    at = f"CASE WHEN {column} IS NOT NULL THEN step END"
    return f"""
        SELECT *, last_value({column} IGNORE NULLS) OVER ({w} {last}) AS pv,
               last_value({at} IGNORE NULLS) OVER ({w} {last}) AS pt,
               first_value({column} IGNORE NULLS) OVER ({w} {nxt}) AS nv,
               first_value({at} IGNORE NULLS) OVER ({w} {nxt}) AS nt
        FROM {source}"""


def _line(limit: int, both: str, column: str = "pv_power_w") -> str:
    return f"""coalesce({column}, CASE WHEN pt IS NOT NULL AND nt IS NOT NULL
        AND (step - pt <= {limit} OR ({both} AND nt - step <= {limit}))
        THEN pv + (nv - pv) * (step - pt) / (nt - pt) END)"""


@query("interpolate_forward", f"""
    SELECT site, step, {_line(4, 'false')} AS filled FROM ({_anchored('gappy', 'pv_power_w', 'site')})
    """, doubles="filled")
def interpolate_forward(g: Given):
    return gaps.interpolate(g.gappy(), "pv_power_w", "filled", 4).select("site", "step", "filled")


@query("interpolate_both", f"""
    SELECT site, step, {_line(2, 'true')} AS filled FROM ({_anchored('gappy', 'pv_power_w', 'site')})
    """, doubles="filled")
def interpolate_both(g: Given):
    return gaps.interpolate(g.gappy(), "pv_power_w", "filled", 2, both=True).select(
        "site", "step", "filled")


@query("interpolate_causal", f"""
    SELECT site, step, coalesce(pv_power_w, CASE WHEN step - pt <= 4 THEN pv END) AS filled
    FROM ({_anchored('gappy', 'pv_power_w', 'site')})""", doubles="filled")
def interpolate_causal(g: Given):
    return gaps.interpolate(g.gappy(), "pv_power_w", "filled", 4, causal=True).select(
        "site", "step", "filled")


def _held(limit: int, both: str, column: str) -> str:
    return f"""coalesce({_line(limit, both, column)}, CASE
        WHEN nt IS NOT NULL AND step - pt <= 2 * {limit} THEN pv + (nv - pv) * {limit} / (nt - pt)
        WHEN nt IS NULL AND step - pt <= {limit} THEN pv END)"""


@query("fill_weather", f"""
    SELECT site, step, coalesce(h, m) AS pv_power_w
    FROM (SELECT site, step, {_held(2, 'true', 'pv_power_w')} AS h
          FROM ({_anchored('gappy', 'pv_power_w', 'site')}))
    JOIN (SELECT site, quantile_cont(h, 0.5) AS m FROM (
            SELECT site, {_held(2, 'true', 'pv_power_w')} AS h
            FROM ({_anchored('gappy', 'pv_power_w', 'site')})) GROUP BY site) USING (site)
    """, doubles="pv_power_w")
def fill_weather(g: Given):
    return gaps.fill_weather(g.gappy(), ["pv_power_w"], limit=2, stage=g.keep)


TABLES["merged"] = """
    SELECT p.site, p.step, p.pv_power_w, w.v AS ghi,
           make_timestamp(p.step * 900000000) <= TIMESTAMP '2024-01-18 23:45:00' AS train
    FROM gappy p LEFT JOIN (SELECT site, step, max(value) AS v FROM readings WHERE value > 30
                            GROUP BY site, step) w USING (site, step)"""
MERGED_LINE = _anchored("merged", "pv_power_w", "site, train")
MERGED_HELD = f"""SELECT site, step, train, {_held(8, 'train', 'ghi')} AS h
    FROM ({_anchored('merged', 'ghi', 'site, train')})"""


def _merged(g: Given):
    weather = g.readings().where("value > 30").groupBy("site", "step").agg(
        F.max("value").alias("ghi"))
    return g.gappy().join(weather, ["site", "step"], "left")


def _train():
    return clock.instant(F.col("step")) <= F.lit("2024-01-18 23:45:00").cast("timestamp")


def _impute_sql(target: str) -> str:
    return f"""
    SELECT t.site, t.step, t.pv_power_w, t.imputed, coalesce(h, m) AS ghi
    FROM (SELECT site, step, f AS pv_power_w, o IS NULL AND f IS NOT NULL AS imputed
          FROM (SELECT site, step, pv_power_w AS o, {target} AS f FROM ({MERGED_LINE}))) t
    JOIN ({MERGED_HELD}) USING (site, step)
    JOIN (SELECT site, train, quantile_cont(h, 0.5) AS m FROM ({MERGED_HELD}) GROUP BY site, train)
      USING (site, train)"""


@query("impute_reference", _impute_sql(_line(4, "train")), doubles="pv_power_w ghi")
def impute_reference(g: Given):
    return gaps.impute(_merged(g), "pv_power_w", ["ghi"], _train(), stage=g.keep)


@query("impute_causal", _impute_sql(
    f"CASE WHEN train THEN {_line(4, 'true')} ELSE coalesce(pv_power_w, CASE WHEN step - pt <= 4 THEN pv END) END"),
    doubles="pv_power_w ghi")
def impute_causal(g: Given):
    return gaps.impute(_merged(g), "pv_power_w", ["ghi"], _train(), causal=True,
                       stage=g.keep)


BOUNDS = """
    SELECT *, med + 6 * 1.4826 * mad AS upper_bound, med - 6 * 1.4826 * mad AS lower_bound
    FROM (SELECT *, CASE WHEN count(away) OVER c >= 5 THEN quantile_cont(away, 0.5) OVER c END AS mad
          FROM (SELECT *, abs(v - med) AS away
                FROM (SELECT *, CASE WHEN count(v) OVER c >= 5 THEN quantile_cont(v, 0.5) OVER c END AS med
                      FROM {source}
                      WINDOW c AS (PARTITION BY site ORDER BY step ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)))
          WINDOW c AS (PARTITION BY site ORDER BY step ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))"""


@query("robust_bounds", f"""
    SELECT site, step, med AS rolling_median, upper_bound, lower_bound
    FROM ({BOUNDS.format(source='(SELECT site, step, pv_power_w AS v FROM gappy)')})
    """, doubles="rolling_median upper_bound lower_bound", digits=8)
def robust_bounds(g: Given):
    return clean.robust_bounds(g.gappy(), "pv_power_w").drop("pv_power_w")


CLEANED = f"""
    SELECT *, CASE WHEN night_zeroed THEN 0.0 ELSE v3 END AS ghi_clean
    FROM (SELECT *, coalesce(solar_elevation <= 0 AND v3 > 0, false) AS night_zeroed
    FROM (SELECT *, CASE WHEN clipped_high THEN 1200.0 WHEN raised_low THEN 0.0 ELSE v2 END AS v3
    FROM (SELECT *, coalesce(v2 > 1200, false) AS clipped_high, coalesce(v2 < 0, false) AS raised_low
    FROM (SELECT *, CASE WHEN is_spike THEN med ELSE v1 END AS v2
    FROM (SELECT *, coalesce(v1 > upper_bound AND v1 > 1.8 * med, false) AS is_spike
    FROM (SELECT *, CASE WHEN out_of_envelope THEN med ELSE v END AS v1
    FROM (SELECT *, coalesce(v < 0 OR v > 1200, false) AS out_of_envelope
          FROM ({BOUNDS.format(source='irradiance')}))))))))"""
TABLES["irradiance"] = """
    SELECT site, step, 8 * pv_power_w - 20 AS v, solar_elevation
    FROM gappy JOIN solar USING (site, step)"""


def _cleaned(g: Given):
    rows = g.gappy().select("site", "step", (8 * F.col("pv_power_w") - 20).alias("ghi"))
    place = sky.add_solar(rows, g.stations())
    return clean.clean_irradiance(place.select("site", "step", "ghi", "solar_elevation"))


FLAGS = ["out_of_envelope", "is_spike", "clipped_high", "raised_low", "night_zeroed"]


@query("irradiance_cleaning", f"SELECT site, step, v AS ghi, {', '.join(FLAGS)}, ghi_clean FROM ({CLEANED})",
       doubles="ghi ghi_clean")
def irradiance_cleaning(g: Given):
    return _cleaned(g).select("site", "step", "ghi", *FLAGS, "ghi_clean")


@query("irradiance_summary", f"""
    SELECT site, count(*) AS n_input, count(*) FILTER (v IS NULL) AS n_input_missing,
           count(*) FILTER (out_of_envelope) AS n_envelope, count(*) FILTER (is_spike) AS n_spikes,
           count(*) FILTER (clipped_high) AS n_clipped_high, count(*) FILTER (raised_low) AS n_raised_low,
           count(*) FILTER (night_zeroed) AS n_night_zeroed, max(v) AS original_max,
           max(ghi_clean) AS cleaned_max, avg(v) AS original_mean, avg(ghi_clean) AS cleaned_mean,
           avg(v) FILTER (solar_elevation <= 0) AS night_bias_before,
           avg(ghi_clean) FILTER (solar_elevation <= 0) AS night_bias_after
    FROM ({CLEANED}) GROUP BY site""",
       doubles="original_max cleaned_max original_mean cleaned_mean night_bias_before night_bias_after")
def irradiance_summary(g: Given):
    return clean.irradiance_summary(_cleaned(g))


@query("target_summary", """
    SELECT site, count(*) AS n_rows, count(*) FILTER (v < 0) AS n_negative_clipped,
           max(greatest(v, 0)) AS observed_max_w, any_value(rated_w) AS rated_w,
           count(*) FILTER (v < 0) / count(*) AS fraction_negative,
           max(greatest(v, 0)) / any_value(rated_w) AS max_to_rated_ratio
    FROM (SELECT site, value - 1 AS v FROM readings) JOIN stations USING (site) GROUP BY site
    """, doubles="observed_max_w fraction_negative max_to_rated_ratio")
def target_summary(g: Given):
    shifted = g.readings().withColumn("value", F.col("value") - 1)
    return clean.target_summary(shifted, g.stations(), "value")


@query("flatlines", """
    SELECT site, step, same AND count(*) OVER (PARTITION BY site, island, same) >= 8 AS flatline
    FROM (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY site ORDER BY step) AS island
          FROM (SELECT site, step, coalesce(abs(v - lag(v) OVER (PARTITION BY site ORDER BY step)) <= 1e-9,
                                            false) AS same
                FROM (SELECT site, step, least(pv_power_w, 20) AS v FROM dense)))""")
def flatlines(g: Given):
    rows = g.dense().withColumn("pv_power_w", F.least("pv_power_w", F.lit(20.0)))
    return clean.flag_flatlines(rows, "pv_power_w").select("site", "step", "flatline")


@query("solar_position", """
    SELECT site, step, solar_elevation, solar_azimuth, solar_zenith,
           sin(radians(solar_elevation)) AS sin_solar_elevation,
           cos(radians(solar_elevation)) AS cos_solar_elevation, daylight, ghi_clear FROM clear""",
       doubles="solar_elevation solar_azimuth solar_zenith sin_solar_elevation cos_solar_elevation ghi_clear")
def solar_position(g: Given):
    return sky.add_solar(densify(g.telemetry().select("site", "step"), ["site"], "step"),
                         g.stations())


@query("daylight_mask", """
    SELECT site, count(*) AS n_steps, count(*) FILTER (daylight) AS n_daylight FROM clear GROUP BY site""")
def daylight_mask(g: Given):
    rows = densify(g.telemetry().select("site", "step"), ["site"], "step")
    return sky.add_solar(rows, g.stations()).groupBy("site").agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if("daylight").alias("n_daylight"))


@query("clear_sky_daily", """
    SELECT site, strftime(make_timestamp(step * 900000000), '%Y-%m-%d') AS date, max(ghi_clear) AS peak,
           sum(ghi_clear) / 4 AS energy FROM clear GROUP BY 1, 2""", doubles="peak energy")
def clear_sky_daily(g: Given):
    rows = densify(g.telemetry().select("site", "step"), ["site"], "step")
    date = F.date_format(clock.instant(F.col("step")), "yyyy-MM-dd").alias("date")
    return sky.add_solar(rows, g.stations()).groupBy("site", date).agg(
        F.max("ghi_clear").alias("peak"), (F.sum("ghi_clear") / 4).alias("energy"))


@query("clearness", "SELECT site, step, ghi, clear_sky_index_raw FROM sunny",
       doubles="ghi clear_sky_index_raw")
def clearness(g: Given):
    return g.sunny().select("site", "step", "ghi", "clear_sky_index_raw")


@query("clear_sky_scale", """
    SELECT s.site, scale, n_usable, n_usable < 100 AS under_sampled, coalesce(p99, 0) <= 1e-6 AS is_default_scale,
           n_usable >= 100 AND p99 BETWEEN 0.95 AND 1.05 AS calibrated,
           p50 AS kt_p50, p90 AS kt_p90, p99 AS kt_p99, top AS kt_max, above AS fraction_above_1p2
    FROM scales s JOIN (
        SELECT site, quantile_cont(k, 0.5) AS p50, quantile_cont(k, 0.9) AS p90, quantile_cont(k, 0.99) AS p99,
               max(k) AS top, avg((k > 1.2)::INT) AS above
        FROM (SELECT site, CASE WHEN split = 'train' AND daylight THEN clear_sky_index_raw END AS k FROM sunny)
        GROUP BY site) USING (site)""",
       doubles="scale kt_p50 kt_p90 kt_p99 kt_max fraction_above_1p2")
def clear_sky_scale(g: Given):
    return sky.clear_sky_scale(g.staged("sunny", g.sunny), F.col("split") == "train")


@query("clear_sky_index", "SELECT site, step, clear_sky_index FROM sky", doubles="clear_sky_index")
def clear_sky_index(g: Given):
    rows = g.staged("sunny", g.sunny)
    scales = sky.clear_sky_scale(rows, F.col("split") == "train")
    return sky.apply_scale(rows, scales).select("site", "step", "clear_sky_index")


@query("year_progress", """
    SELECT l_returnflag AS site, count(*) AS n_rows,
           avg((dayofyear(l_shipdate) - 1) / CASE WHEN year(l_shipdate) % 4 = 0 AND
               (year(l_shipdate) % 100 <> 0 OR year(l_shipdate) % 400 = 0) THEN 366.0 ELSE 365.0 END) AS progress
    FROM lineitem GROUP BY 1""", doubles="progress")
def year_progress(g: Given):
    rows = g.table("lineitem").select(F.col("l_returnflag").alias("site"),
                                      clock.year_progress(F.col("l_shipdate")).alias("p"))
    return rows.groupBy("site").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("p").alias("progress"))


@query("daylight_summary", """
    SELECT site, sum(lit) / sum(n) AS daylight_fraction, avg(lit) AS mean_daylight_steps_per_day,
           min(low) AS elevation_min, max(high) AS elevation_max, sum(total) / sum(lit) AS mean_elevation_daylight,
           avg(first_h) AS first_sun_hour, avg(last_h) AS last_sun_hour
    FROM (SELECT site, make_timestamp(step * 900000000)::DATE AS day, count(*) AS n,
            count(*) FILTER (daylight) AS lit, min(solar_elevation) AS low, max(solar_elevation) AS high,
            sum(solar_elevation) FILTER (daylight) AS total,
            min(hour(make_timestamp(step * 900000000))) FILTER (daylight) AS first_h,
            max(hour(make_timestamp(step * 900000000))) FILTER (daylight) AS last_h
          FROM clear GROUP BY 1, 2) GROUP BY site""",
       doubles="daylight_fraction mean_daylight_steps_per_day elevation_min elevation_max "
               "mean_elevation_daylight first_sun_hour last_sun_hour")
def daylight_summary(g: Given):
    return sky.daylight_summary(g.sky().select("site", "step", "solar_elevation", "daylight"))
