"""Readers and writers, driven by files that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators.supervise import fit_scalers
from ..session import scratch_path
from ..sources import raw, results
from .base import PANEL, Given, query

TIME_TEXT = "strftime(make_timestamp(step * 900000000), '%Y-%m-%d %H:%M:%S')"


@query("power_csv_scan", f"""
    SELECT site, {TIME_TEXT} AS time_text, pv_power_w FROM telemetry""", doubles="pv_power_w")
def power_csv_scan(g: Given):
    path = scratch_path(g.spark, "power")
    (g.readings().select("site", F.date_format(clock.instant(F.col("step")), "yyyy-MM-dd HH:mm:ss")
                         .alias("Time"), F.col("value").alias("power(W)"))
     .write.partitionBy("site").option("header", True).csv(path))
    series = raw.power_series(raw.scan_power_raw(g.spark, path))
    return series.select("site", F.date_format("Time", "yyyy-MM-dd HH:mm:ss").alias("time_text"),
                         "pv_power_w")


@query("station_panel_scan", """
    SELECT 'warning' AS severity, 'loader/station_missing' AS stage, 'station_missing' AS check,
           'station ' || r.site || ' could not be loaded' AS message
    FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('standby'), ('reserve'))
         r(site)
    WHERE r.site NOT IN (SELECT event_type FROM events)""")
def station_panel_scan(g: Given):
    return raw.station_issues(g.spark, [*PANEL, "standby", "reserve"], g.readings())


@query("weather_csv_scan", f"""
    SELECT {TIME_TEXT} AS time_text, ghi, temperature, wind_speed, relative_humidity AS wind_direction
    FROM weather""", doubles="ghi temperature wind_speed wind_direction")
def weather_csv_scan(g: Given):
    root = scratch_path(g.spark, "weather")
    time = F.date_format(clock.instant(F.col("step")), "y/M/d H:mm").alias("Time")
    for folder, columns in {"ghi": ["ghi"], "temperature": ["temperature"],
                            "wind": ["wind_speed", "relative_humidity"]}.items():
        g.weather().select(time, *columns).write.option("header", True).csv(f"{root}/{folder}")
    patterns = {"ghi": "ghi/*.csv", "temperature": "temperature/*.csv",
                "wind_speed": "wind/*.csv", "wind_direction": "wind/*.csv",
                "rainfall": "rainfall/*.csv"}
    wide = raw.weather_table(raw.scan_weather_raw(g.spark, root, patterns),
                             ["ghi", "temperature", "wind_speed", "wind_direction"])
    return wide.select(F.date_format("Time", "yyyy-MM-dd HH:mm:ss").alias("time_text"),
                       "ghi", "temperature", "wind_speed", "wind_direction")


@query("station_metadata_scan", """
    SELECT replace(s_name, '#', '_') AS brick_name,
           CASE WHEN s_acctbal > 0 THEN 22 + s_suppkey / 100000.0 END AS latitude,
           114 + s_nationkey / 100.0 AS longitude, s_nationkey * 10.0 AS altitude_m,
           'Block ' || s_nationkey AS location, '2020-01-01' AS connection_date,
           s_acctbal AS rated_kw, s_acctbal * 1000.0 AS rated_w
    FROM supplier""", doubles="latitude longitude altitude_m rated_kw rated_w")
def station_metadata_scan(g: Given):
    path = scratch_path(g.spark, "stations")
    latitude = F.when(F.col("s_acctbal") > 0, F.format_string(
        "  brick:latitude %.6f ;\n", 22 + F.col("s_suppkey") / 100000.0)).otherwise("")
    g.table("supplier").select(F.concat(
        F.lit("pvsystem:"), F.regexp_replace("s_name", "#", "_"),
        F.lit(" a brick:PV_Generation_System ;\n"), latitude,
        F.format_string("  brick:longitude %.4f ;\n", 114 + F.col("s_nationkey") / 100.0),
        F.format_string("  ext:altitude [ a ext:Height ;\n brick:value %.1f ] ;\n",
                        F.col("s_nationkey") * 10.0),
        F.format_string('  brick:hasLocation [ brick:value "Block %d" ] ;\n', "s_nationkey"),
        F.lit('  ext:connectionDate [ a ext:Date ;\n brick:value "2020-01-01" ] ;\n'),
        F.format_string("  ext:ratedPowerOutput [ brick:value %.2f ] .\n", "s_acctbal"),
    ).alias("value")).write.text(path)
    return raw.scan_stations(g.spark, path)


@query("station_lookup", """
    SELECT c_custkey, display AS site, n.n_name IS NOT NULL AS metadata_found, n.n_name AS brick_name,
           regexp_replace(regexp_replace(lower(display), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug
    FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Depot ' || c_nationkey
                                 ELSE 'Nation (' || c_nationkey || ')' END AS display FROM customer)
    LEFT JOIN nation n
      ON lower(regexp_replace(n.n_name, '[ _()]+', '', 'g')) = lower(regexp_replace(display, '[ _()]+', '', 'g'))
    """)
def station_lookup(g: Given):
    nation = F.col("c_nationkey").cast("string")
    names = g.table("customer").select("c_custkey", F.when(
        F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("Depot "), nation)).otherwise(
        F.concat(F.lit("Nation ("), nation, F.lit(")"))).alias("site"))
    stations = g.table("nation").select(F.col("n_name").alias("brick_name"))
    return raw.lookup_stations(names, stations).select(
        "c_custkey", "site", "metadata_found", "brick_name", "slug")


@query("prepared_tables", """
    SELECT site, split, count(*) AS n_rows, min(step) AS first_step, max(step) AS last_step,
           avg(pv_power_w) AS mean_power
    FROM sky WHERE split IS NOT NULL GROUP BY site, split""", doubles="mean_power")
def prepared_tables(g: Given):
    path = scratch_path(g.spark, "prepared")
    results.write_prepared(g.sky().where("split is not null"), path)
    return results.read_prepared(g.spark, path).groupBy("site", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("step").alias("first_step"),
        F.max("step").alias("last_step"), F.avg("pv_power_w").alias("mean_power"))


@query("prepared_reload", """
    SELECT site, 'pv_power_w' AS column, avg(pv_power_w) AS mean, stddev_pop(pv_power_w) AS std,
           count(*) AS n_rows FROM sky WHERE split = 'train' GROUP BY site
    UNION ALL
    SELECT site, 'ghi', avg(ghi), stddev_pop(ghi), count(*) FROM sky WHERE split = 'train' GROUP BY site
    """, doubles="mean std")
def prepared_reload(g: Given):
    path = scratch_path(g.spark, "prepared")
    results.write_prepared(g.sky().where("split is not null"), path)
    train = results.read_prepared(g.spark, path, split="train")
    return fit_scalers(train, ["pv_power_w", "ghi"]).select(
        "site", "column", "mean", "std", "n_rows")


@query("prediction_files", """
    SELECT model, horizon, CASE WHEN horizon = '1h' THEN 'B_ml_vs_dl' ELSE 'C_horizons' END
             AS experiment_group, count(*) AS n_rows, avg(predicted) AS mean_predicted
    FROM predictions GROUP BY model, horizon""", doubles="mean_predicted")
def prediction_files(g: Given):
    path = scratch_path(g.spark, "forecasts")
    rows = g.predictions().select("site", "step", "actual", "predicted", "model", "horizon")
    groups = F.when(F.col("horizon") == "1h", F.array(F.lit("B_ml_vs_dl"), F.lit("C_horizons"))
                    ).otherwise(F.array(F.lit("C_horizons")))
    (rows.withColumn("_group", F.explode(groups))
     .withColumn("run", F.concat_ws("__", "_group", "model", "horizon"))
     .drop("model", "horizon", "_group").write.partitionBy("run").parquet(path))
    return results.scan_predictions(g.spark, path, ["B_ml_vs_dl", "C_horizons"]).groupBy(
        "model", "horizon", "experiment_group").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("predicted").alias("mean_predicted"))


RECORD_COLUMNS = """experiment_id, experiment_group, model, horizon, feature_spec, seed, mae, rmse,
    rmse AS rmse_all_steps, n_test, train_seconds"""


def _record_folder(g: Given) -> str:
    """The run log as records in the study's layout, and each once more with its end cut off."""
    path, c = scratch_path(g.spark, "records"), F.col
    record = F.to_json(F.struct(
        F.struct("experiment_id", c("experiment_group").alias("group"), "model", "horizon",
                 c("feature_spec").alias("features"), "seed").alias("spec"),
        F.struct("mae", "rmse").alias("metrics_daylight"),
        F.struct("rmse").alias("metrics_all_steps"),
        F.struct(F.struct(c("n_test").alias("test")).alias("split_sizes"),
                 F.struct("train_seconds").alias("cost"),
                 F.struct("experiment_id").alias("own")).alias("metadata")))
    texts = g.registry().select(F.explode(F.array(
        record, F.substring(record, F.lit(1), F.length(record) - 9))).alias("value"))
    texts.write.text(path)
    return path


@query("run_records", f"""
    SELECT {RECORD_COLUMNS}, NULL::VARCHAR AS model_family, NULL::BIGINT AS n_parameters,
           NULL::VARCHAR AS test_end, 'f' AS config_fingerprint, experiment_id AS own
    FROM registry""", doubles="mae rmse rmse_all_steps train_seconds", ints="seed")
def run_records(g: Given):
    """``own`` is a field that the registry does not know."""
    rows = results.scan_run_records(g.spark, _record_folder(g), multi_line=False, fingerprint="f")
    return rows.select(
        "experiment_id", "experiment_group", "model", "horizon", "feature_spec", "seed", "mae", "rmse",
        "rmse_all_steps", "n_test", "train_seconds", "model_family", "n_parameters", "test_end",
        "config_fingerprint",
        F.try_variant_get("record", "$.metadata.own.experiment_id", "string").alias("own"))


@query("run_record_counts", """
    SELECT count(*) AS n_read, count(*) AS n_cut_off, 0::BIGINT AS n_unspecified FROM registry""")
def run_record_counts(g: Given):
    return results.record_counts(g.spark, _record_folder(g), multi_line=False)


@query("table_export", """
    SELECT site, step, true AS within_half_digit, true AS short_enough FROM telemetry""")
def table_export(g: Given):
    """Exported text lies within half a unit of its sixth significant digit."""
    path = scratch_path(g.spark, "table")
    results.write_table(g.telemetry(), path)
    text = g.spark.read.schema("site string, step long, text string").option(
        "header", True).csv(path)
    value = F.col("pv_power_w")
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - 5)
    off = F.abs(F.col("text").cast("double") - value)
    digits = F.length(F.regexp_replace("text", r"^[0.]+|[.\-]", ""))
    return text.join(g.telemetry(), ["site", "step"]).select(
        "site", "step", (off <= 0.5000001 * unit).alias("within_half_digit"),
        (digits <= 6).alias("short_enough"))


@query("power_header_issues", f"""
    SELECT 'error' AS severity, check_ AS "check", message, 1::BIGINT AS n
    FROM (VALUES ('column_position', 'column Time is column 2'), ('column_position', 'column power(W) is column 1'),
                 ('required_column', 'column Time is not in the header')) t(check_, message)
    WHERE EXISTS (SELECT 1 FROM events)""")
def power_header_issues(g: Given):
    """Readings written under the right, the swapped and a foreign header."""
    rows = g.readings().select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Time"),
                               F.col("value").alias("power(W)"))
    layouts = {"right": rows, "swapped": rows.select("power(W)", "Time"),
               "foreign": rows.withColumnRenamed("Time", "stamp")}
    paths = []
    for name, layout in layouts.items():
        paths.append(scratch_path(g.spark, name))
        layout.write.option("header", True).csv(paths[-1])
    found = raw.header_issues(g.spark, paths, ["Time", "power(W)"])
    return found.groupBy("severity", "check", "message").agg(F.lit(1).cast("long").alias("n"))


@query("weather_file_issues", """
    SELECT * FROM (VALUES ('error', 'column_position', 'wind_direction should be column 3 of 2'),
                          ('error', 'required_column', 'the header has no column Time'),
                          ('warning', 'variable_missing', 'no file holds rainfall')) t(severity, "check", message)
    WHERE EXISTS (SELECT 1 FROM events)""")
def weather_file_issues(g: Given):
    """Weather written well, without its time column, and with a column too few."""
    root = scratch_path(g.spark, "weather")
    rows = g.weather().select(F.date_format(clock.instant(F.col("step")), "y/M/d H:mm").alias("Time"), "ghi", "wind_speed")
    for folder, layout in {"ghi": rows.select("Time", "ghi"), "temperature": rows.select(F.col("Time").alias("stamp"), "ghi"),
                           "wind": rows.select("Time", "wind_speed")}.items():
        layout.write.option("header", True).csv(f"{root}/{folder}")
    patterns = {"ghi": "ghi/*.csv", "temperature": "temperature/*.csv", "wind_direction": "wind/*.csv",
                "rainfall": "rainfall/*.csv"}
    return raw.weather_file_issues(g.spark, root, patterns).select("severity", "check", "message").distinct()


@query("json_export", "SELECT site, step, pv_power_w FROM telemetry", doubles="pv_power_w")
def json_export(g: Given):
    """Rows written as JSON and read back."""
    path = scratch_path(g.spark, "json")
    results.write_json(g.telemetry(), path)
    return g.spark.read.schema("site string, step long, pv_power_w double").json(path)
