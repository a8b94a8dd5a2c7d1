"""Raw files, prepared tables, forecasts, run records and exports."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sunledger.sources import raw, results
from sunledger.streaming.rollup import stream_rollup
from sunledger.operators.resample import rollup
from sunledger.functions import clock


def test_station_files(spark, tmp_path):
    (tmp_path / "Roof North.csv").write_text(
        "Time,power(W)\n2021-06-01 00:00:00,1\n2021-06-01 00:00:00,3\n2021/6/1 0:15,x\nnever,5\n")
    (tmp_path / "Yard (Station 1).csv").write_text("Time,power(W)\n2021-06-01 00:00,7.5\n")
    scanned = raw.scan_power_raw(spark, str(tmp_path))
    got = {(r.site, r.Time): r.pv_power_w for r in raw.power_series(scanned).select(
        "site", F.col("Time").cast("string").alias("Time"), "pv_power_w").collect()}
    assert got == {("Roof North", "2021-06-01 00:00:00"): 2.0,
                   ("Roof North", "2021-06-01 00:15:00"): None,
                   ("Yard (Station 1)", "2021-06-01 00:00:00"): 7.5}
    bad = raw.unparsed_times(scanned).collect()
    assert [(r.site, r.n_unparsed, r.example) for r in bad] == [("Roof North", 1, "never")]
    issues = raw.station_issues(spark, ["Roof North", "Yard 2"], scanned)
    assert [r.message for r in issues.collect()] == ["station Yard 2 could not be loaded"]


def test_weather_by_position(spark, tmp_path):
    (tmp_path / "Wind").mkdir()
    (tmp_path / "Wind" / "Wind_2021.csv").write_text("Time,a,b\n2021/6/1 0:01,2,90\n2021/6/1 0:01,4,\n")
    (tmp_path / "Irradiance").mkdir()
    (tmp_path / "Irradiance" / "Irradiance_2021.csv").write_text("When,w\n2021/6/1 0:02,8\n")
    long = raw.scan_weather_raw(spark, str(tmp_path), {
        "ghi": "Irradiance/*.csv", "wind_speed": "Wind/*.csv", "wind_direction": "Wind/*.csv",
        "rainfall": "Rainfall/*.csv"})
    wide = raw.weather_table(long, ["ghi", "wind_speed", "wind_direction"]).orderBy("Time")
    assert [tuple(r)[1:] for r in wide.collect()] == [(None, 3.0, 90.0), (8.0, None, None)]


def test_station_metadata_and_lookup(spark, tmp_path):
    (tmp_path / "meta.ttl").write_text('''@prefix brick: <x> .
pvsystem:Roof_North a brick:PV_Generation_System ;
  brick:latitude 22.33 ;
  brick:longitude 114.26 ;
  brick:hasLocation [ brick:value "Roof" ] ;
  ext:altitude [ a ext:H ; brick:value 80 ] ;
  ext:ratedPowerOutput [ a ext:P ;
     brick:value 55.0 ] .
pvsystem:Yard__Station_1_ a brick:PV_Generation_System ;
  brick:latitude 22.3 .
''')
    stations = raw.scan_stations(spark, str(tmp_path / "meta.ttl"))
    r = {s.brick_name: s for s in stations.collect()}
    assert r["Roof_North"].rated_w == 55000.0 and r["Roof_North"].altitude_m == 80.0
    assert r["Roof_North"].location == "Roof" and r["Yard__Station_1_"].rated_kw is None
    names = spark.createDataFrame([("roof north",), ("Yard (Station 1)",), ("Nowhere",)], "site string")
    got = {x.site: (x.brick_name, x.metadata_found, x.slug)
           for x in raw.lookup_stations(names, stations).collect()}
    assert got == {"roof north": ("Roof_North", True, "roof_north"),
                   "Yard (Station 1)": ("Yard__Station_1_", True, "yard_station_1"),
                   "Nowhere": (None, False, "nowhere")}


def test_rewriting_one_site_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "prepared")
    rows = spark.createDataFrame([("a", "train", 1, 1.0), ("b", "train", 1, 2.0)],
                                 "site string, split string, step long, y double")
    results.write_prepared(rows, path)
    results.write_prepared(rows.where("site = 'a'").withColumn("y", F.lit(9.0)), path)
    got = {r.site: r.y for r in results.read_prepared(spark, path, split="train").collect()}
    assert got == {"a": 9.0, "b": 2.0}


def test_first_run_of_a_model_wins(spark, tmp_path):
    for run, value in (("B__m__1h", 1.0), ("C__m__1h", 2.0), ("C__m__6h", 3.0), ("Z__m__1h", 4.0)):
        spark.createDataFrame([(value,)], "predicted double").coalesce(1).write.parquet(
            str(tmp_path / run))
    paths = [str(tmp_path / d) for d in ("B__m__1h", "C__m__1h", "C__m__6h", "Z__m__1h")]
    got = results.scan_predictions(spark, paths, ["B", "C"]).collect()
    assert {(r.experiment_group, r.horizon, r.predicted) for r in got} == {
        ("B", "1h", 1.0), ("C", "6h", 3.0)}


def test_other_runs_are_not_opened(spark, tmp_path):
    """Files of runs that lose are no Parquet at all here."""
    rows = spark.createDataFrame([(1.0,)], "predicted double").coalesce(1)
    rows.write.parquet(str(tmp_path / "B__m__1h"))
    for name in ("C__m__1h", "Z__m__6h"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0.parquet").write_text("nothing to read")
    (tmp_path / "D__m__1h.parquet").write_text("nor here")
    got = results.scan_predictions(spark, str(tmp_path), ["B", "C", "D"], "1h").collect()
    assert [(r.experiment_group, r.model, r.predicted) for r in got] == [("B", "m", 1.0)]
    runs = results.prediction_runs(spark, str(tmp_path)).orderBy("run").collect()
    assert [r.run for r in runs] == ["B__m__1h", "C__m__1h", "D__m__1h", "Z__m__6h"]
    good = str(tmp_path / "B__m__1h")
    assert results.scan_predictions(spark, good, ["none"]).count() == 0


def test_run_records_typed_whole_and_counted(spark, tmp_path):
    record = {"spec": {"experiment_id": "B__x__1h", "model": "x", "horizon": "1h", "horizon_steps": 4,
                       "features": "full", "seed": 42, "notes": "n: NaN, kept"},
              "metrics_daylight": {"mae": 1.5, "rmse": 2, "r2": float("nan"), "bias": float("-inf")},
              "metrics_all_steps": {"rmse": 1.0},
              "metadata": {"model_family": "trees", "split_sizes": {"train": 9, "test": 7},
                           "target_split_dates": {"train": ["a", "m", "b"], "val": [], "test": ["", "z"]},
                           "cost": {"train_seconds": 0.5, "n_parameters": "many"},
                           "environment": {"git_revision": "r", "platform": {"python": "3"},
                                           "torch": {"version": "t"}}, "new": {"field": [1, 2]}}}
    plain = json.loads(json.dumps(record).replace("NaN,", "0,").replace("-Infinity", "0"))
    plain["spec"]["experiment_id"] = "C__y__6h"
    (tmp_path / "nan.json").write_text(json.dumps(record, indent=2))
    (tmp_path / "plain.json").write_text(json.dumps(plain))
    (tmp_path / "cut.json").write_text(json.dumps(record, indent=2)[:80])
    (tmp_path / "other.json").write_text("{}")
    (tmp_path / "empty.json").write_text("")
    rows = {r.experiment_id: r for r in results.scan_run_records(
        spark, str(tmp_path), fingerprint="f").drop("record").collect()}
    assert set(rows) == {"B__x__1h", "C__y__6h"} and len(rows["B__x__1h"]) == 43
    r = rows["B__x__1h"]
    assert (r.experiment_group, r.mae, r.rmse, r.r2, r.bias, r.rmse_all_steps) == ("B", 1.5, 2.0, None, None, 1.0)
    assert (r.n_train, r.n_val, r.n_test, r.horizon_steps, r.seed) == (9, None, 7, 4, 42)
    assert (r.train_start, r.train_end, r.val_end, r.test_start, r.test_end) == ("a", "b", None, None, "z")
    assert (r.train_seconds, r.n_parameters, r.config_fingerprint) == (0.5, None, "f")
    assert (r.model_family, r.git_revision, r.python_version, r.torch_version) == ("trees", "r", "3", "t")
    assert rows["C__y__6h"].r2 == 0.0
    kept = results.scan_run_records(spark, str(tmp_path)).select(
        F.try_variant_get("record", "$.metadata.new.field[1]", "int").alias("x"))
    assert [k.x for k in kept.collect()] == [2, 2]
    assert results.record_counts(spark, str(tmp_path)).first().asDict() == {
        "n_read": 2, "n_cut_off": 1, "n_unspecified": 1}


def test_six_significant_digits(spark, tmp_path):
    values = [0.0, 1.0, 123456.7, 999999.7, 1234567.0, 0.00012345678, 0.000012345678, -2.5, 1e-300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(results.significant(F.col("v"))).collect()]
    assert got == ["%.6g" % v for v in values]
    results.write_table(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == len(values)


def test_streamed_rollup_equals_batch(spark, tmp_path):
    start = dt.datetime(2023, 6, 15, 10, 0)
    rows = [("a" if i % 3 else "b", start + dt.timedelta(minutes=i), float(i)) for i in range(240)]
    df = spark.createDataFrame(rows, "site string, Time timestamp, x double").repartition(3)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (stream_rollup(stream, "Time", ["x"], lateness="0 seconds").writeStream
             .format("memory").queryName("bins").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "ck")).start())
    query.processAllAvailable()
    query.stop()
    batch = rollup(df, "Time", ["x"], keys=["site"]).select(
        "site", clock.instant(F.col("step")).alias("Time"), "x")
    got = {(r.site, r.Time): r.x for r in spark.table("bins").collect()}
    want = {(r.site, r.Time): r.x for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 2


def test_a_foreign_header_is_an_issue_and_no_reading(spark, tmp_path):
    from sunledger.sources import raw
    (tmp_path / "A.csv").write_text("Time,power(W)\n2024-01-01 00:00:00,5\n")
    (tmp_path / "B.csv").write_text("Time,other\n2024-01-01 00:00:00,7\n")
    (tmp_path / "C.csv").write_text("power(W),Time\n7,2024-01-01 00:00:00\n")
    found = raw.header_issues(spark, str(tmp_path), ["Time", "power(W)"])
    assert {(r["stage"], r["check"]) for r in found.collect()} == {
        ("loader/B", "required_column"), ("loader/C", "column_position")}
    assert raw.scan_power_raw(spark, str(tmp_path / "A.csv")).count() == 1
    with pytest.raises(Exception, match="header"):
        raw.scan_power_raw(spark, str(tmp_path / "B.csv")).collect()


def test_metadata_of_many_splits_gives_the_same_entities(spark, tmp_path):
    """Entities that name each other, of very different length, cut at every few hundred bytes."""
    def block(i):
        other = f"  ext:feeds pvsystem:S{i - 1} ;\n" * (i % 4)
        return (f"pvsystem:S{i} a brick:PV_Generation_System ;\n{other}  brick:latitude {i}.5 ;\n"
                f"{'  # filler' * (i % 7 * 20)}\n  ext:ratedPowerOutput [ brick:value {i}.25 ] .\n")

    (tmp_path / "a.ttl").write_text("# prefix pvsystem: <x>\n" + "".join(map(block, range(1, 120))))
    (tmp_path / "b.ttl").write_text("".join(map(block, range(200, 203))))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.brick_name: (r.latitude, r.rated_kw) for r in raw.scan_stations(spark, str(tmp_path)).collect()}
            assert got == {f"S{i}": (i + 0.5, i + 0.25) for i in [*range(1, 120), *range(200, 203)]}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_weather_files_with_wrong_headers_are_issues(spark, tmp_path):
    for name, text in {"ghi": "Time,v\n1,2\n", "temperature": "when,v\n1,2\n", "wind": "Time,speed\n1,2\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "2020.csv").write_text(text)
    found = raw.weather_file_issues(spark, str(tmp_path), {
        "ghi": "ghi/*.csv", "temperature": "temperature/*.csv", "wind_direction": "wind/*.csv", "rainfall": "rain/*.csv"})
    assert {(r.severity, r.check, r.detail["variable"]) for r in found.collect()} == {
        ("error", "required_column", "temperature"), ("error", "column_position", "wind_direction"),
        ("warning", "variable_missing", "rainfall")}
