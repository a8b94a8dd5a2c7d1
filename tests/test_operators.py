"""Hand-computed expectations for the operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunledger.functions import bands, clock, draws, scores, solar, stats
from sunledger.operators import (clean, conformal, features, forecast, gaps, importance, inference, inputs,
                                 metrics, regimes, resample, sky, strata, supervise, tables,
                                 transfer, validate)
from sunledger.functions.draws import draw
from sunledger.schema import INPUT_SETS, MODEL_INPUTS


def series(spark, values, site="a", start=0, name="v"):
    rows = [(site, start + i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"site string, step long, {name} double")


def listed(df, column, order="step"):
    return [r[column] for r in df.orderBy(order).collect()]


# ---- rollup ---------------------------------------------------------------------

def test_bin_is_right_closed_and_labelled_by_its_end(spark):
    start = dt.datetime(2023, 6, 15, 11, 45)
    rows = [(start + dt.timedelta(minutes=i), float(i)) for i in range(16)]
    df = spark.createDataFrame(rows, "Time timestamp_ntz, ghi double")
    out = resample.rollup(df, "Time", ["ghi"]).withColumn("t", clock.stamp(F.col("step")))
    got = {r.t: r.ghi for r in out.collect()}
    assert got == {dt.datetime(2023, 6, 15, 11, 45): 0.0, dt.datetime(2023, 6, 15, 12, 0): 8.0}


def test_empty_bins_are_null_means_and_zero_sums(spark):
    rows = [(dt.datetime(2023, 1, 1, 0, 10), 2.0), (dt.datetime(2023, 1, 1, 0, 40), 4.0)]
    df = spark.createDataFrame(rows, "Time timestamp_ntz, x double")
    assert listed(resample.rollup(df, "Time", ["x"], empty_bins=True), "x") == [2.0, None, 4.0]
    assert listed(resample.rollup(df, "Time", ["x"], "sum", empty_bins=True), "x") == [2.0, 0.0, 4.0]
    with pytest.raises(ValueError):
        resample.rollup(df, "Time", ["x"], "max")


# ---- gaps -----------------------------------------------------------------------

def test_long_gap_is_lined_then_held_then_median(spark):
    df = series(spark, [0.0] + [None] * 20 + [21.0])
    got = listed(gaps.fill_weather(df, ["v"], limit=8, both=False), "v")
    filled = [float(i) for i in range(9)] + [8.0] * 8
    assert got[:17] == filled
    assert got[17:21] == [pytest.approx(np.median(filled + [21.0]))] * 4
    both = listed(gaps.fill_weather(df, ["v"], limit=8, both=True), "v")
    assert both == [float(i) for i in range(9)] + [8.0] * 4 + [float(i) for i in range(13, 22)]


def test_edges_are_not_interpolated(spark):
    df = series(spark, [None, 1.0, None, 3.0, None, None])
    assert listed(gaps.interpolate(df, "v", "f", 4, both=True), "f") == [None, 1, 2, 3, None, None]
    assert listed(gaps.interpolate(df, "v", "f", 1, causal=True), "f") == [None, 1, 1, 3, 3, None]


def test_blocks_do_not_see_each_other(spark):
    df = series(spark, [1.0, None, None, 4.0, None, 6.0])
    out = gaps.impute(df, "v", [], F.col("step") < 2)
    assert listed(out, "v") == [1.0, None, None, 4.0, 5.0, 6.0]
    assert listed(out, "imputed") == [False, False, False, False, True, False]
    causal = gaps.impute(df, "v", [], F.col("step") < 2, causal=True)
    assert listed(causal, "v") == [1.0, None, None, 4.0, 4.0, 6.0]


def test_missingness_profile(spark):
    df = series(spark, [None, 1, None, None, 2, None])
    r = gaps.missingness(df, "v").first()
    assert (r.n_missing, r.n_gaps, r.longest_gap, r.mean_gap_length) == (4, 3, 2, 4 / 3)
    hist = gaps.gap_histogram(df, "v")
    assert gaps.gap_length_map(hist).first().histogram == {1: 2, 2: 1}
    assert gaps.gap_length_map(hist, max_gaps=2).first().histogram is None


# ---- cleaning -------------------------------------------------------------------

def test_flatline_starts_after_its_first_step(spark):
    df = series(spark, [5, 1, 1, 1, 1, 2, 2, 2, 3])
    got = listed(clean.flag_flatlines(df, "v", min_length=3, chunk_steps=2), "flatline")
    assert got == [False, False, True, True, True, False, False, False, False]


def test_irradiance_repair(spark):
    values = [100, 101, 99, 100, 900, 100, 102, 98, 100, 2000, 101, 100, -5, 100, 100]
    df = series(spark, values, name="ghi").withColumn(
        "solar_elevation", F.when(F.col("step") == 0, -1.0).otherwise(30.0))
    out = clean.clean_irradiance(df)
    cleaned = listed(out, "ghi_clean")
    assert cleaned[0] == 0.0 and cleaned[4] == 100.0 and cleaned[9] == 100.0 and cleaned[12] == 100.0
    s = clean.irradiance_summary(out).first()
    assert (s.n_envelope, s.n_spikes, s.n_night_zeroed) == (2, 1, 1)


def test_negative_power_is_clipped(spark):
    df = series(spark, [-1, 0, 5, None])
    assert listed(df.withColumn("c", clean.clip_negative(F.col("v"))), "c") == [0, 0, 5, None]


# ---- solar ----------------------------------------------------------------------

@pytest.mark.parametrize("day, declination", [("2023-03-20", 0.0), ("2023-06-21", 23.44),
                                              ("2023-12-22", -23.44)])
def test_noon_elevation_matches_the_almanac(spark, day, declination):
    step = int(dt.datetime.fromisoformat(day + "T00:00:00+00:00").timestamp()) // 900
    rows = spark.range(step, step + 96).select(F.lit("a").alias("site"), F.col("id").alias("step"))
    place = spark.sql("SELECT 'a' AS site, 22.3D AS latitude, 114.17D AS longitude, 0D AS altitude_m")
    out = sky.add_solar(rows, place)
    top = out.orderBy(F.desc("solar_elevation")).first()
    south = 90 - abs(22.3 - declination)
    assert top.solar_elevation == pytest.approx(south, abs=0.6)
    assert 12 <= (top.step % 96) / 4 <= 12.75
    assert out.where("not daylight").agg(F.max("ghi_clear")).first()[0] == 0.0
    assert 600 < top.ghi_clear < 1150


def test_clearness_needs_light(spark):
    df = spark.createDataFrame([(50.0, 100.0, True), (50.0, 50.0, True), (50.0, 100.0, False)],
                               "ghi double, clear double, lit boolean")
    kt = solar.clearness(F.col("ghi"), F.col("clear"), F.col("lit"))
    assert [r[0] for r in df.select(kt).collect()] == [0.5, None, None]


# ---- features, targets, windows ----------------------------------------------------

def test_trailing_statistics_need_full_windows(spark):
    df = series(spark, [1, 2, 3, None, 5], name="pv_power_w")
    out = features.build_features(df, chunk_steps=2)
    assert listed(out, "pv_power_w_lag_2") == [None, None, 1, 2, 3]
    assert set(listed(out, "pv_rolling_mean_4")) == {None}
    build = features.trailing("pv_power_w", [2], ["mean", "std"], "{stat}_{window}")
    from sunledger.plans.chunks import over_halo
    rolled = over_halo(df, ["site"], "step", build, before=1, chunk_steps=2)
    assert listed(rolled, "mean_2") == [None, 1.5, 2.5, None, None]
    assert listed(rolled, "std_2") == [None, 0.5, 0.5, None, None]


def test_input_list_has_33_names():
    assert len(MODEL_INPUTS) == 33 == len(set(MODEL_INPUTS))


def test_horizons_land_on_their_clock(spark):
    start = int(dt.datetime(2023, 6, 15, 10, tzinfo=dt.timezone.utc).timestamp()) // 900
    df = series(spark, range(200), start=start, name="pv_power_w")
    rows = supervise.build_target(df, chunk_steps=16).where(F.col("step") == start)
    got = {r.horizon: (r.t, r.target) for r in rows.withColumn(
        "t", clock.stamp(F.col("target_step"))).collect()}
    assert got == {"15min": (dt.datetime(2023, 6, 15, 10, 15), 1.0),
                   "1h": (dt.datetime(2023, 6, 15, 11, 0), 4.0),
                   "6h": (dt.datetime(2023, 6, 15, 16, 0), 24.0),
                   "24h": (dt.datetime(2023, 6, 16, 10, 0), 96.0)}


def test_causality_audit_finds_a_shifted_label(spark):
    df = series(spark, range(30), name="pv_power_w")
    good = supervise.build_target(df, horizons={"1h": 4})
    assert supervise.causality_audit(good, df).first().n_mismatched == 0
    bad = good.withColumn("target", F.col("target") + 1)
    assert supervise.causality_audit(bad, df).first().n_mismatched == 26


def test_window_counts(spark):
    df = series(spark, range(100), name="pv_power_w")
    assert supervise.window_origins(df, 4, 24).count() == 100 - 24 - 4 + 1
    assert supervise.window_origins(df, 4, 24, truncated_target=True).count() == 100 - 24 - 8 + 1
    first = supervise.window_origins(df, 4, 24).orderBy("step").first()
    assert (first.start_row, first.origin_row, first.label_row) == (0, 23, 27)
    windows = supervise.build_windows(df, ["pv_power_w"], horizons={"1h": 4}, chunk_steps=10)
    w = windows.orderBy("step").first()
    assert [x.pv_power_w for x in w.window] == list(range(24)) and w.target == 27.0


def test_split_must_be_ordered():
    with pytest.raises(ValueError):
        supervise.Boundaries(("2021", "2022"), ("2021-06", "2022-06"), ("2023", "2024"))


def test_scalers_flag_bad_inputs(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, None), ("a", 3.0, 2.0, 1.0)],
                               "site string, x double, c double, m double")
    got = {r.column: (r.mean, r.std, r.status) for r in supervise.fit_scalers(
        df, ["x", "c", "m"]).collect()}
    assert got["x"] == (2.0, 1.0, "ok")
    assert got["c"][2] == "zero_variance" and got["m"][2] == "non_finite"


# ---- regimes and strata ---------------------------------------------------------------

def test_regime_precedence(spark):
    df = spark.createDataFrame([(0.9, 0.1, -1.0), (0.9, 0.7, 10.0), (0.8, 0.1, 10.0),
                                (0.5, None, 10.0), (0.1, 0.1, 10.0), (None, None, 10.0)],
                               "kt double, cv double, e double")
    label = regimes.regime_label(F.col("kt"), F.col("cv"), F.col("e"))
    assert [r[0] for r in df.select(label).collect()] == [
        "Night", "High-variability", "Clear", "Partly cloudy", "Cloudy", "Cloudy"]


def test_bands(spark):
    df = spark.createDataFrame([(40000.0,), (55000.0,), (60000.0,)], "y double")
    got = [r[0] for r in df.select(bands.power_level(F.col("y"), F.lit(55000.0))).collect()]
    assert got == ["50-75% of capacity", "75-100% of capacity", None]
    assert df.select(bands.generation_level(F.lit(0.35), F.lit(1.0))).first()[0] == "high_generation"


def test_small_strata_carry_a_flag(spark):
    rows = [("a", "m", "1h", i, float(i % 5), 1.0, True, "Clear" if i < 250 else "Cloudy", 10.0, 2.0)
            for i in range(300)]
    df = spark.createDataFrame(rows, "site string, model string, horizon string, step long, "
                               "actual double, predicted double, daylight boolean, regime string, "
                               "rated_w double, reference_persistence double")
    out = {r.stratum: r for r in strata.stratified_table(
        strata.build_strata(df), ["regime"]).collect()}
    assert out["Cloudy"].under_sampled and out["Cloudy"].mae == pytest.approx(1.4)
    assert out["Cloudy"].n == 50
    assert not out["Clear"].under_sampled and out["Clear"].mae == pytest.approx(1.4)


# ---- metrics ---------------------------------------------------------------------------

def test_metric_set(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 4.0), ("a", 4.0, 3.0)],
                               "site string, actual double, predicted double")
    r = metrics.compute_all(df.withColumn("rated_w", F.lit(10.0)), ["site"], "rated_w").first()
    assert (r.mae, r.mse, r.bias, r.peak_error) == (1.0, 5 / 3, 1 / 3, 2.0)
    assert r.r2 == pytest.approx(1 - 5 / 8)
    assert r.smape == pytest.approx(100 * (0 + 4 / 6 + 2 / 7) / 3)
    assert r.nrmse_capacity == pytest.approx(math.sqrt(5 / 3) / 10)


def test_degenerate_scores(spark):
    df = spark.createDataFrame([("a", 2.0, 2.0, 2.0)] * 3,
                               "site string, actual double, predicted double, ref double")
    r = df.groupBy("site").agg(scores.r2(F.col("actual"), F.col("predicted")).alias("r2"),
                               stats.skill(scores.rmse(F.col("actual"), F.col("ref")),
                                           F.lit(1.0)).alias("s")).first()
    assert r.r2 == 0.0 and r.s is None


def test_reference_with_a_hole_is_skipped(spark):
    rows = [("a", 1.0, 2.0, None, True), ("a", 2.0, 2.0, 1.0, True)]
    df = spark.createDataFrame(rows, "site string, actual double, predicted double, "
                               "ref double, daylight boolean").withColumn("rated_w", F.lit(1.0))
    r = metrics.score(df, ["site"], references={"p": "ref"}).where("scope = 'daylight'").first()
    assert r.n == 2 and r.p_rmse is None and r.skill_vs_p_rmse is None


# ---- conformal ---------------------------------------------------------------------------

def test_conformal_quantile(spark):
    df = spark.range(1, 101).select(F.lit("a").alias("site"), F.col("id").cast("double").alias("r"))
    out = conformal.conformal_quantiles(df, "r", [0.1, 0.001], ["site"])
    got = {r.alpha: r.interval_half_width_w for r in out.collect()}
    assert got == {0.1: 91.0, 0.001: 100.0}


# ---- inference ---------------------------------------------------------------------------

def errors(spark, n=60, seed=5):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, 1, n), rng.normal(0, 1.3, n)
    rows = [("s", 3 * i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
    return a, b, spark.createDataFrame(
        rows, "site string, step long, error double, reference_error double")


def test_diebold_mariano_is_the_paired_t_at_one_step(spark):
    a, b, df = errors(spark)
    d = np.abs(a) - np.abs(b)
    r = inference.diebold_mariano(inference.loss_rows(df, losses=["mae"]), keys=["site", "loss"],
                                  chunk_steps=7).first()
    assert r.statistic == pytest.approx(d.mean() / (d.std(ddof=1) / np.sqrt(len(d))), rel=1e-9)
    assert r.p_value == pytest.approx(math.erfc(abs(r.statistic) / math.sqrt(2)), abs=3e-7)
    c = d - d.mean()
    assert r.lag_1_autocorrelation == pytest.approx((c[1:] * c[:-1]).sum() / (c * c).sum())


@pytest.mark.parametrize("whole_rows", [1 << 16, 9])
def test_bootstrap_sums_against_resamples_that_are_built(spark, whole_rows):
    """One part or many; the draws by their definition in whole numbers."""
    a, b, df = errors(spark, 50)
    df = df.unionByName(df.where("step < 15").withColumn("site", F.lit(None).cast("string")))
    got = {(r.site, r.block_length, r.resample): (r.t, r.n) for r in inference.resample_sums(
        df, ["site"], {"t": F.col("error")}, 20, [1, 8, 64], whole_rows=whole_rows).collect()}
    first = df.select("site").first().site
    assert len(got) == 2 * 3 * 20

    def start(r, k, length):
        z = 42 + sum(p * m for p, m in zip((r, k, length), draws.MIXERS))
        for m in draws.MIXERS[:2]:
            z = (z % 2 ** 64 ^ z % 2 ** 64 >> 32) * m % 2 ** 64
        return z >> 1

    for site, values in ((first, a), (None, a[:5])):
        n = len(values)
        for length in (1, 8, 64):
            size = min(length, n)
            for r in range(20):
                index = np.concatenate([np.arange(size) + start(r, k, length) % (n - size + 1)
                                        for k in range(-(-n // size))])[:n]
                assert got[site, length, r] == (pytest.approx(values[index].sum(), abs=1e-9), n)


def test_best_model_differs_by_site_and_sites_may_be_null(spark):
    rows = [(site, m, "1h", t, float(t % 5), float(t % 5) + gap * (-1) ** t, float(t % 5) + 1.5)
            for site, gaps in (("a", {"x": 1.0, "y": 2.0}), (None, {"x": 3.0, "y": 0.5}))
            for m, gap in [*gaps.items(), ("persistence", 0.1)] for t in range(40)]
    frame = spark.createDataFrame(rows, "site string, model string, horizon string, step long, actual double, "
                                        "predicted double, reference_persistence double")
    got = inference.best_differentials(frame)
    assert {(r.site, r.model, r.series) for r in got.collect()} == {
        (s, m, n) for s, m in (("a", "x"), (None, "y")) for n in ("error", "mae", "rmse")}
    sums = {(r.site, r.series): r["sum(d)"] for r in got.groupBy("site", "series").sum("d").collect()}
    assert sums["a", "mae"] == pytest.approx(40 * (1.0 - 1.5)) and sums[None, "rmse"] == pytest.approx(40 * (0.25 - 2.25))
    profile = inference.autocorrelation(got, max_lag=3, keys=["site", "horizon", "model", "series"])
    assert profile.count() == 2 * 3 * 4


def test_bootstrap_interval_covers_the_point(spark):
    _, _, df = errors(spark, 200)
    r = inference.bootstrap_skill(df, keys=["site"], n_resamples=200, block=10).first()
    assert r.ci_low < r.point_estimate < r.ci_high and r.n_resamples == 200


def test_holm(spark):
    df = spark.createDataFrame([("mae", p) for p in (0.001, 0.02, 0.04, 0.9)],
                               "loss string, p_value double")
    got = [r.p_value_adjusted for r in inference.holm(df).orderBy("p_value").collect()]
    assert got == pytest.approx([0.004, 0.06, 0.08, 0.9])


def test_holm_families_do_not_mix(spark):
    rows = [(s, "1h", "mae", p) for s, ps in (("a", (0.01, 0.04)), ("b", (0.02,))) for p in ps]
    df = spark.createDataFrame(rows, "site string, horizon string, loss string, p_value double")
    got = {(r.site, r.p_value): r.p_value_adjusted for r in inference.holm(df).collect()}
    assert got == pytest.approx({("a", 0.01): 0.02, ("a", 0.04): 0.04, ("b", 0.02): 0.02})


def test_signed_ranks(spark):
    d = [1.0, 2.0, 2.0, -3.0, 4.0, 5.0, 0.0]
    df = spark.createDataFrame([("a", x) for x in d], "site string, d double")
    r = inference.signed_rank(df, keys=["site"]).first()
    assert (r.statistic, r.n_pairs, r.n_zero_differences) == (4.0, 6, 1)
    assert r.effect_size_rank_biserial == pytest.approx((17 - 4) / 21)
    variance = 6 * 7 * 13 / 24 - (8 - 2) / 48
    assert r.p_value == pytest.approx(math.erfc((10.5 - 4) / math.sqrt(variance) / math.sqrt(2)),
                                      abs=3e-7)


@pytest.mark.parametrize("size, first, lags", [(1, 0, 5), (700, 0, 192), (900, 30, 17), (40_000, 192, 192)])
def test_lag_sums_by_transforms_equal_direct_sums(size, first, lags):
    v = np.random.default_rng(size).normal(0, 1, size)
    v[size // 2:] *= 1e3
    want = [sum(v[t] * v[t - k] for t in range(max(first, k), size)) for k in range(min(lags, 6))]
    got = inference.lag_sums(v, first, lags)
    assert len(got) == lags + 1 and got[:len(want)] == pytest.approx(want, rel=1e-9, abs=1e-9 * (v @ v))
    k = min(lags, size - 1)
    assert got[k] == pytest.approx(v[max(first, k):] @ v[max(first, k) - k:size - k], abs=1e-9 * (v @ v))


def test_autocorrelation_and_effective_size(spark):
    rng = np.random.default_rng(1)
    x = np.zeros(300)
    for i in range(1, 300):
        x[i] = 0.7 * x[i - 1] + rng.normal()
    df = series(spark, x, name="d")
    profile = inference.autocorrelation(df, keys=["site"], max_lag=75, whole_rows=50)
    c = x - x.mean()
    want = [(c[k:] * c[:len(c) - k]).sum() / (c * c).sum() for k in range(76)]
    assert listed(profile, "autocorrelation", "lag") == pytest.approx(want)
    cut = next(k for k in range(1, 76) if abs(want[k]) < 0.05)
    r = inference.effective_sample_size(profile, ["site"]).first()
    assert r.integrated_autocorrelation_time == pytest.approx(1 + 2 * sum(want[1:cut]))


def test_student_t(spark):
    df = spark.range(1, 60).select("id", stats.t_critical(F.col("id")).alias("t"))
    got = {r.id: r.t for r in df.collect()}
    assert got[4] == pytest.approx(2.7764451) and got[29] == pytest.approx(2.0452296)
    assert got[40] == pytest.approx(2.0210754, abs=1e-5)


# ---- forecasts, importances, transfer, tables ------------------------------------------------

def test_smart_persistence(spark):
    df = spark.createDataFrame([(10.0, 100.0, 200.0), (10.0, 20.0, 900.0), (10.0, 21.0, 900.0),
                                (None, 100.0, 100.0)], "y double, now double, then double")
    f = forecast.smart_persistence(F.col("y"), F.col("now"), F.col("then"), F.lit(50.0))
    assert [r[0] for r in df.select(f).collect()] == [20.0, 10.0, 50.0, 0.0]


def test_grouped_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 2))
    rows = [("a", float(p), float(q), float(3 + 2 * p - q)) for p, q in x]
    df = spark.createDataFrame(rows, "site string, p double, q double, y double")
    r = forecast.grouped_linear_fit(df, ["p", "q"], "y", ["site"]).first()
    assert r.coefficients == pytest.approx([3.0, 2.0, -1.0])


def test_input_sets_split_the_families():
    kept = {s: inputs.select_inputs(MODEL_INPUTS, s) for s in [*INPUT_SETS, "minimal"]}
    assert {s: len(c) for s, c in kept.items()} == {
        "pv_only": 15, "weather_only": 12, "pv_weather": 27, "pv_weather_solar": 29, "full": 33,
        "no_weather": 21, "no_solar_geometry": 31, "no_pv_history": 18, "no_calendar": 29,
        "minimal": 4}
    assert all(c.startswith("pv_") for c in kept["pv_only"])
    assert not any(c.startswith("pv_") for c in kept["weather_only"])
    assert inputs.select_inputs(["extra", "clear_sky_index", "ghi"], "no_weather") == ["extra"]
    assert inputs.select_inputs(["extra", "clear_sky_index", "ghi"], "minimal") == ["extra"]
    assert inputs.select_inputs(["clear_sky_index", "ghi"], "pv_only") == ["clear_sky_index"]
    with pytest.raises(KeyError):
        inputs.select_inputs(MODEL_INPUTS, "unheard_of")


def test_input_sets_fit_like_separate_regressions(spark):
    rng = np.random.default_rng(3)
    names = ["ghi", "hour_sin", "pv_power_w_lag_0"]
    x = rng.normal(size=(60, 3))
    y = 1 + x @ [2.0, -1.0, 0.5] + rng.normal(size=60)
    site = [None if i % 3 == 0 else "a" for i in range(60)]
    rows = [(s, *map(float, r), float(t)) for s, r, t in zip(site, x, y)] + [("a", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, ", ".join(["site string", *[f"{c} double" for c in (*names, "y")]]))
    fits = inputs.fit_input_sets(df, names, "y", ["site"], ["full", "no_calendar", "pv_only"])
    got = {(r.site, r.feature_spec): r for r in fits.collect()}
    assert len(got) == 6
    for (s, spec), r in got.items():
        own = [names.index(c) for c in inputs.select_inputs(names, spec)]
        at = [i for i in range(60) if site[i] == s]
        want = np.zeros(4)
        want[[0, *[1 + i for i in own]]] = np.linalg.lstsq(
            np.column_stack([np.ones(len(at)), x[at][:, own]]), y[at], rcond=None)[0]
        assert r.n_fit == len(at) and r.n_inputs == len(own)
        assert r.coefficients == pytest.approx(want)
    p = df.limit(1).withColumn("coefficients", F.array(*map(F.lit, [1.0, 2.0, 0.0, 1.0])))
    r = p.withColumn("p", inputs.predicted_by(names)).first()
    assert r.p == pytest.approx(1 + 2 * r.ghi + r.pv_power_w_lag_0)


def test_collapsed_shares(spark):
    rows = [(f"f{i % 3}", i // 3, float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "feature string, step int, value double")
    got = {r.feature: r.relative_importance for r in forecast.collapse_importance(df).collect()}
    assert got == pytest.approx({"f0": 18 / 66, "f1": 22 / 66, "f2": 26 / 66})


def test_permuting_an_unused_input_changes_nothing(spark):
    rows = [(i, float(i % 7), float(i % 5), float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, x double, z double, y double")
    out = importance.permutation_importance(
        df, lambda d: d.withColumn("predicted", F.col("x")), "row_id", "y",
        {"x": ["x"], "z": ["z"]}, repeats=2)
    got = {r.feature: r for r in out.collect()}
    assert got["z"].mean_mae_increase == 0.0 and got["x"].relative_importance == 1.0
    assert 1.5 < got["x"].mean_mae_increase < 3.0


def test_shuffle_is_a_permutation(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"),
                                 F.lit("k").alias("key"))
    out = importance.shuffled_pairs(df, "row_id", {"x": ["x"]}, 1, ["key"]).collect()
    assert sorted(r.x for r in out) == [float(i) for i in range(100)]
    assert sum(r.x != r.row_id for r in out) > 80


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_given_values_are_not_broadcast(spark, keys):
    """The file of the numbered rows is small; what is made of it, per feature and repeat, is not."""
    df = spark.range(100).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"),
                                 F.lit("k").alias("key"))
    out = importance.shuffled_pairs(df, "row_id", {"x": ["x"]}, 10, keys)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert out.count() == 1000


def test_folds(spark):
    sites = spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], "site string")
    got = {(r.protocol, r.test_site): (r.train_sites, r.n_train_sites)
           for r in transfer.fold_table(sites, "a").collect()}
    assert got == {("within_site", "a"): ("a", 1), ("within_site", "b"): ("b", 1), ("within_site", "c"): ("c", 1),
                   ("cross_site", "b"): ("a", 1), ("cross_site", "c"): ("a", 1),
                   ("leave_one_site_out", "a"): ("b, c", 2), ("leave_one_site_out", "b"): ("a, c", 2),
                   ("leave_one_site_out", "c"): ("a, b", 2)}
    one = spark.createDataFrame([("x",), (None,)], "site string")
    assert {(r.protocol, r.test_site) for r in transfer.fold_table(one, "a").collect()} == {
        ("within_site", "x"), ("within_site", None), ("leave_one_site_out", "x"), ("leave_one_site_out", None)}
    many = spark.range(200).select(F.col("id").cast("string").alias("site"))
    assert transfer.fold_table(many, "7").count() == 200 + 199 + 200


def pooled_rows():
    rng = np.random.default_rng(3)
    rows = []
    for site, level in (("a", 1.0), ("b", 50.0), ("c", 3.0), ("sixth", 1000.0), (None, 7.0)):
        for i in range(40):
            x, z = rng.normal(level, 1), rng.normal(0, level)
            rows.append((site, "1h", float(x), float(z), float(2 * x - z + rng.normal())))
    return rows


def test_rank_tells_whether_the_weights_of_a_fold_are_determined(spark):
    rng = np.random.default_rng(8)
    rows = [(s, "1h", float(x), z(x), float(3 * x + rng.normal())) for s, z in (
        ("flat", lambda x: 450.0), ("equal", lambda x: float(x)), ("free", lambda x: float(rng.normal())))
        for x in rng.normal(2000, 400, 50)]
    frame = spark.createDataFrame(rows, "site string, horizon string, x double, z double, actual double")
    fits = transfer.pooled_fits(frame, frame, "free", ["x", "z"], "actual").where("protocol = 'within_site'")
    got = {r.test_site: r for r in fits.collect()}
    assert {s: r.rank for s, r in got.items()} == {"flat": 1, "equal": 1, "free": 2}
    assert got["flat"].stds[1] == got["flat"].coefficients[1] == 0.0


def test_pooled_fits_are_fits_on_the_pooled_rows(spark):
    """Total less own equals a fit on the other sites' rows, for sites of very different scale, a site
    that no list names and rows without a site; a site without training rows is tested too."""
    rows = pooled_rows()
    frame = spark.createDataFrame(rows, "site string, horizon string, x double, z double, actual double")
    sites = frame.select("site").union(spark.createDataFrame([("new",)], "site string"))
    got = {(r.protocol, r.test_site): r for r in transfer.pooled_fits(frame, sites, "a", ["x", "z"], "actual").collect()}
    scalers = {(r.protocol, r.test_site): r for r in transfer.pooled_scalers(frame, sites, "a", ["x"]).collect()}
    names = ["a", "b", "c", "sixth", None, "new"]
    want = {("within_site", s): [s] for s in names if s != "new"}
    want |= {("cross_site", s): ["a"] for s in names if s != "a"}
    want |= {("leave_one_site_out", s): [t for t in names if t != s] for s in names}
    assert set(got) == set(want) == set(scalers)
    for fold, members in want.items():
        own = np.array([r[2:] for r in rows if r[0] in members])
        x, y = own[:, :2], own[:, 2]
        scaled = (x - x.mean(0)) / x.std(0)
        fit = np.linalg.lstsq(np.column_stack([np.ones(len(y)), scaled]), y, rcond=None)[0]
        r = got[fold]
        assert r.n_fit == len(y) and r.means == pytest.approx(list(x.mean(0))) and r.stds == pytest.approx(list(x.std(0)))
        assert [r.intercept, *r.coefficients] == pytest.approx(list(fit), rel=1e-5, abs=1e-6)
        assert (scalers[fold]["mean"], scalers[fold]["std"]) == pytest.approx((x[:, 0].mean(), x[:, 0].std()))
    fits = transfer.pooled_fits(frame, sites, "a", ["x", "z"], "actual")
    scored = transfer.transfer_predictions(frame, fits, ["x", "z"])
    row = scored.where("protocol = 'cross_site' AND test_site = 'sixth'").first()
    r = got["cross_site", "sixth"]
    assert row.predicted == pytest.approx(r.intercept + sum(
        w * (row[c] - m) / d for w, c, m, d in zip(r.coefficients, ("x", "z"), r.means, r.stds)))


def test_sites_without_metadata_scale_or_fit_stay(spark):
    rows = [("a", 0, "train"), ("a", 1, "test"), (None, 0, "train"), ("new", 5, None)]
    frame = spark.createDataFrame(rows, "site string, step long, split string")
    stations = spark.createDataFrame([("a", 5.0), ("idle", 7.0)], "site string, rated_w double")
    got = {r.site: (r.metadata_found, r.n_rows, r.n_train, r.role)
           for r in validate.site_panel(frame, stations, "a").collect()}
    assert got == {"a": (True, 2, 1, "primary"), "idle": (True, 0, 0, "holdout"),
                   None: (False, 1, 1, "holdout"), "new": (False, 1, 0, "holdout")}
    index = frame.withColumn("clear_sky_index_raw", F.lit(0.5))
    scales = spark.createDataFrame([("a", 1.0), (None, 2.0)], "site string, scale double")
    assert {r.site: r.clear_sky_index for r in sky.apply_scale(index, scales).collect()} == {
        "a": 0.5, None: 0.25, "new": None}


def test_frontier_and_upsert(spark):
    rows = [("p", 0.0, 0.30, 1), ("q", 1.0, 0.20, 1), ("r", 2.0, 0.25, 1), ("s", 3.0, 0.10, 1),
            ("s", 3.0, 0.15, 2)]
    log = spark.createDataFrame(rows, "model string, train_seconds double, "
                                "nrmse_capacity double, run_no long").withColumns({
        "experiment_id": F.col("model"), "recorded_at": F.lit(0), "horizon": F.lit("1h"),
        "feature_spec": F.lit("full")})
    registry = tables.upsert_registry(log)
    assert registry.count() == 4
    flags = {r.model: r.pareto_optimal for r in tables.computational_cost(registry).collect()}
    assert flags == {"p": True, "q": True, "r": False, "s": True}


def test_issues_fail_on_errors(spark):
    raw = spark.createDataFrame([("a", None, "1"), ("a", dt.datetime(2023, 1, 1), "x"),
                                 ("a", dt.datetime(2023, 1, 1), "-2")],
                                "site string, Time timestamp_ntz, power_text string")
    issues = validate.power_issues(validate.power_checks(raw, "Time", "power_text"))
    counts = {r.severity: r.n_issues for r in validate.issues_by_severity(issues).collect()}
    assert counts == {"error": 1, "warning": 2, "info": 2}
    with pytest.raises(ValueError):
        validate.raise_on_errors(issues)


def test_largest_gap_is_a_run_length(spark):
    df = spark.createDataFrame([("a", s) for s in (0, 1, 5, 6, 9000)], "site string, step long")
    r = validate.coverage_summary(df).first()
    assert (r.n_expected, r.n_missing, r.largest_gap_steps) == (9001, 8996, 8993)
    s = validate.spacing_checks(df).first()
    assert (s.modal_steps, s.n_irregular, s.resolution_mismatch) == (1, 2, False)


def test_tail_probabilities_keep_their_digits(spark):
    from sunledger.functions.stats import two_sided_p
    points = [0.0, 0.3, -1.0, 1.96, 2.79, 2.8, 2.81, -5.0, 9.0, 20.0, 37.0]
    df = spark.createDataFrame([(z,) for z in points] + [(None,)], "z double")
    got = {r["z"]: r["p"] for r in df.select("z", two_sided_p(F.col("z")).alias("p")).collect()}
    assert got.pop(None) is None
    for z, p in got.items():
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-10)


def test_gap_map_has_every_length(spark):
    from sunledger.operators import gaps
    histogram = spark.createDataFrame([("a", k, 3) for k in range(1, 60)],
                                      "site string, length long, n_gaps long")
    row = gaps.gap_length_map(histogram).first()
    assert row["n_gaps"] == 177 and row["histogram"] == {k: 3 for k in range(1, 60)}


def test_short_runs_keep_their_intervals(spark):
    from sunledger.operators import conformal
    rows = [("a", "m", "1h", step, float(step % 7), 3.0, True) for step in range(120)]
    df = spark.createDataFrame(
        rows, "site string, model string, horizon string, step long, actual double, "
              "predicted double, daylight boolean")
    out = conformal.coverage_table(df, days=0.5).collect()
    assert out and all(r["under_sampled"] and r["interval_half_width_w"] == 3.0 for r in out)


def test_matrix_has_all_columns_and_unique_coverage_ids(spark):
    from sunledger.operators import tables
    from sunledger.schema import MATRIX_COLUMNS
    coverage = spark.createDataFrame(
        [("a", "m", h, 0.1, "evaluation_daylight", 5) for h in ("1h", "6h")],
        "site string, model string, horizon string, alpha double, scope string, n long")
    matrix = tables.build_matrix([tables.matrix_from_coverage(coverage)])
    assert matrix.columns == MATRIX_COLUMNS and "void" not in dict(matrix.dtypes).values()
    assert tables.repeated_ids(matrix).count() == 0


def test_windows_end_at_the_split(spark):
    from sunledger.operators import supervise
    df = spark.range(40).select(F.lit("a").alias("site"), F.col("id").alias("step"), F.when(
        F.col("id") < 20, "train").otherwise("test").alias("split"),
        F.col("id").cast("double").alias("v"))
    out = supervise.build_windows(df, ["v"], "v", {"x": 4}, 5, ["site", "split"], chunk_steps=6)
    rows = out.collect()
    assert sorted(r["step"] for r in rows) == [*range(4, 16), *range(24, 36)]
    assert all([w["v"] for w in r["window"]] == [float(s) for s in range(r["step"] - 4, r["step"] + 1)]
               and r["target"] == r["step"] + 4 for r in rows)


def test_validation_error_says_how_many_are_left_out(spark):
    from sunledger.operators import validate
    issues = spark.createDataFrame([("error", "s", "c", f"m{i}") for i in range(25)],
                                   "severity string, stage string, check string, message string")
    with pytest.raises(ValueError, match="and 5 more"):
        validate.raise_on_errors(issues)
