"""Window regression against windows that are built, one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunledger.operators import windowed

HORIZONS = {"near": 1, "far": 5}
SPECS = ["full", "pv_only", "no_weather"]
INPUTS = ["ghi", "pv_power_w_lag_0", "hour_sin"]
OF = {"full": INPUTS, "pv_only": ["pv_power_w_lag_0"], "no_weather": ["pv_power_w_lag_0", "hour_sin"]}


def series(seed, size, gaps=()):
    rng = np.random.default_rng(seed)
    x = rng.normal(5.0, 2.0, (size, 3))
    y = 3 + x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.3, size)
    y[4:] += x[:-4, 0]
    rows = []
    for i in range(size):
        if i in gaps:
            continue
        row = [float(v) for v in x[i]]
        if i % 97 == 50:
            row[i % 3] = None
        label = None if i % 89 == 20 else float(y[i])
        rows.append((1000 + i, "train" if i < size * 2 // 3 else "test", *row, label))
    return rows


def windows(rows, lookback, split):
    """(horizon, origin, window, label) of every whole window, by looking at each."""
    at = {r[0]: r for r in rows if r[1] == split}
    for name, h in HORIZONS.items():
        for t in at:
            steps = [at.get(t - k) for k in range(lookback - 1, -1, -1)]
            label = at.get(t + h)
            if None in steps or label is None or label[5] is None or any(None in s[2:5] for s in steps):
                continue
            yield name, t, np.array([s[2:5] for s in steps]), label[5]


@pytest.mark.parametrize("chunk_rows", [16_384, 40])
def test_fits_and_predictions_against_built_windows(spark, chunk_rows):
    lookback = 4
    data = {"a": series(1, 400, gaps={60, 61, 150, 300}), None: series(2, 250), "short": series(3, 5)}
    rows = [(site, *r) for site, rows in data.items() for r in rows]
    frame = spark.createDataFrame(rows, "site string, step bigint, split string, ghi double, "
                                        "pv_power_w_lag_0 double, hour_sin double, pv_power_w double")
    fits, scored = windowed.window_regression(
        frame.repartition(3), INPUTS, specs=SPECS, horizons=HORIZONS, lookback=lookback,
        carried=["split"][:0], chunk_rows=chunk_rows)
    got = {(r["site"], r["horizon"], r["feature_spec"]): r for r in fits.collect()}
    found = {(r["site"], r["horizon"], r["feature_spec"], r["origin_step"]): (r["actual"], r["predicted"], r["step"])
             for r in scored.collect()}
    assert {k[0] for k in got} == {"a", None} and len(found) > 500
    seen = 0
    for site in ("a", None):
        for name, h in HORIZONS.items():
            train = [(w, y) for n, _, w, y in windows(data[site], lookback, "train") if n == name]
            test = [(t, w, y) for n, t, w, y in windows(data[site], lookback, "test") if n == name]
            for spec in SPECS:
                cols = [INPUTS.index(c) for c in OF[spec]]
                x = np.array([w[:, cols].ravel() for w, _ in train])
                fit = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), np.array([y for _, y in train]),
                                      rcond=None)[0]
                row = got[site, name, spec]
                assert (row["n_fit"], row["n_inputs"], row["rank"]) == (len(x), len(cols), x.shape[1])
                for t, w, y in test:
                    actual, predicted, step = found[site, name, spec, t]
                    assert (actual, step) == (y, t + h)
                    assert predicted == pytest.approx(fit[0] + w[:, cols].ravel() @ fit[1:], abs=1e-7)
                    seen += 1
    assert seen == len(found)


def test_repeated_columns_give_the_solution_of_least_norm(spark):
    """An input that is another one a step later, as lags of a series are."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 300)
    rows = [("a", i, "train" if i < 200 else "test", float(x[i]), float(x[i - 1]) if i else 0.0, 1.0,
             float(x[i] - x[i - 2])) for i in range(300)]
    frame = spark.createDataFrame(rows, "site string, step bigint, split string, ghi double, "
                                        "pv_power_w_lag_0 double, hour_sin double, pv_power_w double")
    fits, scored = windowed.window_regression(frame, INPUTS, horizons={"near": 1}, lookback=3)
    row = fits.first()
    assert row["rank"] == 4 and row["n_inputs"] == 3  # x[t] .. x[t-3]; the constant input counts for nothing
    weights = np.array(row["coefficients"][1:]).reshape(3, 3)
    assert np.allclose(weights[:, 2], 0) and np.allclose(weights[1, 0], weights[2, 1], atol=0.02)
    assert scored.count() == 300 - 200 - 2 - 1


def test_what_each_input_adds_with_its_lags(spark):
    """Moving an input's part moves the input at all lags at once."""
    rows = [("a", *r) for r in series(9, 200)]
    frame = spark.createDataFrame(rows, "site string, step bigint, split string, ghi double, "
                                        "pv_power_w_lag_0 double, hour_sin double, pv_power_w double")
    fits, scored = windowed.window_regression(frame, INPUTS, horizons={"near": 1}, lookback=4, by_input=True)
    train = [r[2:5] for r in series(9, 200) if r[1] == "train"]
    known = [np.array([r[i] for r in train if r[i] is not None]) for i in range(3)]
    weights = np.array(fits.first()["coefficients"])
    found = {r["origin_step"]: r for r in scored.collect()}
    for name, t, w, _ in windows(series(9, 200), 4, "test"):
        if name == "near":
            scaled = (w - [k.mean() for k in known]) / [k.std() for k in known]
            parts = (scaled * weights[1:].reshape(4, 3)).sum(0)
            assert found[t]["parts"] == pytest.approx(list(parts))
            assert found[t]["predicted"] == pytest.approx(weights[0] + parts.sum())
    listed = windowed.step_weights(fits, INPUTS, 4).collect()
    assert {(r["feature"], r["step"]): r["value"] for r in listed} == pytest.approx(
        {(c, 3 - k): abs(weights[1 + 3 * k + i]) for k in range(4) for i, c in enumerate(INPUTS)})


def test_no_rows_and_no_training_rows(spark):
    schema = ("site string, step bigint, split string, ghi double, pv_power_w_lag_0 double, hour_sin double, "
              "pv_power_w double")
    for rows in ([], [("a", i, "test", 1.0 * i, 2.0, 3.0, 4.0) for i in range(30)]):
        fits, scored = windowed.window_regression(spark.createDataFrame(rows, schema), INPUTS, lookback=2,
                                                  horizons=HORIZONS)
        assert fits.count() == 0 == scored.count()
    with pytest.raises(ValueError):
        windowed.window_regression(spark.createDataFrame([], schema), ["pv_power_w"])
