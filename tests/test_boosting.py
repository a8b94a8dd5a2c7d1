"""Boosting with penalised leaves against rounds computed by hand."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sunledger.operators import boosting


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "row_id long, split string, x array<double>, target double").withColumn(
        "features", array_to_vector("x")).drop("x")


def test_two_rounds_by_hand(spark):
    x, y = [0.0, 0.0, 1.0, 1.0, 1.0], np.array([1.0, 3.0, 10.0, 20.0, 6.0])
    rows = [(i, "train", [v], float(t)) for i, (v, t) in enumerate(zip(x, y))]
    rows += [(10, "test", [0.0], 5.0), (11, "test", [1.0], 500.0), (12, "val", [1.0], 0.0)]
    left = np.array(x) == 0
    predicted = np.full(5, y.mean())
    for rounds in (1, 2):
        for side in (left, ~left):
            predicted[side] += 0.5 * (y - predicted)[side].sum() / (side.sum() + 1.5)
        got = {r["row_id"]: r["predicted"] for r in boosting.boosted_predictions(
            rows_of(spark, rows), rounds=rounds, depth=1, rate=0.5, l2=1.5, rows_share=1.0,
            columns_share=1.0).collect()}
        assert [got[i] for i in range(5)] == pytest.approx(list(predicted))
        assert (got[10], got[11], got[12]) == pytest.approx((predicted[0], predicted[2], predicted[2]))
        # both sides from the same residuals: start the next round from there
    assert len(got) == 8


def test_more_rounds_fit_better_and_repeat(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (120, 3))
    y = np.where(x[:, 0] > 0, 5.0, -5.0) + x[:, 1]
    rows = [(i, "train" if i < 90 else "test", [float(v) for v in x[i]], float(y[i])) for i in range(120)]
    frame = rows_of(spark, rows)

    def error(rounds, split):
        out = boosting.boosted_predictions(frame, rounds=rounds, depth=3, rate=0.3)
        return out.where(F.col("split") == split).agg(F.avg((F.col("target") - F.col("predicted")) ** 2)).first()[0]

    assert error(12, "test") < 0.5 * error(1, "test") and error(12, "train") < error(1, "train")
    assert error(3, "test") == error(3, "test")


def test_without_training_rows(spark):
    out = boosting.boosted_predictions(rows_of(spark, [(1, "test", [1.0], 2.0)]), rounds=2)
    assert [r["predicted"] for r in out.collect()] == [0.0]
    assert boosting.boosted_predictions(rows_of(spark, []), rounds=2).count() == 0
