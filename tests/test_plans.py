"""Chunked plans against brute force, with chunks far smaller than the series."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from sunledger.plans import chunks, ranks


@pytest.fixture(scope="module")
def table(spark):
    """One key holds most of the rows; values have runs of nulls longer than a chunk."""
    rng = random.Random(3)
    rows = []
    for site, n in (("hot", 200), ("small", 17), ("one", 1)):
        for step in range(1000, 1000 + n):
            gap = site == "hot" and 1040 <= step < 1075
            value = None if gap or rng.random() < 0.3 else float(rng.randint(-5, 5))
            rows.append((site, step, value))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "site string, step long, v double").cache()


def whole(order="step"):
    return Window.partitionBy("site").orderBy(order)


def same(left, right):
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("chunk", [4, 7, 5000])
def test_halo_equals_one_window(table, chunk):
    def build(w):
        return {"lag": F.lag("v", 6).over(w), "lead": F.lead("v", 3).over(w),
                "mean": F.round(F.avg("v").over(w.rowsBetween(-6, 3)), 9)}
    got = chunks.over_halo(table, ["site"], "step", build, before=6, after=3, chunk_steps=chunk)
    same(got, table.withColumns(build(whole())))


@pytest.mark.parametrize("strict", [False, True])
def test_carry_crosses_many_chunks(table, strict):
    got = chunks.carry(table, ["site"], "step", {"before": F.col("v")}, {"after": F.col("v")},
                       strict=strict, chunk_steps=5)
    near = 1 if strict else 0
    back = whole().rowsBetween(Window.unboundedPreceding, -near)
    ahead = whole().rowsBetween(near, Window.unboundedFollowing)
    same(got.select("site", "step", "before", "after"), table.select(
        "site", "step", F.last("v", True).over(back).alias("before"),
        F.first("v", True).over(ahead).alias("after")))


def test_running_sum_and_position(table):
    got = chunks.running_sum(table, ["site"], "step", {"s": F.coalesce("v", F.lit(0.0))},
                             chunk_steps=6)
    want = F.sum(F.coalesce("v", F.lit(0.0))).over(whole())
    same(got.select("site", "step", "s"), table.select("site", "step", want.alias("s")))
    kept = table.where("v is not null")
    got = chunks.with_position(kept, ["site"], "step", chunk_steps=6)
    same(got, kept.withColumn("pos", F.row_number().over(whole()).cast("long")))


def test_dense_grid(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 19), ("b", -4), ("b", -2)],
                                 "site string, step long")
    got = chunks.dense_grid(rows, ["site"], "step", chunk_steps=4).collect()
    assert sorted((r.site, r.step) for r in got) == [("a", s) for s in range(3, 20)] + [
        ("b", s) for s in (-4, -3, -2)]


def test_quantiles_are_exact(table):
    pdf = table.toPandas().dropna()
    shares = {"p0": 0.0, "p13": 0.13, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = ranks.quantiles(table, ["site"], "v", shares).toPandas().set_index("site")
    for site, group in pdf.groupby("site"):
        assert got.loc[site, "n"] == len(group)
        for name, p in shares.items():
            assert got.loc[site, name] == pytest.approx(np.quantile(group.v, p), abs=1e-12)


def test_values_without_a_number_have_no_rank(spark):
    values = [-5.0, -4.0, 1.0, 2.0, 3.0, float("nan"), float("inf"), None]
    df = spark.createDataFrame([("a", v) for v in values], "site string, v double")
    row = ranks.quantiles(df, ["site"], "v", {"low": 0.0, "mid": 0.5, "top": 1.0}).first()
    assert (row.n, row.low, row.mid, row.top) == (5, -5.0, 1.0, 3.0)


def test_ranks_of_ties(table):
    pdf = table.toPandas().dropna()
    pdf["first"] = pdf.groupby("site").v.rank("min").astype(int)
    want = {(r.site, r.v): r.first for r in pdf.itertuples()}
    got = {(r.site, r.v): r.first_rank for r in ranks.ranked_values(table, ["site"], "v").collect()}
    assert got == want


def test_other_sites_do_not_matter(table):
    alone = table.where("site = 'small'")
    for frame in (table, alone):
        out = chunks.carry(frame, ["site"], "step", {"p": F.col("v")}, chunk_steps=3)
        rows = [tuple(r) for r in out.where("site = 'small'").orderBy("step").collect()]
        if frame is table:
            first = rows
    assert rows == first


def test_once_keeps_filters_off_the_expression(spark):
    df = chunks.once(spark.range(10), {"x": F.sqrt(F.col("id"))}).where("x > 2")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT") == 1
    assert sorted(r.id for r in df.collect()) == [5, 6, 7, 8, 9]




def bucketed(df, value="v"):
    rows = chunks.boxed(ranks.known(df, value), [])
    return ranks.located(rows, ranks.split_points(rows, value), value)


@pytest.mark.parametrize("values", ["1e9 + id / 2000", "1000 + id / 200000000", "id / 1e9",
                                    "exp(id / 400) * if(id % 2 = 0, 1, -1)"])
def test_values_spread_over_buckets(spark, values):
    """Crowded far from zero, crowded closer, small, and of many magnitudes."""
    out = bucketed(spark.range(200_000).selectExpr(f"double({values}) AS v"))
    sizes = out.groupBy(ranks.BUCKET).count()
    got = sizes.agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).first()
    assert got["n"] > 20_000 and got["most"] < 1000


def test_buckets_never_fall(spark):
    rng = random.Random(1)
    values = sorted({rng.choice((-1, 1)) * 10 ** rng.uniform(-14, 307) for _ in range(3000)}
                    | {0.0, 5e-324, 1e-323, 1.7e308, -1.7e308})
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(5)
    found = [r[0] for r in bucketed(df).orderBy("i").select(ranks.BUCKET).collect()]
    assert found == sorted(found) and len(set(found)) > 2000


def test_quantiles_of_crowded_values_and_a_hot_value(spark):
    """A third of all rows is one value; the rest lies within 100 of a billion or spans magnitudes."""
    rng = np.random.default_rng(9)
    values = np.concatenate([np.full(5000, 1e9 + 3), 1e9 + 100 * rng.random(5000),
                             10.0 ** rng.uniform(-9, 12, 5000)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(6)
    shares = {f"q{i}": i / 50 for i in range(51)}
    got = ranks.quantiles(df, [], "v", shares).first()
    for name, p in shares.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-14)
    firsts = {r.v: (r.first_rank, r.ties, r.n) for r in ranks.ranked_values(df, [], "v").collect()}
    order = np.sort(values)
    for v, (first, ties, n) in firsts.items():
        left, right = np.searchsorted(order, [v], "left")[0], np.searchsorted(order, [v], "right")[0]
        assert (first, ties, n) == (left + 1, right - left, 15000)


def test_ranks_of_nothing(spark):
    none = spark.createDataFrame([], "site string, v double")
    assert ranks.quantiles(none, ["site"], "v", {"m": 0.5}).count() == 0
    assert ranks.ranked_values(none, ["site"], "v").count() == 0


def test_ranks_of_a_hot_narrow_group_and_of_null_keys(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": 1000 + rng.random(4000), None: np.round(rng.normal(size=300), 1),
              "odd": np.array([-5.0, -4.0, 1.0, 2.0, 3.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    rows += [("odd", float("nan")), ("odd", float("inf")), ("odd", None)]
    df = spark.createDataFrame(rows, "site string, v double").repartition(7)
    got = {r["site"]: r for r in ranks.quantiles(df, ["site"], "v", {"q": 0.3, "m": 0.5}).collect()}
    assert set(got) == set(groups)
    for site, values in groups.items():
        assert got[site]["n"] == len(values)
        assert got[site]["q"] == pytest.approx(np.quantile(values, 0.3), rel=1e-12)
        assert got[site]["m"] == pytest.approx(np.quantile(values, 0.5), rel=1e-12)


def test_rows_with_null_keys_stay(spark):
    rows = [("a", 1, 1.0), (None, 1, 2.0), (None, 3, None)]
    df = spark.createDataFrame(rows, "site string, step long, v double")
    carried = chunks.carry(df, ["site"], "step", {"last": F.col("v")}, chunk_steps=2)
    assert carried.columns == ["site", "step", "v", "last"]
    assert {(r["site"], r["step"], r["last"]) for r in carried.collect()} == {
        ("a", 1, 1.0), (None, 1, 2.0), (None, 3, 2.0)}
    summed = chunks.running_sum(df, ["site"], "step", {"s": F.col("v")}, chunk_steps=2)
    assert {(r["site"], r["step"], r["s"]) for r in summed.collect()} == {
        ("a", 1, 1.0), (None, 1, 2.0), (None, 3, 2.0)}
    dense = chunks.densify(df, ["site"], "step", chunk_steps=2)
    assert {(r["site"], r["step"], r["v"]) for r in dense.collect()} == {
        ("a", 1, 1.0), (None, 1, 2.0), (None, 2, None), (None, 3, None)}


def test_two_levels_of_chunks(spark):
    """Chunks of two steps cut again into chunks of two: many summaries of summaries."""
    df = spark.range(200).select(F.lit("s").alias("site"), "id",
                                 F.when(F.col("id") % 37 == 5, F.col("id")).alias("v"))
    out = chunks.carry(df, ["site"], "id", {"p": F.col("v")}, {"n": F.col("v")}, chunk_steps=2)
    for r in out.collect():
        past = [i for i in range(200) if i % 37 == 5 and i <= r["id"]]
        later = [i for i in range(200) if i % 37 == 5 and i >= r["id"]]
        assert (r["p"], r["n"]) == (past[-1] if past else None, later[0] if later else None)
    total = chunks.running_sum(df, ["site"], "id", {"t": F.col("id")}, chunk_steps=2)
    assert all(r["t"] == r["id"] * (r["id"] + 1) // 2 for r in total.collect())
