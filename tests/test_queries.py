"""Registered queries against their SQL. SUNLEDGER_ALL=1 runs every one of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
CORE = [
    "power_csv_scan", "station_lookup", "power_issue_log", "coverage_summary", "outlier_profile",
    "missingness", "interpolate_both", "impute_causal", "robust_bounds", "flatlines",
    "solar_position", "clear_sky_scale", "feature_table", "weather_regimes", "supervised_targets",
    "forecast_scores", "stratified_metrics", "coverage_table", "bootstrap_skill",
    "diebold_mariano", "signed_ranks_by_row", "autocorrelation", "permutation_importance",
    "transfer_table", "matrix_coverage",
]
NAMES = sorted(entry.queries()) if os.environ.get("SUNLEDGER_ALL") else CORE

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in entry.oracle_sql():
        assert compare(df, con, entry.oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_weights_of_dense_readings_against_sql(spark, tmp_path):
    """Every bin is far above the capacity, so the smart forecast a day ahead does not vary within a site."""
    folder, con = str(tmp_path), duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(15 * (i // 5) + 5) AS ts, i AS user_id,
        ['click', 'error', 'purchase', 'signup', 'view'][i % 5 + 1] AS event_type, 3000 + (i * 7919 % 4001) / 4 AS value,
        '{{"k": 1}}' AS props FROM range(5 * 2880) t(i)) TO '{folder}/events.parquet' (FORMAT parquet)""")
    df = entry.queries()["pooled_fits_scaled"](spark, folder)
    assert df.where("isnan(weight_x) AND isnan(weight_z)").count() > 0
    assert compare(df, duck(folder), entry.oracle_sql()["pooled_fits_scaled"]) is None


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
