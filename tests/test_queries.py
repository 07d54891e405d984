"""Named queries against their SQL at the smallest scale.

A spread of queries runs by default; FLEETLENS_ALL=1 runs every one.
"""

import math
import os

import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
QUICK = [
    "label_from_filename", "file_catalog", "history_scan", "apply_threshold", "repredict", "strategy_union", "split_benign",
    "sample_stratified", "prevalence_resample", "structural_summary", "device_family_pivot", "duplicate_summary_global",
    "scale_profile", "feature_correlation", "score_summary", "ks_train_val", "threshold_criteria", "confusion_matrix",
    "device_metrics", "extreme_recall_pivot", "mcc_threshold", "score_histogram", "roc_curve", "operational_metrics",
    "scalability_table", "best_trial", "scaler_fit", "lof_score", "ae_score_mse", "stream_score", "prepare_run", "run_summary_scan",
    "lof_refit_scores", "ae_train_step", "pca_2d", "threshold_comparison_fleet",
]
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("FLEETLENS_ALL") else QUICK
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    at = [names.index(c) for c in columns]
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    expected = sorted((tuple(_plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    assert got == expected


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() == 9


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
