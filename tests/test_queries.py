"""The registry, and a sample of its queries against their SQL."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "x1_count", "x1_running", "x4_event_count", "x6_clip_mean", "x7_first_correct", "x9_by_position", "x13_click_spread",
    "prior_join", "eligible_train", "eligible_test", "robust_scale", "stratified_folds", "quadratic_kappa", "session_last_row",
    "anchors_without", "join_skewed", "fold_average", "x9_null_title", "x3_null_title", "folds_null_label", "prior_mean_nulls",
    "running_std_large", "matrix_null_title", "log_loss", "pivot_counts",
]
ROWS_ONLY = {"fit_score", "holdout_scores", "oof_kappa", "out_of_fold", "predict_test"}

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")


def test_every_query_but_the_models_has_sql():
    own = {name for name in entry.queries() if name != "pipeline" and not name.startswith("op")}
    assert own - set(entry.oracle_sql()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) == []


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "game_session" and df.count() > 0
