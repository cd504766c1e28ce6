"""Driver contract and planted-truth checks on the small tables."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"dimension", "category", "mean_unit_price", "std_unit_price", "n",
                               "median_unit_price"}


def test_oracles_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_planted_truth(spark):
    q = E.queries()
    vd = q["a03_volume_discount"](spark, SF001).first()
    assert -0.25 < vd["slope"] < -0.13
    rp = q["a05_rush_premium"](spark, SF001).first()
    assert 1.4 < rp["marginal_ratio"] < 1.7


def test_m0_beats_nothing_and_log_models_beat_additive(spark):
    s = {r["model"]: r["MAPE_mean"] for r in E.queries()["a15_cv_summary_all_models"](spark, SF001).collect()}
    assert s["M2"] < s["M1"]
    assert s["M2"] < s["M0"]
    assert min(s.values()) > 0


def test_bootstrap_ci_contains_mean(spark):
    r = E.queries()["m14_bias_bootstrap_ci"](spark, SF001)
    for row in r.collect():
        assert row["ci_95_low"] <= row["mean_pct_bias"] <= row["ci_95_high"]
