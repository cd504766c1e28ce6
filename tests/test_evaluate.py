"""Metrics and significance against published fold results (golden
chain: fold results -> comparison, permutation, Wilcoxon, hypotheses)."""

import csv
import os

import pytest

from quotelens.operators import evaluate as EV
from conftest import DATA


def _csv(name):
    with open(os.path.join(DATA, name)) as f:
        return list(csv.DictReader(f))


@pytest.fixture(scope="module")
def folds(spark):
    rows = [(r["model"], int(r["fold"]), float(r["MAPE"]), float(r["MedAPE"]), float(r["RMSE"]), float(r["R2"]))
            for r in _csv("cv_fold_results.csv")]
    return spark.createDataFrame(rows, "model string, fold int, MAPE double, MedAPE double, RMSE double, R2 double")


def test_metrics_vector(spark):
    oof = spark.createDataFrame([("M", 0, 100.0, 110.0), ("M", 0, 200.0, 190.0), ("M", 0, 300.0, 330.0)],
                                "model string, fold int, actual double, pred double")
    r = EV.fold_metrics(oof).first()
    assert abs(r["MAPE"] - 8.3333333) < 1e-4
    assert abs(r["MedAPE"] - 10.0) < 1e-9
    assert abs(r["RMSE"] - 19.1485) < 1e-4


def test_comparison_table(folds):
    got = {r["model"]: r for r in EV.comparison_table(folds).collect()}
    for r in _csv("model_comparison.csv"):
        g = got[r["model"]]
        for c in ("MAPE_mean", "MAPE_std", "RMSE_mean", "R2_mean"):
            assert abs(g[c] - float(r[c])) < 1e-3, (r["model"], c)


@pytest.mark.parametrize("fn,name", [(EV.permutation_test, "significance_tests_permutation.csv"),
                                     (EV.wilcoxon_test, "significance_tests_wilcoxon.csv")])
def test_pairwise(folds, fn, name):
    got = {(r["model_a"], r["model_b"]): r for r in fn(folds).collect()}
    want = _csv(name)
    assert len(got) == len(want) == 91
    for r in want:
        g = got[(r["model_a"], r["model_b"])]
        assert abs(g["p_value"] - float(r["p_value"])) < 1e-9
        assert abs(g["diff"] - float(r["diff"])) < 1e-3
        assert g["significant"] == (r["significant"] == "True")


def test_hypotheses(folds):
    got = {r["hypothesis"]: r for r in EV.resolve_hypotheses(EV.comparison_table(folds),
                                                              EV.permutation_test(folds)).collect()}
    for r in _csv("hypothesis_resolution.csv"):
        g = got[r["hypothesis"]]
        assert g["winner"] == r["winner"]
        assert abs(g["p_value"] - float(r["p_value"])) < 1e-9


def test_no_cap_on_folds(spark):
    """22 folds that differ by 2 points each: both tests are exact."""
    rows = [(m, f, 10.0 + f / 7 + (2.0 + f / 100 if m == "B" else 0.0)) for m in "AB" for f in range(22)]
    df = spark.createDataFrame(rows, "model string, fold int, MAPE double")
    w = EV.wilcoxon_test(df).first()
    assert abs(w["p_value"] - 2 / 2**22) < 1e-12 and w["significant"]
    p = EV.permutation_test(df.where("fold < 16")).first()
    assert abs(p["p_value"] - 2 / 2**16) < 1e-12
    many = spark.createDataFrame([(m, f, float(f)) for m in "AB" for f in range(30)], "model string, fold int, MAPE double")
    with pytest.raises(ValueError):
        EV.permutation_test(many)


def test_wilcoxon_with_ties_equals_enumeration(spark):
    d = [1.0, -1.0, 2.0, 2.0, 0.0, 3.5, -2.0, 4.0]
    rows = [("A", f, 10.0 + x) for f, x in enumerate(d)] + [("B", f, 10.0) for f in range(len(d))]
    got = EV.wilcoxon_test(spark.createDataFrame(rows, "model string, fold int, MAPE double")).first()["p_value"]
    nz = [x for x in d if x]
    order = sorted(abs(x) for x in nz)
    rank = [sum(i + 1 for i, o in enumerate(order) if o == abs(x)) / order.count(abs(x)) for x in nz]
    plus = sum(r for r, x in zip(rank, nz) if x > 0)
    sums = [sum(r for i, r in enumerate(rank) if m >> i & 1) for m in range(1 << len(rank))]
    le, ge = sum(s <= plus + 1e-9 for s in sums), sum(s >= plus - 1e-9 for s in sums)
    assert abs(got - min(1.0, 2 * min(le, ge) / len(sums))) < 1e-12
