"""Model versions, request quoting, replayed appends and effective
parameters."""

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from quotelens.operators import linear as LN
from quotelens.operators import models as M
from quotelens.plans import q_linear as QL
from quotelens.plans import q_requests as QR
from quotelens.operators.enrich import materialized_quotes
from quotelens.streaming.requests import append_batch


def test_a_reloaded_version_scores_as_the_fit_and_rolls_back(spark, tmp_path):
    q, fitted = materialized_quotes(spark, SF001), QL.model_tables(spark, SF001)
    root = str(tmp_path / "models")
    with pytest.raises(ValueError):
        M.current_version(spark, root)
    first = M.publish(fitted, root, "one")
    loaded = M.load(spark, root)
    q = q.where("fold = 2")
    a = M.score_wide(q, fitted, folds=[2]).select("quote_id", "preds.*").toPandas().sort_values("quote_id", ignore_index=True)
    b = M.score_wide(q, loaded, folds=[2]).select("quote_id", "preds.*").toPandas().sort_values("quote_id", ignore_index=True)
    assert a.equals(b)
    second = M.publish({k: fitted[k] for k in ("m0_levels", "m0_scalars")}, root, "two")
    assert M.current_version(spark, root) == second and set(M.load(spark, root)) == {"m0_levels", "m0_scalars"}
    M.point_to(spark, root, first)
    assert M.current_version(spark, root) == first and set(M.load(spark, root)) == set(fitted)
    assert [r["version"] for r in M.history(spark, root).orderBy("seq").collect()] == ["one", "two", "one"]
    (tmp_path / "models" / "version=broken" / "linear").mkdir(parents=True)
    with pytest.raises(ValueError):
        M.point_to(spark, root, "broken")
    assert M.current_version(spark, root) == first


def test_coefficients_survive_the_table(spark):
    fits = LN.load_fits(QL.model_tables(spark, SF001)["linear"].where("model in ('M2', 'M3b')"))
    assert len(fits) == 12
    back = {(f["model"], f["fold"]): f for f in LN.load_fits(LN.coefficient_table(spark, fits))}
    for f in fits:
        g = back[(f["model"], f["fold"])]
        assert g["x"] == f["x"] and (g["coef"] == f["coef"]).all()
        assert all(g.get(k) == f.get(k) for k in ("intercept", "resid_var", "slope", "log_rush", "part_slopes"))


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    df, path = spark.range(10).toDF("id"), str(tmp_path / "out")
    append_batch(df, path, 0)
    append_batch(df.where("id < 4"), path, 1)
    append_batch(df, path, 0)
    assert spark.read.parquet(path).count() == 14


@pytest.fixture(scope="module")
def quoted(spark):
    return QR.q01(spark, SF001).cache()


def test_requests_without_estimator_use_their_own_rule(spark):
    r = QR.requests_table(spark, SF001)
    tables = {k: v for k, v in QL.model_tables(spark, SF001).items()}
    from quotelens.operators.parse import with_parsed_description
    blind = with_parsed_description(r.where("estimator is null").limit(20))
    got = {x["request_id"]: x for x in M.score_requests(blind, tables).collect()}
    each = [M.score_requests(blind.withColumn("estimator", F.lit(e)), tables).collect() for e in ("Sato-san", "Suzuki-san", "Tanaka-san")]
    for rows in zip(*[sorted(e, key=lambda x: x["request_id"]) for e in each]):
        mine = got[rows[0]["request_id"]]
        for m in ("M2", "M6", "M8"):
            assert abs(mine["preds"][m] - sorted(x["preds"][m] for x in rows)[1]) < 1e-6
        assert mine["preds"]["M9"] == rows[0]["preds"]["M9"] and mine["preds"]["M0"] == rows[0]["preds"]["M0"]
        assert set(mine["estimator_range"]) == {"Sato-san", "Suzuki-san", "Tanaka-san"}


def test_quotes_have_warnings_and_explanations(quoted):
    total = quoted.count()
    drafts = quoted.where("status = 'draft'")
    assert 0 < drafts.count() < total and quoted.where("status = 'rejected' and estimate is not null").count() == 0
    assert drafts.where("estimate is null or size(explanation) != 10").count() == 0
    assert drafts.where("not (win_bid < estimate and estimate < protect_margin)").count() == 0
    blind = drafts.where("array_contains(warnings, 'No estimator provided — using debiased consensus')")
    assert blind.count() == drafts.where("estimator_range is not null").count() > 0
    assert blind.where("explained_model != 'M9'").count() == 0


def test_effective_parameters(spark):
    n = {r["model"]: r["effective_params"] for r in QL.l07(spark, SF001).collect()}
    assert len(n) == 14 and all(v and v > 0 for v in n.values()) and n["M5"] > n["M6"] and n["M8"] > n["M6"]
