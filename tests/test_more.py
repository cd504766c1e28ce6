"""Refit stability against explicit refits, folds, rolling means, permutation
importance and aligned columns against plain versions."""

import datetime

import numpy as np
from conftest import SF001
from pyspark.sql import functions as F

from quotelens.operators import alarms as AL
from quotelens.operators import importance as IM
from quotelens.operators import linear as LN
from quotelens.operators import propensity as PP
from quotelens.operators import stability as ST
from quotelens.operators import trees as TR
from quotelens.operators.align import align
from quotelens.operators.bias import poisson_weights
from quotelens.operators.enrich import materialized_quotes
from quotelens.plans import q_linear as QL


def test_refits_equal_explicit_weighted_fits(spark):
    q = materialized_quotes(spark, SF001).where("fold < 2")
    fits = LN.load_fits(QL.model_tables(spark, SF001)["linear"].where("model in ('M1', 'M2')"))
    got = {r["model"]: r for r in ST.refit_stability(q, fits, models=("M1", "M2"), replicates=4).collect()}
    d, _ = LN.design(q)
    pdf = d.select("*", ST.row_hash().alias("h")).toPandas()
    draws = poisson_weights(pdf.h.to_numpy(np.int64).view(np.uint64), 0, 4)
    for model in ("M1", "M2"):
        f = next(x for x in fits if x["model"] == model and x["fold"] == LN.ALL)
        x = pdf[[LN._safe(c) for c in f["x"]]].to_numpy(float)
        y = pdf[LN._safe("y_price" if model == "M1" else "y_log_price")].to_numpy(float)
        prices = []
        for b in range(4):
            i = np.repeat(np.arange(len(x)), draws[:, b].astype(int))  # rows as often as they were drawn
            mu, sd = x[i].mean(0), x[i].std(0)
            sd = np.where(sd > 1e-12, sd, 1.0)
            z = (x[i] - mu) / sd
            beta = np.linalg.solve(z.T @ z + f["alpha"] * np.eye(z.shape[1]), z.T @ (y[i] - y[i].mean()))
            value = ((x - mu) / sd) @ beta + y[i].mean()
            var = ((y[i] - y[i].mean() - z @ beta) ** 2).mean()
            prices.append(np.maximum(value, 0) if model == "M1" else np.exp(value + var / 2))
        p = np.array(prices)
        cv = p.std(0) / np.maximum(p.mean(0), 1)
        assert abs(got[model]["mean_cv"] - cv.mean()) < 1e-6 * cv.mean() and abs(got[model]["max_cv"] - cv.max()) < 1e-5 * cv.max()


def test_stratified_folds_are_even(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "b") for i in range(1000)], "quote_id long, label string").repartition(7)
    rows = PP.stratified_folds(df, "label", "quote_id").toPandas().sort_values("quote_id")
    for _, g in rows.groupby("label"):
        assert (g.fold.to_numpy() == np.arange(len(g)) % 5).all()


def test_propensity_sees_a_planted_rule(spark):
    q = materialized_quotes(spark, SF001).limit(1500)
    blind = PP.verdict(PP.propensity(q, trees=20)).first()
    dealt = q.withColumn("estimator", F.when(F.col("quantity") <= 5, "Sato-san").when(F.col("quantity") <= 20, "Suzuki-san").otherwise("Tanaka-san"))
    ruled = PP.verdict(PP.propensity(dealt, trees=20)).first()
    assert ruled["confounded"] and ruled["mean_accuracy"] > 0.9 > blind["mean_accuracy"]


def test_rolling_mean_equals_a_range_frame(spark):
    r = np.random.default_rng(3)
    t0 = datetime.datetime(2024, 1, 1)
    at = np.sort(np.r_[r.integers(0, 4 * 86400, 400), r.integers(7 * 86400, 7 * 86400 + 90, 300), [86400 * 10, 86400 * 11, 86400 * 11]])
    rows = [(i, t0 + datetime.timedelta(seconds=int(s)), float(r.normal())) for i, s in enumerate(at)]
    df = spark.createDataFrame([*rows, (999, t0, None)], "event_id long, event_time timestamp, v double")
    got = {x["event_id"]: x for x in AL.rolling_mean(df, "v").collect()}
    assert len(got) == len(rows)
    v = np.array([x[2] for x in rows])
    for i, s in enumerate(at):
        inside = (at >= s - 86400) & (at <= s)
        assert got[i]["n_24h"] == inside.sum() and abs(got[i]["mean_24h"] - v[inside].mean()) < 1e-9


def test_importance_tells_features_apart(spark):
    q = materialized_quotes(spark, SF001)
    forests = TR.load_forests(QL.model_tables(spark, SF001)["trees"].where("fold = 5 and model = 'M7'"))
    got = {r["feature"]: r["importance"] for r in IM.permutation_importance(q, forests, "M7").collect()}
    assert got["quantity"] > 20 and got["base_part_type"] > 10 and abs(got["lead_time_weeks"]) < 2 and len(got) == 8


def test_numbering_is_a_permutation(spark):
    rows = PP.numbered(spark.range(500).toDF("id"), F.xxhash64("id"), "id", "place").toPandas()
    assert sorted(rows.place) == list(range(500)) and (rows.sort_values("id").place.to_numpy() != np.arange(500)).any()


def test_aligned_columns(spark):
    df = spark.createDataFrame([(1, None, 5)], "b int, a int, x int")
    out = align(df, ["a", "b", "c"], -1.0)
    assert out.columns == ["a", "b", "c"] and tuple(out.first()) == (-1.0, 1.0, -1.0)
