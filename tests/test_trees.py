"""Grouped-cell trees against plain definitions: one tree against an
exhaustive search, predictions against a walk over the node table, attribution
against the sum over all subsets, ordering of the models on planted prices."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from quotelens.operators import attribution as AT
from quotelens.operators import models as M
from quotelens.operators import trees as TR
from quotelens.operators.enrich import materialized_quotes
from quotelens.plans import q_linear as QL


@pytest.fixture(scope="module")
def quotes(spark):
    return materialized_quotes(spark, SF001)


@pytest.fixture(scope="module")
def tables(spark):
    return QL.model_tables(spark, SF001)


@pytest.fixture(scope="module")
def wide(spark):
    return QL.oof_wide(spark, SF001)


def test_keys_hold_the_features(spark, quotes):
    from quotelens.functions.features import feature_columns
    pdf = quotes.select(TR.cell_key().alias("_key"), *feature_columns("label", True)).limit(800).toPandas()
    x = TR.unpack(pdf.pop("_key").to_numpy())
    want = pdf[TR.FEATURES].to_numpy(float)
    step = TR.FEATURES.index("log_quantity")
    assert np.allclose(np.delete(x, step, 1), np.delete(want, step, 1))
    order = np.argsort(want[:, step], kind="stable")
    assert (np.diff(x[order, step]) >= 0).all()
    for v in np.unique(want[:, step]):
        assert len(np.unique(x[want[:, step] == v, step])) == 1
    assert len(np.unique(x[:, step])) == len(np.unique(want[:, step]))


def test_one_split_equals_exhaustive_search(quotes):
    pdf = TR.cells(quotes).groupBy("key").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).toPandas()
    x, n, y = TR.unpack(pdf.key.to_numpy()), pdf.n.to_numpy(), pdf.y.to_numpy()
    g = TR.Grower(x, (), np.random.default_rng(0))
    feature, cut, value, cover = g.tree(y - n * (y.sum() / n.sum()), n, 1, 5, 0.0, np.arange(len(g.used)), slice(0, len(x)))
    best = min((sum(((y[s] / n[s] - y[s].sum() / n[s].sum()) ** 2 * n[s]).sum() for s in (x[:, f] <= c, x[:, f] > c)), f, c)
               for f in range(x.shape[1]) for c in np.unique(x[:, f])[:-1]
               if min(n[x[:, f] <= c].sum(), n[x[:, f] > c].sum()) >= 5)
    f, c = g.used[feature[0]], g.cuts[feature[0]][cut[0]]
    left = x[:, f] <= c
    got = sum(((y[s] / n[s] - y[s].sum() / n[s].sum()) ** 2 * n[s]).sum() for s in (left, ~left))
    assert got <= best[0] * (1 + 1e-6)
    assert abs(cover[1] - n[left].sum()) < 1e-6


def walk(nodes, x):
    """The value of one row by walking each tree of a fit."""
    total = 0.0
    for t, rows in nodes.groupby("tree"):
        rows = rows.set_index("node")
        if t < 0:
            total += rows.loc[0, "value"]
            continue
        at = 0
        while rows.loc[at, "left"] >= 0:
            r = rows.loc[at]
            at = int(r["right"] if x[TR.FEATURES.index(r["feature"])] > np.float32(r["threshold"]) else r["left"])
        total += rows.loc[at, "value"]
    return total


@pytest.mark.parametrize("model", ["M5", "M6", "M7", "M9"])
def test_scores_are_walks_over_the_node_table(quotes, tables, model):
    nodes = tables["trees"].where((F.col("model") == model) & (F.col("fold") == TR.ALL)).toPandas()
    forests = TR.Forests(nodes)
    keys = quotes.select(TR.cell_key().alias("k")).limit(6).toPandas().k.to_numpy()
    x = TR.unpack(keys)
    raw = forests.raw((model, -1, TR.ALL), x)
    want = [walk(nodes, r) for r in x]
    assert np.allclose(raw, want, rtol=1e-6)
    var = nodes[nodes.tree < 0].threshold.iloc[0]
    price = np.exp(raw + var / 2) if TR.SPECS[model][6] else np.maximum(raw, 0)
    assert np.allclose(forests.predict(model, TR.ALL, x), price)


def test_an_unknown_estimator_gets_the_mean_of_the_estimators_models(quotes, tables):
    forests = TR.load_forests(tables["trees"].where((F.col("model") == "M8") & (F.col("fold") == TR.ALL)))
    x = TR.unpack(quotes.select(TR.cell_key().alias("k")).limit(5).toPandas().k.to_numpy())
    e = TR.FEATURES.index("estimator")
    each = []
    for p in range(3):
        y = x.copy()
        y[:, e] = p
        each.append(forests.predict("M8", TR.ALL, y))
    x[:, e] = -1
    assert np.allclose(forests.predict("M8", TR.ALL, x), np.mean(each, 0))


def test_models_learn_and_log_targets_win(wide):
    names = M.scored_models(wide)
    assert names == ["M0", "M1", "M2", "M3a", "M3b", "M4", "M5", "M6", "M6b", "M7", "M7b", "M7c", "M8", "M9"]
    ape = {m: F.avg(F.abs(F.col(f"preds.{m}") / F.col("actual") - 1)).alias(m) for m in names}
    mape = wide.agg(*ape.values()).first()
    assert mape["M7"] < mape["M6"] < mape["M0"] and mape["M7c"] < mape["M7b"] < mape["M0"] and mape["M5"] < mape["M0"]
    assert mape["M2"] < mape["M1"] and mape["M6"] < mape["M6b"] and all(mape[m] is not None for m in names)


def test_fits_leave_their_fold_out(quotes):
    folds = TR.fit_trees(quotes, ["M9"], [0, TR.ALL]).where("tree = -1").toPandas().set_index("fold").cover
    counts = {r["fold"]: r["count"] for r in quotes.groupBy("fold").count().collect()}
    assert folds[TR.ALL] == sum(counts.values()) and folds[0] == sum(counts.values()) - counts[0]


def subset_value(nodes, x, known):
    """Expected value when only ``known`` features are seen: walk both ways,
    by cover, where the split's feature is not."""
    total = 0.0
    for t, rows in nodes.groupby("tree"):
        rows = rows.set_index("node")
        if t < 0:
            total += rows.loc[0, "value"]
            continue

        def go(i):
            r = rows.loc[i]
            if r["left"] < 0:
                return r["value"]
            if r["feature"] in known:
                return go(int(r["right"] if x[TR.FEATURES.index(r["feature"])] > np.float32(r["threshold"]) else r["left"]))
            left, right = rows.loc[int(r["left"])], rows.loc[int(r["right"])]
            return (left["cover"] * go(int(r["left"])) + right["cover"] * go(int(r["right"]))) / r["cover"]
        total += go(0)
    return total


def test_attribution_equals_all_subsets(quotes, tables):
    nodes = tables["trees"].where((F.col("model") == "M6") & (F.col("fold") == TR.ALL) & (F.col("tree") < 4)).toPandas()
    forests = TR.Forests(nodes)
    x = TR.unpack(quotes.select(TR.cell_key().alias("k")).limit(3).toPandas().k.to_numpy())
    explainer = AT.Explainer(forests.fits[("M6", -1, TR.ALL)])
    got = explainer.contributions(x)
    used = sorted(set(nodes.feature.dropna()) - {"__base__"})
    m = len(used)
    for i, row in enumerate(x):
        value = {s: subset_value(nodes, row, set(s)) for k in range(m + 1) for s in combinations(used, k)}
        assert abs(value[()] - explainer.expected) < 1e-6 * abs(value[()])
        for f in used:
            rest = [u for u in used if u != f]
            want = sum(factorial(k) * factorial(m - k - 1) / factorial(m)
                       * (value[tuple(sorted((*s, f)))] - value[s]) for k in range(m) for s in combinations(rest, k))
            assert abs(got[i, TR.FEATURES.index(f)] - want) < 1e-4 * max(1, abs(want))


def test_contributions_and_base_add_up(quotes, tables):
    forests = TR.load_forests(tables["trees"].where(F.col("fold") == TR.ALL))
    for model in ("M5", "M6", "M7", "M9"):
        rows = AT.tree_attribution(quotes.select(TR.cell_key().alias("_key")).limit(300), forests, model, TR.ALL).toPandas()
        total = rows.base + np.stack(rows.contributions).sum(1)
        assert np.allclose(total, forests.raw((model, -1, TR.ALL), TR.unpack(rows._key.to_numpy())), rtol=1e-6)
