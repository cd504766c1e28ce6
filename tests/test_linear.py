"""The linear family against plain numpy on the smallest table: ridge with
exact leave-one-out choice of alpha (M1, M2, M3a, M3b) by refitting on
explicit matrices, lasso (M4) by its optimality conditions."""

import numpy as np
import pytest

from conftest import SF001
from quotelens.operators import linear as LN
from quotelens.operators.enrich import materialized_quotes


@pytest.fixture(scope="module")
def fitted(spark):
    q = materialized_quotes(spark, SF001)
    scored, fits = LN.fit_linear_cv(q)
    dsg, names = LN.design(q)
    pdf = dsg.toPandas().sort_values("quote_id").reset_index(drop=True)
    up = q.select("quote_id", "unit_price").toPandas().set_index("quote_id").unit_price
    pred = scored.select("quote_id", "model", "pred").toPandas().pivot(index="quote_id", columns="model", values="pred")
    return pdf, names, up.loc[pdf.quote_id].to_numpy(), pred.loc[pdf.quote_id], {(f["model"], f["fold"]): f for f in fits}


def col(pdf, name):
    return pdf[LN._safe(name)].to_numpy(float)


def ridge(x, y):
    mu, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 1e-12, sd, 1.0)
    z, yc = (x - mu) / sd, y - y.mean()
    best = None
    for a in LN.RIDGE_ALPHAS:
        inv = np.linalg.inv(z.T @ z + a * np.eye(z.shape[1]))
        beta = inv @ z.T @ yc
        r = yc - z @ beta
        h = 1 / len(y) + np.einsum("ij,jk,ik->i", z, inv, z)
        loo = ((r / (1 - h)) ** 2).sum()
        if best is None or loo < best[0]:
            best = (loo, a, beta, (r ** 2).mean())
    _, a, beta, var = best
    return a, var, lambda m: y.mean() + ((m - mu) / sd) @ beta


def slope(x, y):
    return np.cov(x, y, bias=True)[0, 1] / x.var()


@pytest.mark.parametrize("model", ["M1", "M2", "M3a", "M3b"])
def test_ridge_models_equal_numpy(fitted, model):
    pdf, _, up, pred, fits = fitted
    fold, part = pdf.fold.to_numpy(), pdf.part.to_numpy()
    lq, rush, price = col(pdf, "log_quantity"), col(pdf, "rush_job"), pdf.actual.to_numpy(float)
    x = np.column_stack([col(pdf, c) for c in LN._x_cols(LN.RIDGE_SPECS[model][0])])
    for k in range(LN.K):
        tr, te = fold != k, fold == k
        shift = np.zeros(len(pdf))
        if model in ("M3a", "M3b"):
            slopes = np.full(len(pdf), slope(lq[tr], np.log(up[tr])))
            if model == "M3b":
                for p in set(part):
                    own = tr & (part == p)
                    if own.sum() >= 5:
                        slopes[part == p] = slope(lq[own], np.log(up[own]))
            ratio = np.median(up[tr & (rush == 1)]) / np.median(up[tr & (rush == 0)])
            shift = slopes * lq + rush * np.log(ratio)
        y = price if model == "M1" else np.log(price) if model == "M2" else np.log(up) - shift
        a, var, f = ridge(x[tr], y[tr])
        want = f(x[te])
        if model == "M1":
            want = np.maximum(want, 0)
        else:
            want = np.exp(want + var / 2 + (shift[te] + lq[te] if model in ("M3a", "M3b") else 0))
        assert fits[model, k]["alpha"] == a
        assert np.allclose(pred[model].to_numpy()[te], want, rtol=1e-8)


def test_lasso_meets_its_optimality_conditions(fitted):
    pdf, _, _, _, fits = fitted
    x = np.column_stack([col(pdf, c) for c in LN._m4_cols()])
    y = np.log(pdf.actual.to_numpy(float))
    for k in range(LN.K):
        tr = pdf.fold.to_numpy() != k
        fit = fits["M4", k]
        r = y[tr] - fit["intercept"] - x[tr] @ fit["coef"]
        sd = x[tr].std(0)
        live = sd > 1e-12
        grad = ((x[tr] - x[tr].mean(0)) / np.where(live, sd, 1)).T @ r / tr.sum()
        used = np.abs(fit["coef"] * sd) > 1e-9
        assert (np.abs(grad[live]) <= fit["alpha"] + 1e-6).all()
        assert np.allclose(grad[used & live], fit["alpha"] * np.sign(fit["coef"][used & live]), atol=1e-6)
        assert fit["alpha"] in LN.LASSO_ALPHAS and abs(r.mean()) < 1e-8
