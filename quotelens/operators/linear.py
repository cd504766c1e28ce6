"""Linear pricing models M1-M4 from sufficient statistics.

Pass 1 (one scan): every task accumulates A'A for A = [1, features,
targets] per (outer fold, inner fold) cell with numpy (``mapInArrow``);
the cells are summed by an aggregate. Only (#cells x width^2) numbers
reach the driver -- bounded by the feature count, never by rows. A task
is given the few columns that the others follow from (``compact``) and
makes the matrix itself (``expand``); no design row is shuffled or written.

* Ridge (M1, M2, M3a, M3b): columns standardized with the training
  fold's population std, intercept free, alpha from logspace(-2, 4, 20)
  by exact leave-one-out error ``r / (1 - h)`` (pass 2: one more scan,
  leverages from the eigen-decomposition of the fold's Gram matrix).
* Lasso (M4): coordinate descent on the Gram matrices; alpha from
  logspace(-4, 2, 30) by 5-fold inner CV on hash-assigned inner folds
  (the inner split is a hash, not contiguous blocks).

Scoring makes the features in the same way and multiplies a batch with the
coefficients of its folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.features import feature_columns, feature_names
from ..session import Shared
from .cv import discount_slopes
from .quantiles import weighted_quantiles

K = S.N_FOLDS
#: The fold number that stands for a fit on all rows; FITS are all of them.
ALL = K
FITS = range(K + 1)
RIDGE_ALPHAS = np.logspace(-2, 4, 20)
LASSO_ALPHAS = np.logspace(-4, 2, 30)
PARTS = S.BASE_PART_TYPES + [S.UNKNOWN_PART]


#: Names of the rows of a coefficient table that are no features.
INTERCEPT, LOG_RUSH, SLOPE, PART_SLOPE = "__intercept__", "__log_rush__", "__slope__", "__slope__:"


def _safe(name: str) -> str:
    return "c_" + "".join(ch if ch.isalnum() else "_" for ch in name)


def design(q: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Feature matrix for the linear family, one row per quote.
    Returns the frame and the ordered list of matrix column names; the
    columns in ``keep`` go along."""
    base = feature_names("onehot", True)
    d = q.select("quote_id", "fold", "quantity", F.col("rush_job").alias("rush_raw"), "base_part_type", "unit_price",
                 "total_price_usd", "quote_date", "material", "part_description", "estimator", *keep,
                 *feature_columns("onehot", True))
    extra = {"days_since_epoch": F.datediff(F.col("quote_date"), F.lit("2023-01-01").cast("date")).cast("double")}
    rush = F.col("rush_job").cast("double")
    for c in [c for c in base if c.startswith("material_")]:
        extra[f"rush_x_{c}"] = rush * F.col(f"`{c}`").cast("double")
    for c in [c for c in base if c.startswith("base_part_type_")]:
        extra[f"rush_x_{c}"] = rush * F.col(f"`{c}`").cast("double")
    extra["tier_x_log_qty"] = F.col("material_cost_tier") * F.col("log_quantity")
    extra["rush_x_lead_time"] = rush * F.col("lead_time_weeks").cast("double")
    extra["y_price"] = F.col("total_price_usd")
    extra["y_log_price"] = F.log("total_price_usd")
    extra["y_log_up"] = F.log("unit_price")
    for p in PARTS:
        extra[f"lq_x_{p}"] = F.when(F.coalesce(F.col("base_part_type"), F.lit(S.UNKNOWN_PART)) == p,
                                    F.col("log_quantity")).otherwise(F.lit(0.0))
    names = base + list(extra)
    cols = [F.col(f"`{c}`").cast("double").alias(_safe(c)) for c in base] + \
           [e.cast("double").alias(_safe(n)) for n, e in extra.items()]
    meta = [F.col("total_price_usd").alias("actual"), "material", "part_description", "base_part_type",
            F.col("quantity").alias("quantity"), "estimator", F.col("rush_raw").alias("rush_flag"), "quote_date"]
    out = d.select("quote_id", "fold", inner_fold().alias("inner"), F.coalesce(F.col("base_part_type"),
                   F.lit(S.UNKNOWN_PART)).alias("part"), *keep, *meta, *cols)
    return out, names


def matrix(batch: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    """A row for each of the batch's: 1 and the columns (null: NaN)."""
    a = np.ones((batch.num_rows, len(cols) + 1))
    for i, c in enumerate(cols):
        a[:, i + 1] = batch.column(c).to_numpy(zero_copy_only=False)
    return a


#: Level columns: the categorical feature and the code that each stands for.
LEVELS = {f"{c}_{v}": (c, i) for c in ("base_part_type", "material", "process", "estimator")
          for i, v in enumerate(S.LABEL_CATEGORIES[c])}


def design_names() -> list[str]:
    """The columns of ``design``, in order."""
    base = feature_names("onehot", True)
    return (base + ["days_since_epoch"] + [f"rush_x_{c}" for c in base if c.startswith("material_")]
            + [f"rush_x_{c}" for c in base if c.startswith("base_part_type_")]
            + ["tier_x_log_qty", "rush_x_lead_time", "y_price", "y_log_price", "y_log_up"] + [f"lq_x_{p}" for p in PARTS])


def inner_fold() -> Column:
    """The lasso's inner fold of a quote."""
    return F.pmod(F.conv(F.substring(F.md5(F.col("quote_id")), 9, 8), 16, 10).cast("bigint"), F.lit(K)).cast("int")


def narrow_features() -> list[Column]:
    """The columns that ``expand`` makes every feature of: numbers as they
    are, categories as codes (``part`` among PARTS), days."""
    part = F.array_position(F.array(*[F.lit(p) for p in PARTS]), F.coalesce("base_part_type", F.lit(S.UNKNOWN_PART)))
    days = F.datediff(F.col("quote_date"), F.lit("2023-01-01").cast("date"))
    return [*[c.cast("double").alias(n) for n, c in zip(feature_names("label", True), feature_columns("label", True))],
            (F.coalesce(part, F.lit(0)) - 1).cast("double").alias("part"), days.cast("double").alias("days_since_epoch")]


def compact(q: DataFrame, *others: Column) -> DataFrame:
    """``fold``, the ``others``, ``narrow_features`` and the targets."""
    return q.select("fold", *others, *narrow_features(), F.col("total_price_usd").cast("double").alias("y_price"),
                    F.log("total_price_usd").alias("y_log_price"), F.log("unit_price").alias("y_log_up"))


def expand(columns: dict[str, np.ndarray], names: list[str]) -> np.ndarray:
    """Design columns, one a row of the result, from those of ``compact``
    (null: NaN)."""
    rush, lq = columns["rush_job"], columns["log_quantity"]

    def one(name: str) -> np.ndarray:
        if name in LEVELS:
            of, code = LEVELS[name]
            return columns[of] == code
        if name == "tier_x_log_qty":
            return columns["material_cost_tier"] * lq
        if name == "rush_x_lead_time":
            return rush * columns["lead_time_weeks"]
        if name.startswith("rush_x_"):
            return rush * one(name[len("rush_x_"):])
        if name.startswith("lq_x_"):
            return np.where(columns["part"] == PARTS.index(name[len("lq_x_"):]), lq, 0.0)
        return columns[name]

    out = np.empty((len(names), len(rush)))
    for i, name in enumerate(names):
        out[i] = one(name)
    return out


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}


def cell_grams(q: DataFrame, names: list[str]) -> np.ndarray:
    """(K, K, w, w) array of A'A per (fold, inner) cell, A = [1, columns]."""
    w = len(names) + 1
    schema = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("inner", T.IntegerType()),
                           T.StructField("g", T.ArrayType(T.DoubleType()))])

    def part(batches):
        acc = np.zeros((K, K, w, w))
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = _arrays(batch)
            cell = columns.pop("fold") * K + columns.pop("inner")
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            a = np.ones((w, len(cell)))
            a[1:] = expand({c: v[order] for c, v in columns.items()}, names)
            for c in np.unique(cell):
                am = a[:, np.searchsorted(cell, c):np.searchsorted(cell, c, side="right")]
                acc[c // K, c % K] += am @ am.T
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(K, dtype=np.int32), K)), pa.array(np.tile(np.arange(K, dtype=np.int32), K)),
             pa.array(list(acc.reshape(K * K, w * w)), pa.list_(pa.float64()))], ["fold", "inner", "g"])

    def add(table: pa.Table) -> pa.Table:
        total = np.asarray(table.column("g").combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
        return pa.table({"fold": table.column("fold").slice(0, 1), "inner": table.column("inner").slice(0, 1),
                         "g": pa.array([total], pa.list_(pa.float64()))})

    # the tasks' cells are added as packed arrays in two rounds, so that no group holds those of all tasks
    g = compact(q, inner_fold().alias("inner")).mapInArrow(part, schema)
    g = g.withColumn("salt", F.spark_partition_id() % 64).groupBy("fold", "inner", "salt").applyInArrow(add, schema)
    out = np.zeros((K, K, w * w))
    for r in g.groupBy("fold", "inner").applyInArrow(add, schema).collect():  # K*K arrays bounded by the feature count
        out[r["fold"], r["inner"]] = r["g"]
    return out.reshape(K, K, w, w)


class GramView:
    """Sufficient statistics of one row set: n, sums and cross products."""

    def __init__(self, g: np.ndarray, names: list[str]):
        self.g, self.idx = g, {n: i + 1 for i, n in enumerate(names)}
        self.n = g[0, 0]

    def s(self, a: str) -> float:
        return self.g[0, self.idx[a]]

    def sv(self, cols: list[str]) -> np.ndarray:
        return self.g[0, [self.idx[c] for c in cols]]

    def cross(self, a_cols: list[str], b_cols: list[str]) -> np.ndarray:
        return self.g[np.ix_([self.idx[c] for c in a_cols], [self.idx[c] for c in b_cols])]


def _target_stats(v: GramView, x: list[str], comb: dict[str, float]) -> tuple[float, np.ndarray, float]:
    """Sum y, X'y, y'y for y = sum(w_c * col_c)."""
    keys = list(comb)
    w = np.array([comb[k] for k in keys])
    sy = float(v.sv(keys) @ w)
    xy = v.cross(x, keys) @ w
    yy = float(w @ v.cross(keys, keys) @ w)
    return sy, xy, yy


def _standardize(v: GramView, x: list[str], sy: float, xy: np.ndarray, yy: float):
    n = v.n
    mu = v.sv(x) / n
    cov = v.cross(x, x) / n - np.outer(mu, mu)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    sd = np.where(sd > 1e-12, sd, 1.0)
    gz = n * cov / np.outer(sd, sd)
    ybar = sy / n
    zy = (xy - n * mu * ybar) / sd
    yyc = yy - n * ybar * ybar
    return mu, sd, gz, zy, ybar, yyc


def _ridge_solution(gz, zy, yyc, n, alpha):
    beta = np.linalg.solve(gz + alpha * np.eye(len(zy)), zy)
    rss = yyc - 2 * beta @ zy + beta @ gz @ beta
    return beta, max(rss, 0.0) / n


def _lasso_cd(gn: np.ndarray, bn: np.ndarray, alpha: float, beta0=None, tol=1e-10, max_iter=20000):
    """min 1/2 b'Gb - b'c + alpha |b|_1 (G, c already divided by n) by
    accelerated proximal gradient (FISTA) -- vectorized p x p products on
    the driver; the fitted values of a lasso are unique, so any exact
    solver gives the same predictions."""
    p = len(bn)
    lip = float(np.linalg.eigvalsh(gn)[-1]) if p else 0.0
    if lip <= 0:
        return np.zeros(p)
    step = 1.0 / lip
    beta = np.zeros(p) if beta0 is None else beta0.copy()
    yv, t = beta.copy(), 1.0
    for _ in range(max_iter):
        g = gn @ yv - bn
        z = yv - step * g
        new = np.sign(z) * np.maximum(np.abs(z) - step * alpha, 0.0)
        t_new = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
        yv = new + ((t - 1.0) / t_new) * (new - beta)
        if np.max(np.abs(new - beta)) <= tol * max(1.0, np.max(np.abs(new))):
            beta = new
            break
        beta, t = new, t_new
    return beta


RIDGE_SPECS = {
    # model: (feature filter, target kind)
    "M1": ("all", "price"),
    "M2": ("all", "log_price"),
    "M3a": ("no_qty_rush_lead", "two_stage_global"),
    "M3b": ("no_qty_rush_lead", "two_stage_part"),
}


def _x_cols(kind: str) -> list[str]:
    base = feature_names("onehot", True)
    if kind == "all":
        return base
    return [c for c in base if not any(s in c.lower() for s in ("quantity", "rush", "lead_time"))]


def _m4_cols() -> list[str]:
    base = feature_names("onehot", True)
    return (base + ["days_since_epoch"] + [f"rush_x_{c}" for c in base if c.startswith("material_")]
            + [f"rush_x_{c}" for c in base if c.startswith("base_part_type_")] + ["tier_x_log_qty", "rush_x_lead_time"])


def two_stage_params(q: DataFrame) -> tuple[dict, dict, dict]:
    """Per training fold k: global slope (log unit price on log qty),
    rush multiplier (ratio of medians) and per-part slopes (n >= 5)."""
    part = q.withColumn("part", F.coalesce("base_part_type", F.lit(S.UNKNOWN_PART)))
    gs = {r["k"]: r["slope"] for r in discount_slopes(q, []).collect()}
    ps = {(r["k"], r["part"]): (r["slope"], r["n"]) for r in discount_slopes(part, ["part"]).collect()}
    med = weighted_quantiles(q, ["rush_job"], "unit_price", [("m", 0.5)], leave_out=("fold", len(FITS))).collect()
    mm = {(r["k"], r["rush_job"]): r["m"] for r in med}
    rush = {}
    for k in FITS:
        r, nr = mm.get((k, True)), mm.get((k, False))
        rush[k] = r / nr if r is not None and nr is not None else 1.0
    part_slopes = {k: {p: (ps[(k, p)][0] if (k, p) in ps and ps[(k, p)][1] >= 5 and ps[(k, p)][0] is not None
                           else gs[k]) for p in PARTS} for k in FITS}
    return gs, rush, part_slopes


def _target(model: str, k: int, gs, rush, pslopes) -> dict[str, float]:
    if model == "M1":
        return {"y_price": 1.0}
    if model in ("M2", "M4"):
        return {"y_log_price": 1.0}
    comb = {"y_log_up": 1.0, "rush_job": -float(np.log(rush[k]))}
    if model == "M3a":
        comb["log_quantity"] = -float(gs[k])
    else:
        for p in PARTS:
            comb[f"lq_x_{p}"] = -float(pslopes[k][p])
    return comb


def loo_errors(q: DataFrame, plans: dict) -> dict:
    """Pass 2: sum of squared LOO errors per (model, fold, alpha).
    ``plans[(model, k)]`` holds mu, sd, V, lam, c, ybar, n, target comb."""
    cols = sorted({c for pl in plans.values() for c in pl["x"] + list(pl["comb"])})
    pos = {c: i for i, c in enumerate(cols)}
    na = len(RIDGE_ALPHAS)
    keys = list(plans)
    schema = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("sse", T.ArrayType(T.DoubleType()))])

    by_columns: dict = {}  # the folds' projections of the models with the same columns, side by side
    for key, pl in plans.items():
        by_columns.setdefault(tuple(pl["x"]), {}).setdefault(key[1], []).append(key)
    turns = {x: (np.concatenate([plans[of[0]]["V"] / plans[of[0]]["sd"][:, None] for of in folds.values()], 1),
                 np.concatenate([(plans[of[0]]["mu"] / plans[of[0]]["sd"]) @ plans[of[0]]["V"] for of in folds.values()]))
             for x, folds in by_columns.items()}

    def part(batches):
        acc = np.zeros((len(keys), na))
        for batch in batches:
            columns = _arrays(batch)
            fo = columns.pop("fold")
            a = expand(columns, cols)
            for x, folds in by_columns.items():
                turn, shift = turns[x]
                projected = a[[pos[c] for c in x]].T @ turn
                projected -= shift
                for i, (k, of) in enumerate(folds.items()):
                    own, pl = fo == k, plans[of[0]]  # the fold's own rows are left out
                    qv = projected[:, i * len(x):(i + 1) * len(x)]
                    den = pl["lam"][None, :] + RIDGE_ALPHAS[:, None]           # (na, p)
                    rest = 1.0 - 1.0 / pl["n"] - (qv * qv) @ (1.0 / den).T
                    for key in of:
                        pl = plans[key]
                        y = np.array(list(pl["comb"].values())) @ a[[pos[c] for c in pl["comb"]]]
                        e = qv @ (pl["c"][None, :] / den).T                     # (rows, na)
                        np.subtract((y - pl["ybar"])[:, None], e, out=e)
                        e /= rest
                        e[own] = 0.0
                        acc[keys.index(key)] += np.einsum("ij,ij->j", e, e)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys), dtype=np.int32)), pa.array(list(acc), pa.list_(pa.float64()))],
                                         ["key", "sse"])

    r = compact(q).mapInArrow(part, schema) \
        .select("key", F.posexplode("sse").alias("a", "v")).groupBy("key", "a").agg(F.sum("v").alias("v"))
    out = {}
    for row in r.toLocalIterator():  # (#models x K x #alphas) numbers
        out[(keys[row["key"]], row["a"])] = row["v"]
    return out


def fit_linear(q: DataFrame, models=("M1", "M2", "M3a", "M3b", "M4")) -> list[dict]:
    """Fit the linear family on every training fold and, as fold ``ALL``, on
    all rows: per model and fold the coefficients with what scoring needs to
    turn their sum into a price."""
    names = design_names()
    grams = cell_grams(q, names)
    gs, rush, pslopes = two_stage_params(q)
    fits, plans = {}, {}
    for model in models:
        if model == "M4":
            continue
        x = _x_cols(RIDGE_SPECS[model][0])
        for k in FITS:
            v = GramView(grams[[f for f in range(K) if f != k]].sum(axis=(0, 1)), names)
            comb = _target(model, k, gs, rush, pslopes)
            mu, sd, gz, zy, ybar, yyc = _standardize(v, x, *_target_stats(v, x, comb))
            lam, vec = np.linalg.eigh(gz)
            plans[(model, k)] = {"x": x, "comb": comb, "mu": mu, "sd": sd, "V": vec, "lam": lam,
                                 "c": vec.T @ zy, "ybar": ybar, "n": v.n, "gz": gz, "zy": zy, "yyc": yyc}
    if plans:
        sse = loo_errors(q, plans)
        for key, pl in plans.items():
            errs = [sse.get((key, a), np.inf) for a in range(len(RIDGE_ALPHAS))]
            alpha = float(RIDGE_ALPHAS[int(np.argmin(errs))])
            beta, rvar = _ridge_solution(pl["gz"], pl["zy"], pl["yyc"], pl["n"], alpha)
            coef = beta / pl["sd"]
            fits[key] = {"model": key[0], "fold": key[1], "alpha": alpha, "x": pl["x"], "coef": coef,
                         "intercept": pl["ybar"] - coef @ pl["mu"], "resid_var": rvar}
    if "M4" in models:
        x = _m4_cols()
        for k in FITS:
            outer = GramView(grams[[f for f in range(K) if f != k]].sum(axis=(0, 1)), names)
            comb = _target("M4", k, gs, rush, pslopes)
            mu, sd, _gz, _zy, _yb, _yyc = _standardize(outer, x, *_target_stats(outer, x, comb))
            mse = np.zeros(len(LASSO_ALPHAS))
            for j in range(K):
                tr = GramView(sum(grams[f, i] for f in range(K) for i in range(K) if f != k and i != j), names)
                va = GramView(grams[[f for f in range(K) if f != k], j].sum(axis=0), names)
                mse += _lasso_path_mse(tr, va, x, comb, mu, sd)
            alpha = float(LASSO_ALPHAS[int(np.argmin(mse))])
            beta, b0, rvar = _lasso_fit(outer, x, comb, mu, sd, alpha)
            coef = beta / sd
            fits[("M4", k)] = {"model": "M4", "fold": k, "alpha": alpha, "x": x, "coef": coef,
                               "intercept": b0 - coef @ mu, "resid_var": rvar}
    for (model, k), f in fits.items():
        if model in ("M3a", "M3b"):
            f["log_rush"], f["slope"] = float(np.log(rush[k])), float(gs[k])
            f["part_slopes"] = {p: float(pslopes[k][p]) for p in PARTS} if model == "M3b" else {}
    return list(fits.values())


def fit_linear_cv(q: DataFrame, models=("M1", "M2", "M3a", "M3b", "M4")) -> tuple[DataFrame, list[dict]]:
    """Out-of-fold rows (quote_id, model, pred, ...) of the linear family, and
    all fits."""
    fits = fit_linear(q, models)
    return score_linear(q, fits), fits


def _zspace(v: GramView, x, comb, mu, sd):
    """Centered (on v's own means) Gram / n and Z'y / n in the outer scaling."""
    sy, xy, yy = _target_stats(v, x, comb)
    n = v.n
    mx = v.sv(x) / n
    zbar = (mx - mu) / sd
    cov = v.cross(x, x) / n - np.outer(mx, mx)
    gn = cov / np.outer(sd, sd)
    ybar = sy / n
    bn = (xy / n - mx * ybar) / sd
    return gn, bn, zbar, ybar, yy / n - ybar * ybar


def _lasso_path_mse(tr: GramView, va: GramView, x, comb, mu, sd) -> np.ndarray:
    gn, bn, zbar, ybar, _ = _zspace(tr, x, comb, mu, sd)
    syv, xyv, yyv = _target_stats(va, x, comb)
    nv = va.n
    # validation rows in outer z-space: z = (x - mu) / sd
    zs = (va.sv(x) - nv * mu) / sd
    zz = (va.cross(x, x) - np.outer(va.sv(x), mu) - np.outer(mu, va.sv(x)) + nv * np.outer(mu, mu)) / np.outer(sd, sd)
    zy = (xyv - mu * syv) / sd
    out, beta = [], None
    for alpha in sorted(LASSO_ALPHAS, reverse=True):
        beta = _lasso_cd(gn, bn, alpha, beta)
        b0 = ybar - zbar @ beta
        # sum (y - b0 - z'beta)^2 over validation rows
        sse = yyv - 2 * b0 * syv - 2 * beta @ zy + nv * b0 * b0 + 2 * b0 * beta @ zs + beta @ zz @ beta
        out.append((alpha, sse / nv))
    d = dict(out)
    return np.array([d[a] for a in LASSO_ALPHAS])


def _lasso_fit(v: GramView, x, comb, mu, sd, alpha):
    gn, bn, zbar, ybar, yvar = _zspace(v, x, comb, mu, sd)
    beta = _lasso_cd(gn, bn, alpha)
    b0 = ybar - zbar @ beta
    rvar = yvar - 2 * beta @ bn + beta @ gn @ beta
    return beta, b0, max(rvar, 0.0)


def linear_prices(spark, fits: list[dict], folds=range(K)) -> tuple[Column | None, list[str]]:
    """A struct of one price a model, and the models' names: each row is
    scored by the fit of its ``fold`` (``ALL`` is the fit on all rows). A
    batch's features are made from ``narrow_features`` and multiplied with the
    coefficients of all folds; a feature without any coefficient is not read."""
    by_model: dict[str, dict[int, dict]] = {}
    for f in fits:
        if f["fold"] in folds:
            by_model.setdefault(f["model"], {})[f["fold"]] = f
    models = sorted(by_model)
    if not models:
        return None, []
    plan = {}
    for m in models:
        fit = by_model[m]
        names = next(iter(fit.values()))["x"]
        used = [i for i in range(len(names)) if any(f["coef"][i] != 0.0 for f in fit.values())]
        start = np.array([f["intercept"] + (0.0 if m == "M1" else 0.5 * f["resid_var"]) for f in fit.values()])
        slopes = rush = None
        if "slope" in next(iter(fit.values())):  # of each part, and of any other
            slopes = np.array([[*[f["part_slopes"].get(p, f["slope"]) for p in PARTS], f["slope"]] for f in fit.values()])
            rush = np.array([f["log_rush"] for f in fit.values()])
        plan[m] = ([names[i] for i in used], start, np.array([f["coef"][used] for f in fit.values()]), slopes, rush, list(fit))
    share = Shared(spark, (plan, sorted({c for names, *_ in plan.values() for c in names})))

    @F.pandas_udf(", ".join(f"`{m}` double" for m in models))
    def price(fold: pd.Series, features: pd.DataFrame) -> pd.DataFrame:
        known, cols = share.get()
        columns = {c: features[c].to_numpy(np.float64) for c in features.columns}
        a, row, fold = expand(columns, cols), np.arange(len(fold)), fold.to_numpy(np.float64)
        out = {}
        for m, (names, start, coef, slopes, rush, ks) in known.items():
            of = np.full(len(row), -1)
            for i, k in enumerate(ks):
                of[fold == k] = i
            e = (coef @ a[[cols.index(c) for c in names]] + start[:, None])[of, row]
            if slopes is not None:
                e = e + (1.0 + slopes[of, columns["part"].astype(int)]) * columns["log_quantity"] + columns["rush_job"] * rush[of]
            e = np.where(of < 0, np.nan, e)
            out[m] = np.fmax(e, 0.0) if m == "M1" else np.exp(e)
        return pd.DataFrame(out)

    return price(F.col("fold"), F.struct(*narrow_features())), models


META = ["actual", "material", "part_description", "base_part_type", "quantity", "estimator", "rush_job", "quote_date"]


def score_linear(q: DataFrame, fits: list[dict]) -> DataFrame:
    """Out-of-fold predictions of all models by one scan."""
    prices, models = linear_prices(q.sparkSession, fits)
    d = q.withColumnRenamed("total_price_usd", "actual").withColumn("linear", prices)
    preds = [F.struct(F.lit(m).alias("model"), F.col(f"linear.{m}").alias("pred")) for m in models]
    return d.withColumn("_p", F.explode(F.array(*preds))).select("quote_id", "fold", "_p.model", "_p.pred", *META)


def coefficient_table(spark, fits: list[dict]) -> DataFrame:
    """The fits as a table (model, fold, feature, coef, alpha,
    resid_var): coefficients on the features' own scale, the intercept and,
    for the two-stage models, slopes and rush factor. It is all that scoring
    needs (``load_fits``)."""
    rows = []
    for f in fits:
        extra = [(INTERCEPT, f["intercept"])]
        if "slope" in f:
            extra += [(LOG_RUSH, f["log_rush"]), (SLOPE, f["slope"])]
            extra += [(PART_SLOPE + p, v) for p, v in f["part_slopes"].items()]
        rows += [(f["model"], int(f["fold"]), n, float(c), float(f["alpha"]), float(f["resid_var"]))
                 for n, c in extra + list(zip(f["x"], f["coef"]))]
    return spark.createDataFrame(rows, "model string, fold int, feature string, coef double, alpha double, resid_var double")


def load_fits(table: DataFrame) -> list[dict]:
    """The fits of a coefficient table (its size is models x folds x features)."""
    fits: dict = {}
    for r in table.collect():
        f = fits.setdefault((r["model"], r["fold"]), {"model": r["model"], "fold": r["fold"], "alpha": r["alpha"],
                                                       "resid_var": r["resid_var"], "x": [], "coef": []})
        name = r["feature"]
        if name == INTERCEPT:
            f["intercept"] = r["coef"]
        elif name == LOG_RUSH:
            f["log_rush"] = r["coef"]
        elif name == SLOPE:
            f["slope"] = r["coef"]
            f.setdefault("part_slopes", {})
        elif name.startswith(PART_SLOPE):
            f.setdefault("part_slopes", {})[name[len(PART_SLOPE):]] = r["coef"]
        else:
            f["x"].append(name)
            f["coef"].append(r["coef"])
    return [f | {"coef": np.array(f["coef"])} for f in fits.values()]
