"""Refit stability (A26): how much a price moves when the model is fitted on
resampled rows.

No row is copied. One scan weights each row by Poisson(1) draws, one for each
replicate, and fills one Gram matrix a replicate; the replicates' ridge fits
are then small solves, and a second scan prices every row by all of them. The
penalty, the discount slopes and the rush factor are those of the fit on all
rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shared
from . import linear as LN
from .bias import poisson_weights
from .stage import write_stage

REPLICATES = 20


def row_hash(key: str = "quote_id"):
    """The number that a row's draws are made from."""
    return F.conv(F.substring(F.md5(F.col(key)), 1, 15), 16, 10).cast("long")


def replicate_grams(dsg: DataFrame, names: list[str], replicates: int) -> np.ndarray:
    """(replicates, w, w): A' diag(weights) A for A = [1, columns]."""
    cols = [LN._safe(n) for n in names]
    w = len(cols) + 1
    schema = "b int, g array<double>"

    def part(batches):
        acc = np.zeros((replicates, w, w))
        for pdf in batches:
            a = np.column_stack([np.ones(len(pdf))] + [pdf[c].to_numpy(dtype=np.float64) for c in cols])
            draws = poisson_weights(pdf["h"].to_numpy(np.int64).view(np.uint64), 0, replicates).astype(np.float64)
            for b in range(replicates):
                acc[b] += a.T @ (a * draws[:, b:b + 1])
        yield pd.DataFrame({"b": np.arange(replicates, dtype=np.int32), "g": [g.ravel() for g in acc]})

    def add(table: pa.Table) -> pa.Table:
        total = np.asarray(table.column("g").combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
        return pa.table({"b": table.column("b").slice(0, 1), "g": pa.array([total], pa.list_(pa.float64()))})

    g = dsg.select(row_hash().alias("h"), *cols).mapInPandas(part, schema)
    g = g.withColumn("salt", F.spark_partition_id() % 64).groupBy("b", "salt").applyInArrow(add, schema)  # two rounds
    out = np.zeros((replicates, w * w))
    for r in g.groupBy("b").applyInArrow(add, schema).collect():
        out[r["b"]] = r["g"]
    return out.reshape(replicates, w, w)


def refit(grams: np.ndarray, names: list[str], fit: dict, target: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, intercepts and residual variances of every replicate."""
    coefs, starts, variances = [], [], []
    for g in grams:
        v = LN.GramView(g, names)
        mu, sd, gz, zy, ybar, yyc = LN._standardize(v, fit["x"], *LN._target_stats(v, fit["x"], target))
        beta, var = LN._ridge_solution(gz, zy, yyc, v.n, fit["alpha"])
        coefs.append(beta / sd)
        starts.append(ybar - (beta / sd) @ mu)
        variances.append(var)
    return np.array(coefs), np.array(starts), np.array(variances)


def refit_stability(q: DataFrame, fits: list[dict], models=("M1", "M2", "M3a", "M3b"), replicates: int = REPLICATES) -> DataFrame:
    """``model, n_replicates, mean_cv, max_cv``. A row's value is the
    standard deviation of its prices over the replicates (ddof 0) by their
    mean, which counts as 1 at least; then mean and maximum over all rows.
    ``fits`` holds the fits on all rows."""
    dsg, names = LN.design(q)
    dsg = write_stage(dsg, "design")
    whole = {f["model"]: f for f in fits if f["fold"] == LN.ALL}
    models = [m for m in models if m in whole]
    grams = replicate_grams(dsg, names, replicates)
    plan = {}
    for m in models:
        f = whole[m]
        slopes = {p: f.get("part_slopes", {}).get(p, f.get("slope", 0.0)) for p in LN.PARTS}
        target = LN._target(m, 0, {0: f.get("slope", 0.0)}, {0: float(np.exp(f.get("log_rush", 0.0)))}, {0: slopes})
        plan[m] = (f["x"], *refit(grams, names, f, target), f.get("log_rush"), slopes)
    share = Shared(q.sparkSession, plan)
    cols = sorted({c for m in models for c in plan[m][0]} | {"log_quantity", "rush_job"})
    kinds = ", ".join(f"`{m}` double" for m in models)

    @F.pandas_udf(kinds)
    def spread(features: pd.DataFrame) -> pd.DataFrame:
        x = {c: features[LN._safe(c)].to_numpy(np.float64) for c in cols}
        out = {}
        for m, (names_m, coef, start, var, log_rush, slopes) in share.get().items():
            value = np.column_stack([x[c] for c in names_m]) @ coef.T + start
            if m == "M1":
                price = np.maximum(value, 0.0)
            else:
                value = value + var / 2
                if log_rush is not None:
                    slope = features["part"].map(slopes).to_numpy(np.float64)
                    value = value + ((1 + slope) * x["log_quantity"] + x["rush_job"] * log_rush)[:, None]
                price = np.exp(value)
            out[m] = price.std(1) / np.maximum(price.mean(1), 1.0)
        return pd.DataFrame(out)

    moved = dsg.select(spread(F.struct(*[F.col(LN._safe(c)) for c in cols], F.col("part"))).alias("cv"))
    one = moved.agg(*[F.struct(F.avg(f"cv.{m}").alias("mean_cv"), F.max(f"cv.{m}").alias("max_cv")).alias(m) for m in models])
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(replicates).alias("n_replicates"), F.col(f"{m}.mean_cv").alias("mean_cv"),
                              F.col(f"{m}.max_cv").alias("max_cv")) for m in models])
    return one.select(F.explode(rows).alias("r")).select("r.*")
