"""Model evaluation: fold metrics (A14), CV summary (A15), comparison
table (A16), pairwise significance (J8, M12, M13) and the hypothesis
table (M15, J9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import grouped_stats

METRICS = ["MAPE", "MedAPE", "RMSE", "R2"]


def fold_metrics(oof: DataFrame) -> DataFrame:
    """A14 per (model, fold): MAPE, MedAPE (percent), RMSE, R2 (0 when
    the fold's actuals have no variance)."""
    e = oof.select("model", "fold", "actual", "pred",
                   (F.abs(F.col("actual") - F.col("pred")) / F.abs(F.col("actual"))).alias("ape"),
                   ((F.col("actual") - F.col("pred")) ** 2).alias("se"))
    g = grouped_stats(e, ["model", "fold"], [
        F.avg("ape").alias("_mape"), F.avg("se").alias("_mse"), F.sum("se").alias("_ssr"),
        (F.var_pop("actual") * F.count(F.lit(1))).alias("_sst"), F.count(F.lit(1)).alias("n"),
    ], [("_medape", "ape", 0.5)])
    return g.select(
        "model", "fold",
        (F.col("_mape") * 100).alias("MAPE"),
        (F.col("_medape") * 100).alias("MedAPE"),
        F.sqrt("_mse").alias("RMSE"),
        F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_ssr") / F.col("_sst")).otherwise(F.lit(0.0)).alias("R2"),
        F.col("n").cast("long").alias("n"))


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population std (ddof 0) of fold metrics per model."""
    aggs = []
    for m in METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return folds.groupBy("model").agg(*aggs)


def comparison_table(folds: DataFrame) -> DataFrame:
    """Mean and sample std (ddof 1) per model."""
    aggs = []
    for m in METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return folds.groupBy("model").agg(*aggs)


def model_pairs(folds: DataFrame) -> DataFrame:
    """Every unordered model pair matched on fold; pairs with < 3 or
    unequal matched folds are skipped."""
    a = folds.select(F.col("model").alias("model_a"), "fold", F.col("MAPE").alias("mape_a"))
    b = folds.select(F.col("model").alias("model_b"), "fold", F.col("MAPE").alias("mape_b"))
    j = a.join(b, "fold").where(F.col("model_a") < F.col("model_b"))
    nfold = folds.groupBy("model").agg(F.count(F.lit(1)).alias("_nf"))
    j = (j.join(nfold.select(F.col("model").alias("model_a"), F.col("_nf").alias("_na")), "model_a")
         .join(nfold.select(F.col("model").alias("model_b"), F.col("_nf").alias("_nb")), "model_b"))
    w = Window.partitionBy("model_a", "model_b")
    j = j.withColumn("_nm", F.count(F.lit(1)).over(w))
    return j.where((F.col("_nm") >= 3) & (F.col("_na") == F.col("_nb")) & (F.col("_nm") == F.col("_na"))) \
        .select("model_a", "model_b", "fold", "mape_a", "mape_b", (F.col("mape_a") - F.col("mape_b")).alias("d"))


PERM_EPS = 1e-12
MOST_MASKED_FOLDS = 24


def permutation_test(folds: DataFrame) -> DataFrame:
    """Exact two-sided sign-flip test over all 2^n masks; a mask
    counts when |mean(sign * d)| >= |mean(d)| (with a 1e-12 slack so the
    identity and full-flip masks always count). A pair's differences are one
    short array; its masks are rows. Above ``MOST_MASKED_FOLDS`` folds the
    masks are too many to enumerate and a ValueError is raised."""
    p = model_pairs(folds)
    stats = p.groupBy("model_a", "model_b").agg(
        F.avg("mape_a").alias("mape_a"), F.avg("mape_b").alias("mape_b"), F.avg("d").alias("diff"),
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "d"))), lambda x: x["d"]).alias("ds"))
    most = stats.agg(F.max(F.size("ds"))).first()[0] or 0
    if most > MOST_MASKED_FOLDS:
        raise ValueError(f"{most} folds: an exact sign-flip test enumerates 2^{most} masks; use the Wilcoxon test")
    masks = stats.withColumn("mask", F.explode(F.sequence(
        F.lit(0).cast("long"), F.expr("shiftleft(1L, size(ds))") - 1)))
    signed = F.aggregate(F.transform("ds", lambda d, i: F.when(
        F.expr("mask").bitwiseAND(F.pow(F.lit(2), i).cast("long")) > 0, d).otherwise(-d)), F.lit(0.0), lambda a, x: a + x)
    extreme = F.abs(signed / F.size("ds")) >= F.abs("diff") - F.lit(PERM_EPS)
    out = masks.groupBy("model_a", "model_b").agg(
        F.first("mape_a").alias("mape_a"), F.first("mape_b").alias("mape_b"), F.first("diff").alias("diff"),
        (F.count(F.when(extreme, 1)) / F.count(F.lit(1))).alias("p_value"))
    return out.withColumn("significant", F.col("p_value") < 0.05)


def wilcoxon_test(folds: DataFrame) -> DataFrame:
    """Wilcoxon signed-rank with its exact null distribution; zero
    differences dropped, ties at their average rank; all-zero pairs get
    p = 1.

    Twice the average ranks are whole numbers, so the null distribution of
    twice W+ is built rank by rank as an array of probabilities (polynomial
    in the number of folds, no cap)."""
    p = model_pairs(folds)
    stats = p.groupBy("model_a", "model_b").agg(
        F.avg("mape_a").alias("mape_a"), F.avg("mape_b").alias("mape_b"), F.avg("d").alias("diff"))
    nz = p.where(F.col("d") != 0).withColumn("ad", F.abs("d"))
    w = Window.partitionBy("model_a", "model_b").orderBy("ad")
    nz = nz.withColumn("_rn", F.row_number().over(w).cast("double"))
    nz = nz.withColumn("rank2", F.round(2 * F.avg("_rn").over(Window.partitionBy("model_a", "model_b", "ad"))).cast("int"))
    ranks = nz.groupBy("model_a", "model_b").agg(
        F.sum(F.when(F.col("d") > 0, F.col("rank2")).otherwise(F.lit(0))).cast("int").alias("w2"),
        F.sort_array(F.collect_list("rank2")).alias("ranks"), F.sum("rank2").cast("int").alias("top"))
    start = F.transform(F.sequence(F.lit(0), F.col("top")), lambda i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    dist = F.aggregate("ranks", start, lambda acc, r: F.transform(
        acc, lambda x, i: 0.5 * x + 0.5 * F.when(i >= r, F.element_at(acc, F.greatest(i - r, F.lit(0)) + 1)).otherwise(F.lit(0.0))))
    ranks = ranks.withColumn("dist", dist)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    le = total(F.expr("slice(dist, 1, w2 + 1)"))
    ge = total(F.expr("slice(dist, w2 + 1, top - w2 + 1)"))
    tail = ranks.select("model_a", "model_b", F.least(F.lit(1.0), 2.0 * F.least(le, ge)).alias("p"))
    out = stats.join(tail, ["model_a", "model_b"], "left").select(
        "model_a", "model_b", "mape_a", "mape_b", "diff", F.coalesce("p", F.lit(1.0)).alias("p_value"))
    return out.withColumn("significant", F.col("p_value") < 0.05)


# ---- FIXED VALUES: the hypothesis list (pair, question) --------------------
HYPOTHESES = [
    ("M0", "M1", "How much does ML add over a simple formula?"),
    ("M1", "M2", "Is pricing additive or multiplicative?"),
    ("M2", "M3a", "Does explicit unit-price decomposition help?"),
    ("M3a", "M3b", "Do discount curves differ by part type?"),
    ("M2", "M4", "Do interaction terms add lift?"),
    ("M5", "M6", "RF vs XGBoost stability (overfitting check)"),
    ("M6", "M6b", "Does lead time contribute signal?"),
    ("M6", "M7", "Raw vs log target for trees"),
    ("M7", "M7c", "XGBoost vs LightGBM (log-target, fair comparison)"),
    ("M6", "M8", "Is estimator bias additive or structural?"),
    ("M6", "M9", "Does including estimator help or hurt?"),
]


def resolve_hypotheses(comparison: DataFrame, sig: DataFrame) -> DataFrame:
    """M15 + J9: hypotheses joined to the comparison table twice and to
    the significance table in either pair order."""
    spark = comparison.sparkSession
    h = F.broadcast(spark.createDataFrame(HYPOTHESES, "model_a string, model_b string, hypothesis string"))
    ma = comparison.select(F.col("model").alias("model_a"), F.col("MAPE_mean").alias("mape_a"))
    mb = comparison.select(F.col("model").alias("model_b"), F.col("MAPE_mean").alias("mape_b"))
    j = h.join(ma, "model_a").join(mb, "model_b")
    s = sig.select(F.least("model_a", "model_b").alias("_lo"), F.greatest("model_a", "model_b").alias("_hi"),
                   "p_value", "significant")
    j = j.join(s, (F.least(j.model_a, j.model_b) == s._lo) & (F.greatest(j.model_a, j.model_b) == s._hi), "left")
    return j.select("hypothesis", "model_a", "model_b", "mape_a", "mape_b",
                    F.when(F.col("mape_a") < F.col("mape_b"), F.col("model_a")).otherwise(F.col("model_b")).alias("winner"),
                    "p_value", "significant")
