"""Queries over the out-of-fold prices of all fourteen models: M1-M9,
significance (M12, M13, M15), disagreement and recommendation (A20, R3-R5,
R9), lenses and scorecard (L1-L9, L11, A30), parameters (M19, S7).

Fits have no SQL equivalent: they are compared with plain numpy in
``tests/test_linear.py`` and ``tests/test_trees.py``; the operators that
follow them have SQL on stand-in models in ``q_checked.py``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import evaluate as EV
from ..operators import lenses as L
from ..operators import models as M
from ..operators import predict as PR
from ..operators import probes as PB
from ..operators import trees as TR
from ..operators.enrich import materialized_quotes
from ..operators.linear import INTERCEPT, LOG_RUSH, PART_SLOPE, SLOPE
from ..operators.stage import cached_stage, cached_value
from .q_models import m0_tables
from .registry import register

ATTRIBUTES = ("total_price_usd", "material", "part_description", "base_part_type", "quantity", "estimator", "rush_job", "quote_date")


def linear_table(spark, sf):
    """The linear models' coefficients, fitted once."""
    return cached_value(spark, "linear", sf, lambda: M.linear_table(materialized_quotes(spark, sf)))


FOLDS, WHOLE = tuple(range(M.ALL)), (M.ALL,)


def tree_table(spark, sf, folds, models=None):
    """The trees of the training folds or of all rows, fitted once."""
    name = "-".join(["trees", *map(str, folds), *(models or [])])
    cells = cached_stage(spark, "cells", sf, lambda: TR.cells(materialized_quotes(spark, sf)))  # all fits learn from the same
    return cached_value(spark, name, sf, lambda: M.tree_table(materialized_quotes(spark, sf), models, folds, cells))


def fold_tables(spark, sf):
    """The tables that out-of-fold prices need."""
    return {**m0_tables(spark, sf), "linear": linear_table(spark, sf), "trees": tree_table(spark, sf, FOLDS)}


def whole_tables(spark, sf):
    """The tables that prices by the fits on all rows need."""
    return {**m0_tables(spark, sf), "linear": linear_table(spark, sf), "trees": tree_table(spark, sf, WHOLE)}


def model_tables(spark, sf):
    """The tables of all models, each fit made once."""
    return {**whole_tables(spark, sf), "trees": tree_table(spark, sf, FOLDS).unionByName(tree_table(spark, sf, WHOLE))}


def _scored(spark, sf, tables, models=None):
    return M.score_wide(materialized_quotes(spark, sf), tables, keep=ATTRIBUTES, models=models).withColumnRenamed("total_price_usd", "actual")


def oof_wide(spark, sf):
    """Out-of-fold prices of all models beside each quote."""
    return cached_stage(spark, "oof_wide", sf, lambda: _scored(spark, sf, fold_tables(spark, sf)))


def all_oof_table(spark, sf):
    """A row for each quote and model; nothing is stored twice."""
    return M.long_form(oof_wide(spark, sf))


def all_fold_metrics(spark, sf):
    return cached_stage(spark, "fold_metrics_all", sf, lambda: EV.fold_metrics(all_oof_table(spark, sf)))


def all_bands(spark, sf):
    return cached_stage(spark, "bands_all", sf, lambda: PR.empirical_bands(all_oof_table(spark, sf)))


def _priced(spark, sf, tables, models):
    """Out-of-fold prices of some models: only their tables are fitted."""
    return M.long_form(_scored(spark, sf, tables, models)).select("quote_id", "fold", "model", "actual", "pred")


@register("m01_linear_cv")
def m01(spark, sf):
    """M1, M2, M3a, M3b, M4 + M11: out-of-fold predictions."""
    return _priced(spark, sf, {"linear": linear_table(spark, sf)}, M.LINEAR)


@register("m05_tree_cv")
def m05(spark, sf):
    """M5, M6, M6b, M7, M7b, M7c, M8, M9 + M11: out-of-fold predictions."""
    return _priced(spark, sf, {"trees": tree_table(spark, sf, FOLDS)}, TR.MODELS)


@register("a15_cv_summary_all_models")
def a15all(spark, sf):
    """A15 + T1 over every trained model, ascending MAPE."""
    return EV.cv_summary(all_fold_metrics(spark, sf)).orderBy("MAPE_mean")


@register("a19_bands_all_models")
def a19all(spark, sf):
    return all_bands(spark, sf)


@register("m12_wilcoxon")
def m12(spark, sf):
    return EV.wilcoxon_test(all_fold_metrics(spark, sf))


@register("m13_permutation_test")
def m13(spark, sf):
    return EV.permutation_test(all_fold_metrics(spark, sf))


@register("m15_hypotheses")
def m15(spark, sf):
    """All eleven hypotheses."""
    fm = all_fold_metrics(spark, sf)
    return EV.resolve_hypotheses(EV.comparison_table(fm), EV.permutation_test(fm))


@register("a20_model_disagreement")
def a20(spark, sf):
    """A20 + R9: per quote min / max / median over models, spread %."""
    return PR.model_disagreement(oof_wide(spark, sf))


@register("r03_recommendation")
def r03(spark, sf):
    """R3-R5 (+ J11, T8): consensus estimate, divergence, win bid and
    protect margin with the band of the best model."""
    return PR.recommendation(oof_wide(spark, sf), PR.best_band(all_bands(spark, sf)), keep=("actual",))


@register("r10_estimate_errors")
def r10(spark, sf):
    """Actual price beside the estimate, difference and per cent."""
    rec = PR.recommendation(oof_wide(spark, sf), None, keep=("actual",))
    return rec.select("quote_id", "actual", "estimate", (F.col("estimate") - F.col("actual")).alias("error"),
                      PR.signed_pct("estimate").alias("error_pct"))


@register("a27_coverage_report")
def a27(spark, sf):
    """A27 + A29: recommender coverage over all rows for the margin
    factors 0.25 / 0.50 / 0.75 / 1.00 (in range, exposed, $ at risk)."""
    rec = PR.recommendation(oof_wide(spark, sf), None, keep=("actual",))
    return PR.coverage(rec, PR.best_band(all_bands(spark, sf)))


# --------------------------------------------------------------- lenses ----
def _lens(name, build):
    def table(spark, sf):
        return cached_stage(spark, name, sf, lambda: build(spark, sf))
    return table


error_lens = _lens("lens_error", lambda spark, sf: L.error_profile(all_oof_table(spark, sf)))
segment_lens = _lens("lens_segments", lambda spark, sf: L.segment_fairness(all_oof_table(spark, sf)))
calibration_lens = _lens("lens_calibration", lambda spark, sf: L.calibration(all_oof_table(spark, sf)))
quartile_lens = _lens("lens_quartiles", lambda spark, sf: L.calibration_by_quartile(all_oof_table(spark, sf)))
deterministic_lens = _lens("lens_deterministic", lambda spark, sf: PB.deterministic_probes(spark, whole_tables(spark, sf)))
stochastic_lens = _lens("lens_stochastic", lambda spark, sf: PB.stochastic_probes(materialized_quotes(spark, sf), whole_tables(spark, sf)))
boundary_lens = _lens("lens_boundary", lambda spark, sf: PB.boundary_probes(spark, whole_tables(spark, sf)))


@register("l03_coherence_deterministic")
def l03d(spark, sf):
    """L3b for every model."""
    return deterministic_lens(spark, sf)


@register("l03_coherence_stochastic")
def l03s(spark, sf):
    """L3c for every model over every quote."""
    return stochastic_lens(spark, sf)


@register("l03_coherence_summary")
def l03(spark, sf):
    """L3d: pass count out of 10 checks and pass rate of every model."""
    return PB.coherence_summary(deterministic_lens(spark, sf), stochastic_lens(spark, sf))


@register("l06_boundary_behavior")
def l06(spark, sf):
    """L6 for every model."""
    return boundary_lens(spark, sf)


def effective_params(spark, sf):
    """M19, of the fits on all rows: non-zero coefficients, leaves, lookup
    entries with slope and rush factor."""
    t = whole_tables(spark, sf)
    whole = F.col("fold") == M.ALL
    constants = F.col("feature").isin(INTERCEPT, LOG_RUSH, SLOPE) | F.col("feature").startswith(PART_SLOPE)
    linear = t["linear"].where(whole & ~constants).groupBy("model") \
        .agg(F.count(F.when(F.abs("coef") > 1e-8, 1)).alias("effective_params"))
    trees = TR.leaf_counts(t["trees"]).where(whole).select("model", "effective_params")
    lookup = t["m0_levels"].where(F.col("k") == M.ALL).agg((F.count(F.lit(1)) + 2).alias("effective_params")) \
        .select(F.lit("M0").alias("model"), "effective_params")
    return linear.unionByName(trees).unionByName(lookup)


@register("l07_interpretability")
def l07(spark, sf):
    """L7 + M19: parameters, rating, reason and method of every model."""
    params = cached_stage(spark, "effective_params", sf, lambda: effective_params(spark, sf))
    fitted = {r["model"] for r in params.collect()}  # a row a model
    models = spark.createDataFrame([(m,) for m in S.MODEL_NAMES if m in fitted], "model string")
    return L.complexity(models, params)


@register("t07_worst_segment")
def t07(spark, sf):
    """The worst segment of every model."""
    return L.worst_segment(segment_lens(spark, sf))


@register("a30_acceptance")
def a30(spark, sf):
    """A30 for every model."""
    return L.acceptance(error_lens(spark, sf), segment_lens(spark, sf), quartile_lens(spark, sf),
                        L.fold_stability(all_fold_metrics(spark, sf)))


@register("l08_scorecard")
def l08(spark, sf):
    """The seven lenses of every model."""
    return L.scorecard(error_lens(spark, sf), L.worst_segment(segment_lens(spark, sf)),
                       PB.coherence_summary(deterministic_lens(spark, sf), stochastic_lens(spark, sf)),
                       calibration_lens(spark, sf), L.fold_stability(all_fold_metrics(spark, sf)), boundary_lens(spark, sf),
                       l07(spark, sf))


@register("s07_linear_coefficients")
def s07(spark, sf):
    """S7 + M19: fitted linear coefficients as a persisted table;
    non-zero count per model and fold."""
    coef = linear_table(spark, sf).where(F.col("fold") < M.ALL)
    feature = ~F.col("feature").startswith("__")
    return coef.groupBy("model", "fold").agg(
        F.count(F.when(feature & (F.abs("coef") > 1e-8), 1)).alias("effective_params"),
        F.first("alpha").alias("alpha"), F.first("resid_var").alias("resid_var"))
