"""Queries: cross-validation, M0, fold metrics and significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators.cv import m0_fit, m0_score, to_oof
from ..operators.enrich import materialized_quotes
from ..operators.stage import cached_stage, cached_value, write_stage
from .registry import register
from .sqlbase import enriched_cte, fold_metrics_cte, m0_oof_cte, with_ctes

OOF = with_ctes(enriched_cte(), m0_oof_cte())
FM = with_ctes(enriched_cte(), m0_oof_cte(), fold_metrics_cte())


def m0_tables(spark, sf):
    """M0's parameters for every fold and for all rows."""
    def build():
        levels, scalars = m0_fit(materialized_quotes(spark, sf))
        return {"m0_levels": write_stage(levels, "m0-levels"), "m0_scalars": scalars}
    return cached_value(spark, "m0", sf, build)


def m0_oof_table(spark, sf):
    """Out-of-fold M0 predictions, written once and shared by every lens."""
    def build():
        t = m0_tables(spark, sf)
        return to_oof(m0_score(materialized_quotes(spark, sf).withColumn("k", F.col("fold")), t["m0_levels"], t["m0_scalars"]), "M0")
    return cached_stage(spark, "oof_m0", sf, build)


def m0_fold_metrics(spark, sf):
    return cached_stage(spark, "fold_metrics_m0", sf, lambda: EV.fold_metrics(m0_oof_table(spark, sf)))


@register("w05_fold_assignment", oracle=with_ctes(enriched_cte()) + """
SELECT fold, count(*) AS n FROM eq GROUP BY fold""")
def w05(spark, sf):
    """Deterministic 5-fold assignment (fold sizes)."""
    return materialized_quotes(spark, sf).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@register("m00_lookup_cv", oracle=OOF + """
SELECT quote_id, fold, model, actual, pred FROM oof""", doubles=["actual", "pred"])
def m00(spark, sf):
    """M0 + M11: lookup-table model, out-of-fold predictions for all rows."""
    return m0_oof_table(spark, sf).select("quote_id", "fold", "model", "actual", "pred")


@register("a14_fold_metrics", oracle=FM + """
SELECT model, fold, MAPE, MedAPE, RMSE, R2, CAST(n AS BIGINT) AS n FROM fm""",
          doubles=["MAPE", "MedAPE", "RMSE", "R2"])
def a14(spark, sf):
    return m0_fold_metrics(spark, sf)


def _summary_sql(std: str) -> str:
    cols = ", ".join(f"avg({m}) AS {m}_mean, {std}({m}) AS {m}_std" for m in EV.METRICS)
    return FM + f"\nSELECT model, {cols} FROM fm GROUP BY model"


_SUMMARY_DOUBLES = [f"{m}_{s}" for m in EV.METRICS for s in ("mean", "std")]


@register("a15_cv_summary", oracle=_summary_sql("stddev_pop"), doubles=_SUMMARY_DOUBLES)
def a15(spark, sf):
    return EV.cv_summary(m0_fold_metrics(spark, sf))


@register("a16_comparison_table", oracle=_summary_sql("stddev_samp"), doubles=_SUMMARY_DOUBLES)
def a16(spark, sf):
    return EV.comparison_table(m0_fold_metrics(spark, sf))
