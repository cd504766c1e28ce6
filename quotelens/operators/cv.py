"""Cross-validation plumbing (W5, M11) and the lookup-table model M0.

Folds come from ``fold_of(quote_id)`` (deterministic hash). All five
fold fits and the fit on all rows come from statistics aggregated once by
fold; a fit ``k`` adds up those of the other folds. Scoring joins each row to the parameters of its
own fold. Parameter tables are bounded by (#levels x #folds) and are
left to adaptive
execution, which broadcasts by real bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .quantiles import weighted_quantiles
from .stage import write_stage

OOF_COLUMNS = ["quote_id", "fold", "model", "actual", "pred", "material", "part_description",
               "base_part_type", "quantity", "estimator", "rush_job", "quote_date"]


#: The ``k`` that stands for a fit on all rows.
ALL = S.N_FOLDS


def every_fit(counts: DataFrame) -> DataFrame:
    """Sums by fold, once for each fit ``k`` that leaves another fold out
    (``ALL`` leaves none out)."""
    ks = F.filter(F.sequence(F.lit(0), F.lit(ALL)), lambda k: k != F.col("fold"))
    return counts.withColumn("k", F.explode(ks))


def discount_slopes(q: DataFrame, keys: list[str]) -> DataFrame:
    """``k, *keys, slope, n``: the regression of log unit price on log
    quantity for every fit, from centred moments made once a fold."""
    x, y = F.log(F.col("quantity").cast("double")), F.log("unit_price")
    one = q.select("fold", *keys, x.alias("x"), y.alias("y")).groupBy("fold", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.covar_pop("x", "y").alias("cov"), F.var_pop("x").alias("var"))
    w = Window.partitionBy("k", *keys)  # a row a fold
    s = every_fit(one).withColumn("m", F.sum("n").over(w)) \
        .withColumn("dx", F.col("mx") - F.sum(F.col("n") * F.col("mx")).over(w) / F.col("m")) \
        .withColumn("dy", F.col("my") - F.sum(F.col("n") * F.col("my")).over(w) / F.col("m"))
    s = s.groupBy("k", *keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("cov") + F.col("dx") * F.col("dy"))).alias("cov"),
                                  F.sum(F.col("n") * (F.col("var") + F.col("dx") * F.col("dx"))).alias("var"))
    return s.select("k", *keys, F.when(F.col("var") > 0, F.col("cov") / F.col("var")).alias("slope"), "n")


# ---------------------------------------------------------------- M0 ----
def m0_fit(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fit M0 for every ``k`` (the fold left out; ``ALL`` for none) at once.

    Returns (level table (k, dim, level, factor-or-median), scalar table
    (k, global_median, slope, rush_multiplier)). Prices are counted once by
    fold, dimension and level; the fits' medians come from those counts."""
    stacked = q.select("fold", "unit_price", F.explode(F.array(
        F.struct(F.lit("global").alias("dim"), F.lit("*").alias("level")),
        F.struct(F.lit("part").alias("dim"), F.col("base_part_type").alias("level")),
        F.struct(F.lit("material").alias("dim"), F.col("material").alias("level")),
        F.struct(F.lit("process").alias("dim"), F.col("process").alias("level")),
        F.struct(F.lit("rush").alias("dim"), F.col("rush_job").cast("string").alias("level")),
    )).alias("d")).select("fold", "d.dim", "d.level", "unit_price").where(F.col("level").isNotNull())
    med = weighted_quantiles(stacked, ["dim", "level"], "unit_price", [("med", 0.5)], leave_out=("fold", ALL + 1))
    med = write_stage(med.coalesce(1), "m0-medians")  # a row a fit and level
    glob = med.where(F.col("dim") == "global").select("k", F.col("med").alias("global_median"))
    rush = med.where(F.col("dim") == "rush").groupBy("k").agg(
        F.max(F.when(F.col("level") == "true", F.col("med"))).alias("_r"),
        F.max(F.when(F.col("level") == "false", F.col("med"))).alias("_nr"))
    scalars = (glob.join(discount_slopes(q, []).drop("n"), "k", "left").join(rush, "k", "left")
               .select("k", "global_median",
                       F.coalesce(F.col("slope"), F.lit(S.M0_DEFAULT_SLOPE)).alias("slope"),
                       F.coalesce(F.col("_r") / F.col("_nr"), F.lit(S.M0_DEFAULT_RUSH)).alias("rush_multiplier")))
    levels = (med.where(F.col("dim").isin("part", "material", "process")).join(glob, "k")
              .select("k", "dim", "level",
                      F.when(F.col("dim") == "part", F.col("med"))
                      .otherwise(F.col("med") / F.col("global_median")).alias("value")))
    return levels, write_stage(scalars.coalesce(1), "m0-scalars")


def m0_score(rows: DataFrame, levels: DataFrame, scalars: DataFrame) -> DataFrame:
    """Score rows that carry ``k`` (the fold whose parameters apply)."""
    lv = levels
    sc = F.broadcast(scalars)  # one row per fold: bounded by N_FOLDS
    part = lv.where(F.col("dim") == "part").select("k", F.col("level").alias("base_part_type"),
                                                    F.col("value").alias("_pm"))
    mat = lv.where(F.col("dim") == "material").select("k", F.col("level").alias("material"),
                                                       F.col("value").alias("_mf"))
    proc = lv.where(F.col("dim") == "process").select("k", F.col("level").alias("process"),
                                                       F.col("value").alias("_pf"))
    j = (rows.join(sc, "k").join(part, ["k", "base_part_type"], "left")
         .join(mat, ["k", "material"], "left").join(proc, ["k", "process"], "left"))
    unit = (F.coalesce(F.col("_pm"), F.col("global_median")) * F.coalesce(F.col("_mf"), F.lit(1.0))
            * F.coalesce(F.col("_pf"), F.lit(1.0)))
    total = (unit * F.pow(F.col("quantity").cast("double"), F.lit(1.0) + F.col("slope"))
             * F.when(F.col("rush_job"), F.col("rush_multiplier")).otherwise(F.lit(1.0)))
    return j.withColumn("pred", total).drop("_pm", "_mf", "_pf", "global_median", "slope",
                                            "rush_multiplier")


def to_oof(scored: DataFrame, model: str) -> DataFrame:
    return scored.select("quote_id", "fold", F.lit(model).alias("model"),
                         F.col("total_price_usd").alias("actual"), F.col("pred").cast("double").alias("pred"),
                         "material", "part_description", "base_part_type", "quantity", "estimator",
                         "rush_job", "quote_date")
