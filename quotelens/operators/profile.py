"""Exploratory statistics (A1-A13) as aggregate jobs.

Input: the enriched quote table (``unit_price`` and parse columns).
Every operator is one or two aggregate passes; exact medians go through
``grouped_stats`` (skew-proof exact quantiles).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import base_split, lead_time_bucket
from ..functions.stats import chi2_p_value, t_p_value
from .quantiles import grouped_stats

UP = "unit_price"


def summary_stats(q: DataFrame) -> DataFrame:
    """A1: rows and target statistics (std with ddof 1)."""
    return grouped_stats(q, [], [
        F.count(F.lit(1)).alias("row_count"),
        F.avg("total_price_usd").alias("price_mean"),
        F.stddev_samp("total_price_usd").alias("price_std"),
        F.min("total_price_usd").alias("price_min"),
        F.max("total_price_usd").alias("price_max"),
    ], [("price_median", "total_price_usd", 0.5)])


def column_summary(q: DataFrame, columns: list[str]) -> DataFrame:
    """A1: ``position, column_name, n_rows, n_null`` of each column, in one
    aggregate."""
    a = q.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column_name"), F.col("n").alias("n_rows"),
                              F.col(f"c{i}").alias("n_null")) for i, c in enumerate(columns)])
    return a.select(F.explode(rows).alias("r")).select("r.*")


DIMENSIONS = [("material", "material"), ("part_description", "part_description"),
              ("process", "process"), ("estimator", "estimator")]


def unit_price_by_dimension(q: DataFrame) -> DataFrame:
    """A2: unit price mean / median / std / count per level of four
    dimensions in one pass (rows unpivoted to (dimension, category));
    NULL categories dropped."""
    stacked = q.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("dimension"), F.col(col).cast("string").alias("category"))
        for name, col in DIMENSIONS])).alias("d"), F.col(UP)) \
        .select("d.dimension", "d.category", UP).where(F.col("category").isNotNull())
    return grouped_stats(stacked, ["dimension", "category"], [
        F.avg(UP).alias("mean_unit_price"),
        F.stddev_samp(UP).alias("std_unit_price"),
        F.count(UP).alias("n"),
    ], [("median_unit_price", UP, 0.5)])


def _regression_aggs(y: str, x: str) -> list:
    return [
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.corr(F.col(x), F.col(y)).alias("r"),
        F.covar_pop(F.col(x), F.col(y)).alias("_sxy"),
        F.var_pop(F.col(x)).alias("_sxx"),
        F.var_pop(F.col(y)).alias("_syy"),
    ]


def _log_xy(q: DataFrame) -> DataFrame:
    return q.select(F.log(F.col("quantity").cast("double")).alias("lx"), F.log(F.col(UP)).alias("ly"),
                    base_split().alias("base_part"))


def volume_discount(q: DataFrame) -> DataFrame:
    """A3: OLS of log unit price on log quantity over all rows: slope,
    intercept, r, r squared, slope standard error, t statistic, dof."""
    g = _log_xy(q).agg(*_regression_aggs("ly", "lx"))
    dof = F.col("n") - 2
    return g.select(
        "n", "slope", "intercept", "r", (F.col("r") * F.col("r")).alias("r_squared"),
        F.sqrt((F.lit(1.0) - F.col("r") * F.col("r")) * F.col("_syy") / F.col("_sxx") / dof).alias("std_err"),
        (F.col("r") * F.sqrt(dof / ((F.lit(1.0) - F.col("r") + F.lit(1e-20)) *
                                   (F.lit(1.0) + F.col("r") + F.lit(1e-20))))).alias("t_stat"),
        dof.cast("long").alias("dof"))


def volume_discount_pvalue(q: DataFrame) -> DataFrame:
    """A3 p-value: t tail on the single result row."""
    v = volume_discount(q)
    return v.select("slope", "r_squared", "t_stat", "dof",
                    t_p_value(F.col("t_stat"), F.col("dof")).alias("p_value"))


def volume_discount_by_part(q: DataFrame, min_n: int = 3) -> DataFrame:
    """A4: the same fit per base part (text before the separator), n >= 3."""
    g = _log_xy(q).groupBy("base_part").agg(*_regression_aggs("ly", "lx")).where(F.col("n") >= min_n)
    return g.select("base_part", "slope", "intercept", (F.col("r") * F.col("r")).alias("r_squared"),
                    F.col("n").cast("long").alias("n"))


def _rush_means(df: DataFrame, keys: list) -> DataFrame:
    rush = F.col("rush_job")
    return df.groupBy(*keys).agg(
        F.avg(F.when(rush, F.col(UP))).alias("rush_mean"),
        F.avg(F.when(~rush, F.col(UP))).alias("no_rush_mean"),
        F.count(F.when(rush, 1)).alias("n_rush"),
        F.count(F.when(~rush, 1)).alias("n_no_rush"))


def rush_premium(q: DataFrame) -> DataFrame:
    """A5 + A6: controlled ratio (mean over (description, material,
    process) groups having both kinds of ratio rush / non-rush mean), the
    number of such groups, and the marginal ratio."""
    ctl = _rush_means(q.where(F.col("material").isNotNull() & F.col("process").isNotNull()),
                      ["part_description", "material", "process"]) \
        .where((F.col("n_rush") > 0) & (F.col("n_no_rush") > 0)) \
        .agg(F.avg(F.col("rush_mean") / F.col("no_rush_mean")).alias("controlled_mean_ratio"),
             F.count(F.lit(1)).alias("n_controlled_groups"))
    marg = q.agg(F.avg(F.when(F.col("rush_job"), F.col(UP))).alias("rush_mean_unit_price"),
                 F.avg(F.when(~F.col("rush_job"), F.col(UP))).alias("no_rush_mean_unit_price"))
    return ctl.crossJoin(marg).select(
        "controlled_mean_ratio", "n_controlled_groups",
        (F.col("rush_mean_unit_price") / F.col("no_rush_mean_unit_price")).alias("marginal_ratio"),
        "rush_mean_unit_price", "no_rush_mean_unit_price")


def rush_premium_breakdown(q: DataFrame) -> DataFrame:
    """Rush ratio by base part and by material (non-NULL), groups
    with both kinds only; one pass over unpivoted rows."""
    stacked = q.select(F.explode(F.array(
        F.struct(F.lit("part_type").alias("dimension"), base_split().alias("category")),
        F.struct(F.lit("material").alias("dimension"), F.col("material").alias("category")),
    )).alias("d"), "rush_job", UP).select("d.dimension", "d.category", "rush_job", UP) \
        .where(F.col("category").isNotNull())
    g = _rush_means(stacked, ["dimension", "category"]) \
        .where((F.col("n_rush") > 0) & (F.col("n_no_rush") > 0))
    return g.select("dimension", "category", (F.col("rush_mean") / F.col("no_rush_mean")).alias("ratio"),
                    "n_rush", "n_no_rush")


def lead_time_correlation(q: DataFrame) -> DataFrame:
    """Pearson r of lead time and unit price, with t and dof."""
    g = q.agg(F.corr(F.col("lead_time_weeks").cast("double"), F.col(UP)).alias("r"),
              F.count(F.lit(1)).alias("n"))
    dof = F.col("n") - 2
    return g.select(F.col("r").alias("correlation"), F.col("n").cast("long").alias("n"),
                    (F.col("r") * F.sqrt(dof / ((F.lit(1.0) - F.col("r")) * (F.lit(1.0) + F.col("r"))))).alias("t_stat"),
                    dof.cast("long").alias("dof"))


def lead_time_correlation_pvalue(q: DataFrame) -> DataFrame:
    c = lead_time_correlation(q)
    return c.select("correlation", t_p_value(F.col("t_stat"), F.col("dof")).alias("p_value"))


LEAD_BUCKETS = ["short (2-4)", "medium (5-8)", "long (9-12)"]


def lead_time_buckets(q: DataFrame) -> DataFrame:
    """Mean / median / count per lead-time bucket; empty buckets kept."""
    spark = q.sparkSession
    b = q.select(lead_time_bucket().alias("bucket"), UP).where(F.col("bucket").isNotNull())
    stats = grouped_stats(b, ["bucket"], [F.avg(UP).alias("mean_unit_price"), F.count(UP).alias("n")],
                          [("median_unit_price", UP, 0.5)])
    buckets = F.broadcast(spark.createDataFrame([(i, n) for i, n in enumerate(LEAD_BUCKETS)],
                                                "bucket_order int, bucket string"))
    return buckets.join(stats, "bucket", "left").select(
        "bucket", "bucket_order", "mean_unit_price", "median_unit_price",
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def contingency(q: DataFrame, a: str = "estimator", b: str = "part_description") -> DataFrame:
    """A10: crosstab in long form (NULL keys dropped)."""
    return q.where(F.col(a).isNotNull() & F.col(b).isNotNull()) \
        .groupBy(F.col(a).cast("string").alias("row_level"), F.col(b).cast("string").alias("col_level")) \
        .agg(F.count(F.lit(1)).alias("n"))


CHI2_PAIRS = [("estimator", "part_description"), ("estimator", "material"),
              ("estimator", "process"), ("rush_job", "estimator")]


def chi_squared(q: DataFrame, pairs=CHI2_PAIRS) -> DataFrame:
    """Chi-squared independence per pair over the full grid of
    observed levels (zero cells included); Yates correction only when
    dof = 1. One pass over unpivoted pairs."""
    stacked = q.select(F.explode(F.array(*[
        F.struct(F.lit(f"{a}_x_{b}").alias("pair"), F.col(a).cast("string").alias("x"),
                 F.col(b).cast("string").alias("y")) for a, b in pairs])).alias("p")) \
        .select("p.pair", "p.x", "p.y").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    obs = stacked.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("o"))
    rows = obs.groupBy("pair", "x").agg(F.sum("o").alias("rt"))
    cols = obs.groupBy("pair", "y").agg(F.sum("o").alias("ct"))
    tot = obs.groupBy("pair").agg(F.sum("o").alias("n"))
    dims = rows.groupBy("pair").agg(F.count(F.lit(1)).alias("nx")) \
        .join(cols.groupBy("pair").agg(F.count(F.lit(1)).alias("ny")), "pair") \
        .join(tot, "pair").withColumn("dof", (F.col("nx") - 1) * (F.col("ny") - 1))
    grid = rows.join(cols, "pair").join(obs, ["pair", "x", "y"], "left").join(dims, "pair")
    o = F.coalesce(F.col("o"), F.lit(0)).cast("double")
    e = F.col("rt").cast("double") * F.col("ct").cast("double") / F.col("n").cast("double")
    diff = F.abs(o - e)
    adj = F.when(F.col("dof") == 1, diff - F.least(F.lit(0.5), diff)).otherwise(diff)
    return grid.groupBy("pair", "dof").agg(F.sum(adj * adj / e).alias("chi2")) \
        .select("pair", "chi2", F.col("dof").cast("long").alias("dof"))


def chi_squared_pvalue(q: DataFrame) -> DataFrame:
    c = chi_squared(q)
    p = chi2_p_value(F.col("chi2"), F.col("dof"))
    return c.select("pair", "chi2", "dof", p.alias("p_value"), (p < 0.05).alias("significant_at_005"))


def mean_pivot(q: DataFrame) -> DataFrame:
    """Mean unit price estimator x base part (long form)."""
    return q.groupBy("estimator", base_split().alias("base_part")).agg(
        F.avg(UP).alias("mean_unit_price"), F.count(UP).alias("n"))


def conditional_means(q: DataFrame) -> DataFrame:
    """A13 + W1 + J4: marginal mean by estimator, and grand mean plus the
    mean residual from the (description, material) group mean. The group
    mean is computed by an aggregate and joined back (a window partitioned
    by the group would put a hot group into one task)."""
    marginal = q.groupBy("estimator").agg(F.avg(UP).alias("marginal_mean"))
    c = q.where(F.col("material").isNotNull())
    gm = c.groupBy("part_description", "material").agg(F.avg(UP).alias("_gmean"))
    grand = c.agg(F.avg(UP).alias("_grand"))
    res = c.join(gm, ["part_description", "material"]) \
        .groupBy("estimator").agg(F.avg(F.col(UP) - F.col("_gmean")).alias("_adj"))
    return marginal.join(res.crossJoin(grand), "estimator", "left").select(
        "estimator", "marginal_mean", (F.col("_grand") + F.col("_adj")).alias("conditional_mean"))
