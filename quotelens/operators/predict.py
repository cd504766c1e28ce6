"""Prediction bands, training bounds, OOD flags, recommendation
(A19-A21, R3-R10, J5, J11, T8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .quantiles import grouped_stats


def signed_pct(pred: str = "pred", actual: str = "actual") -> Column:
    """(pred - actual) / actual in percent; positive = over-estimate."""
    return (F.col(pred) - F.col(actual)) / F.col(actual) * 100


def empirical_bands(oof: DataFrame, coverage: float = 0.80) -> DataFrame:
    """Per model the (1-c)/2 and 1-(1-c)/2 percentiles of the signed
    % error and the median absolute % error."""
    tail = (1 - coverage) / 2
    e = oof.select("model", signed_pct().alias("s"), F.abs(signed_pct()).alias("a"))
    b = grouped_stats(e, ["model"], [], [("lower_pct", "s", tail), ("upper_pct", "s", 1 - tail),
                                         ("median_abs_error_pct", "a", 0.5)])
    return b.select("model", F.lit(float(coverage)).alias("coverage"), "lower_pct", "upper_pct",
                    "median_abs_error_pct")


def best_band(bands: DataFrame) -> DataFrame:
    """The band with the smallest median absolute error (one row)."""
    return bands.agg(F.min_by(F.struct(*[F.col(c) for c in bands.columns]),
                              F.struct("median_abs_error_pct", "model")).alias("b")).select("b.*")


def typical_range(pred: Column, lower_pct: Column, upper_pct: Column) -> tuple[Column, Column]:
    """low = pred / (1 + upper/100) floored at 0, high = pred / (1 + lower/100);
    a band edge of -100 % gives no bound (NULL) instead of a division by zero."""
    lo_div = F.lit(1.0) + upper_pct / 100
    hi_div = F.lit(1.0) + lower_pct / 100
    low = F.when(lo_div != 0, F.greatest(pred / lo_div, F.lit(0.0)))
    high = F.when(hi_div != 0, pred / hi_div)
    return low, high


def training_bounds(q: DataFrame) -> DataFrame:
    """A21 as a long table (kind, value): quantity and lead-time ranges and
    the distinct known materials, processes, descriptions, estimators.
    Known sets stay a table (not one collected array) so OOD checks are
    joins and nothing grows inside one row."""
    rng = q.agg(F.min("quantity").alias("quantity_min"), F.max("quantity").alias("quantity_max"),
                F.min("lead_time_weeks").alias("lead_time_min"), F.max("lead_time_weeks").alias("lead_time_max"))
    ranges = rng.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value"))
        for c in ["quantity_min", "quantity_max", "lead_time_min", "lead_time_max"]])).alias("s")).select("s.*")
    known = q.select(F.explode(F.array(
        F.struct(F.lit("material").alias("kind"), F.col("material").alias("value")),
        F.struct(F.lit("process").alias("kind"), F.col("process").alias("value")),
        F.struct(F.lit("part_description").alias("kind"), F.col("part_description").alias("value")),
        F.struct(F.lit("estimator").alias("kind"), F.col("estimator").alias("value")),
    )).alias("s")).select("s.*").where(F.col("value").isNotNull()).distinct()
    return ranges.unionByName(known)


def detect_ood(rows: DataFrame, bounds: DataFrame, id_col: str = "request_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """R7 + J5: reasons in fixed order; is_ood when any. Columns in ``keep`` go along."""
    rng = bounds.where(F.col("kind").endswith("_min") | F.col("kind").endswith("_max")) \
        .groupBy().pivot("kind", ["quantity_min", "quantity_max", "lead_time_min", "lead_time_max"]) \
        .agg(F.first(F.col("value").cast("int")))
    known = bounds.where(F.col("kind").isin("material", "process", "part_description")).select("kind", "value")

    def member(kind: str, col: str) -> DataFrame:
        return known.where(F.col("kind") == kind).select(F.col("value").alias(f"_k_{col}"))

    j = rows.crossJoin(F.broadcast(rng))  # one row
    for kind, col in [("material", "material"), ("process", "process"), ("part_description", "part_description")]:
        m = member(kind, col)
        j = j.join(m, j[col] == m[f"_k_{col}"], "left")
    qty, lt = F.col("quantity"), F.col("lead_time_weeks")
    reasons = F.array(
        F.when((qty < F.col("quantity_min")) | (qty > F.col("quantity_max")),
               F.format_string("Quantity %d outside training range [%d, %d]", qty, F.col("quantity_min"), F.col("quantity_max"))),
        F.when((lt < F.col("lead_time_min")) | (lt > F.col("lead_time_max")),
               F.format_string("LeadTimeWeeks %d outside training range [%d, %d]", lt, F.col("lead_time_min"), F.col("lead_time_max"))),
        F.when(F.col("material").isNotNull() & F.col("_k_material").isNull(),
               F.concat(F.lit("Unknown material: "), F.col("material"))),
        F.when(F.col("material").isNull(), F.lit("Missing material")),
        F.when(F.col("process").isNotNull() & F.col("_k_process").isNull(),
               F.concat(F.lit("Unknown process: "), F.col("process"))),
        F.when(F.col("process").isNull(), F.lit("Missing process")),
        F.when(F.col("_k_part_description").isNull(),
               F.concat(F.lit("Unknown part description: "), F.coalesce(F.col("part_description"), F.lit("")))),
    )
    r = F.filter(reasons, lambda x: x.isNotNull())
    return j.select(id_col, *keep, (F.size(r) > 0).alias("is_ood"), F.array_join(r, "; ").alias("reasons"),
                    F.size(r).alias("n_reasons"))


def array_median(arr: Column) -> Column:
    """Median of a small array (linear interpolation of the two middle
    values), for groups bounded by the number of models."""
    a = F.array_sort(F.filter(arr, lambda x: x.isNotNull()))
    n = F.size(a)
    lo = F.element_at(a, ((n - 1) / 2).cast("int") + 1)
    hi = F.element_at(a, (n / 2).cast("int") + 1)
    return F.when(n > 0, (lo + hi) / 2)


def _least_and_most(prices: Column) -> tuple[Column, Column]:
    return F.array_min(prices), F.array_max(prices)


def _prices(wide: DataFrame, models: list[str]) -> Column:
    """The prices of the named models that ``preds`` has, as an array."""
    have = wide.schema["preds"].dataType.names
    return F.array(*[F.col(f"preds.{m}") for m in models if m in have]) if any(m in have for m in models) \
        else F.array().cast("array<double>")


def model_disagreement(wide: DataFrame, key: str = "quote_id") -> DataFrame:
    """A20 + R9 from a row's struct ``preds``: min, max, median over models,
    spread % = (max - min) / median, flag > 20 %. No shuffle."""
    prices = _prices(wide, wide.schema["preds"].dataType.names)
    low, high = _least_and_most(prices)
    g = wide.select(key, low.alias("min_pred"), high.alias("max_pred"), array_median(prices).alias("median_pred"),
                    F.size(F.filter(prices, lambda x: x.isNotNull())).cast("long").alias("n_models"))
    spread = (F.col("max_pred") - F.col("min_pred")) / F.col("median_pred") * 100
    return g.select("*", spread.alias("spread_pct"), (spread > 20).alias("flagged"))


def recommendation(wide: DataFrame, band: DataFrame | None = None, key: str = "quote_id",
                   factor: float = S.MARGIN_FACTOR, keep: tuple[str, ...] = ()) -> DataFrame:
    """R3-R5 from a row's struct ``preds``: consensus of the top-tier models
    (median; all models when none is present), spread %, linear-vs-tree
    divergence, and win bid / protect margin = estimate x (1 + factor x band
    edge %). A quote's prices stand in one row, so nothing is shuffled."""
    have = wide.schema["preds"].dataType.names
    top = [m for m in S.TOP_TIER_LINEAR + S.TOP_TIER_TREE if m in have] or have
    prices = _prices(wide, top)
    low, high = _least_and_most(prices)
    g = wide.select(key, *keep, array_median(prices).alias("estimate"), F.lit(",".join(sorted(top))).alias("top_tier_models"),
                    (high - low).alias("_width"), array_median(_prices(wide, S.TOP_TIER_LINEAR)).alias("linear_median"),
                    array_median(_prices(wide, S.TOP_TIER_TREE)).alias("tree_median"))
    mid = (F.col("linear_median") + F.col("tree_median")) / 2
    est = F.col("estimate")
    out = g.select(
        key, *keep, "estimate", "top_tier_models",
        F.when(est > 0, F.col("_width") / est * 100).otherwise(F.lit(0.0)).alias("top_tier_spread_pct"),
        "linear_median", "tree_median",
        (F.abs(F.col("linear_median") - F.col("tree_median")) / mid * 100).alias("divergence_pct"))
    if band is not None:
        b = F.broadcast(band.select("lower_pct", "upper_pct"))  # the chosen band: one row
        out = out.crossJoin(b).withColumn("protect_margin", est * (1 + F.col("upper_pct") * factor / 100)) \
            .withColumn("win_bid", est * (1 + F.col("lower_pct") * factor / 100)) \
            .drop("lower_pct", "upper_pct")
    return out


COVERAGE_FACTORS = (0.25, 0.5, 0.75, 1.0)


def coverage(rec: DataFrame, band: DataFrame, factors: tuple[float, ...] = COVERAGE_FACTORS) -> DataFrame:
    """A27 + A29: for each margin factor the share of ``rec(estimate,
    actual)`` within win bid and protect margin, the share above the margin,
    and the dollars above it: conditional sums of one pass, then one short row
    turned into a row a factor."""
    r = rec.crossJoin(F.broadcast(band.select("lower_pct", "upper_pct")))  # the chosen band: one row
    aggs = []
    for i, f in enumerate(factors):
        high = F.col("estimate") * (1 + F.col("upper_pct") * f / 100)
        low = F.col("estimate") * (1 + F.col("lower_pct") * f / 100)
        aggs += [(F.avg(((F.col("actual") >= low) & (F.col("actual") <= high)).cast("double")) * 100).alias(f"in{i}"),
                 (F.avg((F.col("actual") > high).cast("double")) * 100).alias(f"ex{i}"),
                 F.sum(F.greatest(F.col("actual") - high, F.lit(0.0))).alias(f"at{i}")]
    one = r.agg(*aggs, F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(float(f)).alias("factor"), F.col(f"in{i}").alias("pct_in_win_protect"),
                              F.col(f"ex{i}").alias("pct_exposed"), F.col(f"at{i}").alias("dollars_at_risk"))
                     for i, f in enumerate(factors)])
    return one.select(F.explode(rows).alias("r"), "n").select("r.*", "n")
