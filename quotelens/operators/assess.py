"""How good the recommender is (A27, A28, T6, R12): errors of the estimate,
coverage of bid, margin and typical range, spreads, by price quartile, and the
worst misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import schema as S
from .predict import recommendation, typical_range
from .quantiles import grouped_stats

WORST = 10


def assessed_rows(wide: DataFrame, band: Row, key: str = "quote_id", factor: float = S.MARGIN_FACTOR) -> DataFrame:
    """``key, actual, estimate, win_bid, protect_margin, low, high`` of each
    quote from ``wide(key, actual, preds)``: the median of the top-tier
    models, the margins of the chosen band (one row, with its model's name)
    around it, and the typical range around that model's price."""
    own = wide.select("*", F.col(f"preds.{band['model']}").alias("own"))
    g = recommendation(own, None, key, keep=("actual", "own"))
    low, high = typical_range(F.col("own"), F.lit(band["lower_pct"]), F.lit(band["upper_pct"]))
    return g.select(key, "actual", "estimate", (F.col("estimate") * (1 + band["lower_pct"] * factor / 100)).alias("win_bid"),
                    (F.col("estimate") * (1 + band["upper_pct"] * factor / 100)).alias("protect_margin"),
                    low.alias("low"), high.alias("high"))


def _off(c: str) -> Column:
    return (F.col(c) - F.col("actual")) / F.col("actual") * 100


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double")) * 100


def _within(low: str, high: str) -> Column:
    return (F.col("actual") >= F.col(low)) & (F.col("actual") <= F.col(high))


def report(rows: DataFrame) -> DataFrame:
    """A27 in full, one row: errors in per cent, shares in per cent."""
    e = rows.select("*", F.abs(_off("estimate")).alias("abs_error"), _off("win_bid").alias("bid_off"),
                    _off("protect_margin").alias("margin_off"),
                    ((F.col("protect_margin") - F.col("win_bid")) / F.col("estimate") * 100).alias("bid_spread"),
                    ((F.col("high") - F.col("low")) / F.col("estimate") * 100).alias("range_spread"))
    a, est = F.col("actual"), F.col("estimate")
    return grouped_stats(e, [], [
        F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mape"), F.avg(_off("estimate")).alias("mean_signed"),
        _share(_within("win_bid", "protect_margin")).alias("in_bid_margin"), _share(_within("low", "high")).alias("in_range"),
        F.avg("bid_off").alias("bid_signed"), F.avg("margin_off").alias("margin_signed"),
        _share(F.col("win_bid") > a).alias("bid_over"), _share(F.col("protect_margin") < a).alias("exposed"),
        F.avg("bid_spread").alias("mean_bid_spread"), F.avg("range_spread").alias("mean_range_spread"),
        _share(a < F.col("win_bid")).alias("below_bid"), _share((a >= F.col("win_bid")) & (a < est)).alias("bid_to_estimate"),
        _share((a >= est) & (a < F.col("protect_margin"))).alias("estimate_to_margin"),
        _share(a >= F.col("protect_margin")).alias("above_margin"), _share(a > F.col("high")).alias("above_range"),
        _share(a < F.col("low")).alias("below_range")],
        [("median_error", "abs_error", 0.5), ("p90_error", "abs_error", 0.9), ("median_bid_off", "bid_off", 0.5),
         ("median_margin_off", "margin_off", 0.5), ("median_bid_spread", "bid_spread", 0.5),
         ("median_range_spread", "range_spread", 0.5)])


def by_price_quartile(rows: DataFrame) -> DataFrame:
    """Size, errors and coverage by half-open quartiles of the price."""
    cuts = grouped_stats(rows, [], [], [("q1", "actual", 0.25), ("q2", "actual", 0.5), ("q3", "actual", 0.75)])
    a = F.col("actual")
    quartile = F.when(a < F.col("q1"), 1).when(a < F.col("q2"), 2).when(a < F.col("q3"), 3).otherwise(4)
    return rows.crossJoin(F.broadcast(cuts)).groupBy(quartile.alias("quartile")).agg(  # one row of cuts
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(_off("estimate"))).alias("mape"), F.avg(_off("estimate")).alias("mean_signed"),
        _share(_within("win_bid", "protect_margin")).alias("in_bid_margin"), _share(_within("low", "high")).alias("in_range"))


def worst_misses(rows: DataFrame, key: str = "quote_id", n: int = WORST) -> DataFrame:
    """The ``n`` quotes that lie farthest outside their typical range, in
    per cent of the price (a top-k report: the limit is the feature)."""
    over = F.col("actual") < F.col("low")
    edge = F.when(F.col("actual") > F.col("high"), F.col("high")).when(over, F.col("low"))
    gap = F.abs(F.col("actual") - F.col("edge")) / F.col("actual") * 100
    return rows.withColumn("edge", edge).where(F.col("edge").isNotNull()).withColumn("gap_pct", gap) \
        .withColumn("direction", F.when(over, "over").otherwise("under")) \
        .orderBy(F.desc("gap_pct"), key).limit(n).select(key, "actual", "estimate", "edge", "gap_pct", "direction")
