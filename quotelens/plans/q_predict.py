"""Queries: bands, bounds, OOD, lenses, bias."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bias as B
from ..operators import lenses as L
from ..operators import predict as PR
from ..operators.enrich import materialized_quotes
from ..sources.quotes import load_dirty_quotes, quote_requests
from .q_models import m0_fold_metrics, m0_oof_table
from .registry import register
from .sqlbase import dirty_cte, enriched_cte, fold_metrics_cte, m0_oof_cte, with_ctes

OOF = with_ctes(enriched_cte(), m0_oof_cte())
TAIL = (1 - 0.80) / 2


def _p(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


@register("a19_prediction_bands", oracle=OOF + f""",
e AS (SELECT model, (pred - actual) / actual * 100 AS s FROM oof)
SELECT model, CAST(0.8 AS DOUBLE) AS coverage, quantile_cont(s, {_p(TAIL)}) AS lower_pct,
       quantile_cont(s, {_p(1 - TAIL)}) AS upper_pct, quantile_cont(abs(s), 0.5) AS median_abs_error_pct
FROM e GROUP BY model""", doubles=["coverage", "lower_pct", "upper_pct", "median_abs_error_pct"])
def a19(spark, sf):
    return PR.empirical_bands(m0_oof_table(spark, sf))


@register("a21_training_bounds", oracle=with_ctes(enriched_cte()) + """
SELECT 'quantity_min' AS kind, CAST(min(quantity) AS VARCHAR) AS value FROM eq
UNION ALL SELECT 'quantity_max', CAST(max(quantity) AS VARCHAR) FROM eq
UNION ALL SELECT 'lead_time_min', CAST(min(lead_time_weeks) AS VARCHAR) FROM eq
UNION ALL SELECT 'lead_time_max', CAST(max(lead_time_weeks) AS VARCHAR) FROM eq
UNION ALL SELECT DISTINCT 'material', material FROM eq WHERE material IS NOT NULL
UNION ALL SELECT DISTINCT 'process', process FROM eq WHERE process IS NOT NULL
UNION ALL SELECT DISTINCT 'part_description', part_description FROM eq WHERE part_description IS NOT NULL
UNION ALL SELECT DISTINCT 'estimator', estimator FROM eq WHERE estimator IS NOT NULL""")
def a21(spark, sf):
    return PR.training_bounds(materialized_quotes(spark, sf))


@register("r07_ood_flags", oracle=with_ctes(enriched_cte(), dirty_cte()) + """,
rng AS (SELECT min(quantity) AS qmin, max(quantity) AS qmax, min(lead_time_weeks) AS lmin, max(lead_time_weeks) AS lmax FROM eq),
km AS (SELECT DISTINCT material AS v FROM eq WHERE material IS NOT NULL),
kp AS (SELECT DISTINCT process AS v FROM eq WHERE process IS NOT NULL),
kd AS (SELECT DISTINCT part_description AS v FROM eq WHERE part_description IS NOT NULL),
j AS (
  SELECT r.request_id, list_filter([
    CASE WHEN r.quantity < qmin OR r.quantity > qmax THEN printf('Quantity %d outside training range [%d, %d]', r.quantity, qmin, qmax) END,
    CASE WHEN r.lead_time_weeks < lmin OR r.lead_time_weeks > lmax THEN printf('LeadTimeWeeks %d outside training range [%d, %d]', r.lead_time_weeks, lmin, lmax) END,
    CASE WHEN r.material IS NOT NULL AND km.v IS NULL THEN 'Unknown material: ' || r.material END,
    CASE WHEN r.material IS NULL THEN 'Missing material' END,
    CASE WHEN r.process IS NOT NULL AND kp.v IS NULL THEN 'Unknown process: ' || r.process END,
    CASE WHEN r.process IS NULL THEN 'Missing process' END,
    CASE WHEN kd.v IS NULL THEN 'Unknown part description: ' || COALESCE(r.part_description, '') END
  ], lambda x: x IS NOT NULL) AS rs
  FROM requests r CROSS JOIN rng LEFT JOIN km ON r.material = km.v LEFT JOIN kp ON r.process = kp.v
  LEFT JOIN kd ON r.part_description = kd.v)
SELECT request_id, len(rs) > 0 AS is_ood, array_to_string(rs, '; ') AS reasons, CAST(len(rs) AS INTEGER) AS n_reasons FROM j""")
def r07(spark, sf):
    """R7 + J5: OOD reasons for quote requests against training bounds."""
    bounds = PR.training_bounds(materialized_quotes(spark, sf))
    return PR.detect_ood(quote_requests(load_dirty_quotes(spark, sf)), bounds)


@register("r06_typical_range", oracle=OOF + f""",
b AS (SELECT model, quantile_cont((pred - actual) / actual * 100, {_p(TAIL)}) AS lo,
             quantile_cont((pred - actual) / actual * 100, {_p(1 - TAIL)}) AS hi FROM oof GROUP BY model)
SELECT o.quote_id, o.model, o.actual, o.pred,
  CASE WHEN 1.0 + b.hi / 100 <> 0 THEN greatest(o.pred / (1.0 + b.hi / 100), 0.0) END AS typical_low,
  CASE WHEN 1.0 + b.lo / 100 <> 0 THEN o.pred / (1.0 + b.lo / 100) END AS typical_high
FROM oof o JOIN b ON o.model = b.model""", doubles=["actual", "pred", "typical_low", "typical_high"])
def r06(spark, sf):
    """R6 + J11: each out-of-fold prediction with its model's band applied."""
    oof = m0_oof_table(spark, sf)
    bands = PR.empirical_bands(oof)
    j = oof.join(F.broadcast(bands.select("model", "lower_pct", "upper_pct")), "model")  # one row per model
    low, high = PR.typical_range(F.col("pred"), F.col("lower_pct"), F.col("upper_pct"))
    return j.select("quote_id", "model", "actual", "pred", low.alias("typical_low"), high.alias("typical_high"))


@register("l01_error_profile", oracle=OOF + """,
e AS (SELECT model, abs(actual - pred) / actual * 100 AS ape, (pred - actual) / actual * 100 AS signed FROM oof)
SELECT model, avg(ape) AS mape, max(ape) AS max_ape, skewness(signed) AS skew,
  avg(CAST(ape < 5 AS DOUBLE)) * 100 AS pct_under_5, avg(CAST(ape < 10 AS DOUBLE)) * 100 AS pct_under_10,
  avg(CAST(ape < 20 AS DOUBLE)) * 100 AS pct_under_20, avg(CAST(ape > 50 AS DOUBLE)) * 100 AS pct_over_50,
  count(*) AS n, quantile_cont(ape, 0.5) AS median_ape, quantile_cont(ape, 0.9) AS p90_ape,
  quantile_cont(ape, 0.95) AS p95_ape
FROM e GROUP BY model""", doubles=["mape", "max_ape", "skew", "pct_under_5", "pct_under_10", "pct_under_20",
                                  "pct_over_50", "median_ape", "p90_ape", "p95_ape"])
def l01(spark, sf):
    return L.error_profile(m0_oof_table(spark, sf))


_CUTS = """
cuts AS (SELECT quantile_cont(actual, 0.25) AS q1, quantile_cont(actual, 0.5) AS q2, quantile_cont(actual, 0.75) AS q3
         FROM oof WHERE model = (SELECT min(model) FROM oof)),
r AS (SELECT * FROM oof CROSS JOIN cuts)"""


@register("l02_segment_fairness", oracle=OOF + "," + _CUTS + """,
st AS (
  SELECT model, 'by_price_quartile' AS segment,
    CASE WHEN actual <= q1 THEN 'Q1 (cheapest)' WHEN actual <= q2 THEN 'Q2' WHEN actual <= q3 THEN 'Q3' ELSE 'Q4 (priciest)' END AS category,
    abs(actual - pred) / actual * 100 AS ape FROM r
  UNION ALL SELECT model, 'by_material', COALESCE(material, 'Missing'), abs(actual - pred) / actual * 100 FROM r
  UNION ALL SELECT model, 'by_part_type', string_split(part_description, ' - ')[1], abs(actual - pred) / actual * 100 FROM r
  UNION ALL SELECT model, 'by_quantity_band',
    CASE WHEN quantity > 0 AND quantity <= 1 THEN 'qty=1' WHEN quantity > 1 AND quantity <= 10 THEN 'qty=5-10'
         WHEN quantity > 10 AND quantity <= 50 THEN 'qty=20-50' WHEN quantity > 50 AND quantity <= 100 THEN 'qty=100' END,
    abs(actual - pred) / actual * 100 FROM r
  UNION ALL SELECT model, 'by_estimator', estimator, abs(actual - pred) / actual * 100 FROM r)
SELECT model, segment, category, avg(ape) AS mape, count(*) AS n, quantile_cont(ape, 0.5) AS median_ape
FROM st WHERE category IS NOT NULL GROUP BY model, segment, category""", doubles=["mape", "median_ape"])
def l02(spark, sf):
    return L.segment_fairness(m0_oof_table(spark, sf))


@register("l04_calibration", oracle=OOF + """,
e AS (SELECT model, pred - actual AS sd, (pred - actual) / actual * 100 AS sp FROM oof)
SELECT model, avg(sd) AS mean_signed_error_dollars, avg(sp) AS mean_signed_error_pct,
  avg(CAST(sd > 0 AS DOUBLE)) * 100 AS pct_overestimated, quantile_cont(sp, 0.5) AS median_signed_error_pct,
  CASE WHEN avg(sp) > 3 THEN 'conservative' WHEN avg(sp) < -3 THEN 'aggressive' ELSE 'balanced' END AS label
FROM e GROUP BY model""", doubles=["mean_signed_error_dollars", "mean_signed_error_pct", "pct_overestimated",
                                  "median_signed_error_pct"])
def l04(spark, sf):
    return L.calibration(m0_oof_table(spark, sf))


@register("l04_calibration_by_quartile", oracle=OOF + "," + _CUTS + """
SELECT model, CASE WHEN actual <= q1 THEN 'Q1' WHEN actual <= q2 THEN 'Q2' WHEN actual <= q3 THEN 'Q3' ELSE 'Q4' END AS quartile,
  avg((pred - actual) / actual * 100) AS mean_signed_pct, avg(CAST(pred - actual > 0 AS DOUBLE)) * 100 AS pct_overestimated,
  count(*) AS n
FROM r GROUP BY 1, 2""", doubles=["mean_signed_pct", "pct_overestimated"])
def l04q(spark, sf):
    return L.calibration_by_quartile(m0_oof_table(spark, sf))


@register("l05_fold_stability", oracle=with_ctes(enriched_cte(), m0_oof_cte(), fold_metrics_cte()) + """
SELECT model, avg(MAPE) AS fold_mape_mean, stddev_pop(MAPE) AS fold_mape_std, max(MAPE) - min(MAPE) AS fold_mape_range,
       count(*) AS n_folds, array_to_string(list(CAST(round(MAPE, 6) AS VARCHAR) ORDER BY fold), ',') AS fold_mapes
FROM fm GROUP BY model""", doubles=["fold_mape_mean", "fold_mape_std", "fold_mape_range"])
def l05(spark, sf):
    """L5, A25, with the folds' MAPEs as text."""
    s = L.fold_stability(m0_fold_metrics(spark, sf))
    return s.withColumn("fold_mapes", F.array_join(F.transform("fold_mapes", lambda x: F.round(x, 6).cast("string")), ","))


_BIAS = OOF + """,
br AS (SELECT quote_id, estimator, material, base_part_type, quote_date, actual,
              (actual - greatest(pred, 1.0)) / actual * 100 AS pct_bias FROM oof WHERE model = 'M0')"""


def _bias_rows(spark, sf):
    return B.bias_rows(m0_oof_table(spark, sf), "M0")


@register("a17_bias_summary", oracle=_BIAS + """
SELECT estimator, avg(pct_bias) AS mean_pct_bias, stddev_pop(pct_bias) AS std_pct_bias, count(*) AS n_quotes,
       quantile_cont(pct_bias, 0.5) AS median_pct_bias FROM br GROUP BY estimator""",
          doubles=["mean_pct_bias", "std_pct_bias", "median_pct_bias"])
def a17(spark, sf):
    """A17 + M17: bias per estimator against the neutral out-of-fold price."""
    return B.bias_summary(_bias_rows(spark, sf))


_BREAK = _BIAS + """,
bb AS (
  SELECT estimator, dimension, category, avg(pct_bias) AS mean_pct_bias, count(*) AS n_quotes FROM (
    SELECT estimator, 'part_type' AS dimension, base_part_type AS category, pct_bias FROM br
    UNION ALL SELECT estimator, 'material', material, pct_bias FROM br
    UNION ALL SELECT estimator, 'year_month', strftime(quote_date, '%Y-%m'), pct_bias FROM br) s
  WHERE category IS NOT NULL GROUP BY 1, 2, 3)"""


@register("a18_bias_breakdown", oracle=_BREAK + "\nSELECT * FROM bb", doubles=["mean_pct_bias"])
def a18(spark, sf):
    return B.bias_breakdown(_bias_rows(spark, sf))


@register("t05_top_part_deviations", oracle=_BREAK + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY estimator ORDER BY abs(mean_pct_bias) DESC, category) AS rank
       FROM bb WHERE dimension = 'part_type')
SELECT estimator, dimension, category, mean_pct_bias, n_quotes, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 5""",
          doubles=["mean_pct_bias"])
def t05(spark, sf):
    return B.top_part_deviations(B.bias_breakdown(_bias_rows(spark, sf)))


@register("j12_bias_matrix", oracle=_BREAK + """,
pt AS (SELECT * FROM bb WHERE dimension = 'part_type')
SELECT e.estimator, c.category AS part_type, COALESCE(pt.mean_pct_bias, 0.0) AS mean_pct_bias
FROM (SELECT DISTINCT estimator FROM pt) e CROSS JOIN (SELECT DISTINCT category FROM pt) c
LEFT JOIN pt ON pt.estimator = e.estimator AND pt.category = c.category""", doubles=["mean_pct_bias"])
def j12(spark, sf):
    return B.bias_matrix(B.bias_breakdown(_bias_rows(spark, sf)))


@register("m14_bias_bootstrap_ci")
def m14(spark, sf):
    """M14 + P28: Poisson-bootstrap 95 % CI of the mean bias and the label."""
    rows = _bias_rows(spark, sf)
    return B.bias_labels(B.bias_summary(rows), B.bootstrap_ci(rows))
