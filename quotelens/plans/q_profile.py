"""Queries: sources (S2), parse (P4-P9), profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.enrich import materialized_quotes
from ..operators.parse import parse_distinct
from ..sources.quotes import load_quotes
from .registry import register
from .sqlbase import enriched_cte, parsed_cte, quotes_cte, with_ctes

EQ = with_ctes(enriched_cte())


@register("s02_quotes_view", oracle=with_ctes(quotes_cte())
          + "\nSELECT * REPLACE (strftime(quote_date, '%Y-%m-%d') AS quote_date) FROM quotes",
          doubles=["total_price_usd", "raw_price"])
def s02_quotes_view(spark, sf):
    """Parquet scan of the driver tables mapped to quote rows."""
    q = load_quotes(spark, sf)
    return q.withColumn("quote_date", F.date_format("quote_date", "yyyy-MM-dd"))


@register("p07_parse_descriptions",
          oracle=with_ctes(quotes_cte(), parsed_cte("quotes")) + "\nSELECT * FROM parsed",
          doubles=["match_score"])
def p07_parse_descriptions(spark, sf):
    """Parse of every distinct description."""
    return parse_distinct(load_quotes(spark, sf))


@register("a01_summary_stats", oracle=EQ + """
SELECT count(*) AS row_count, avg(total_price_usd) AS price_mean,
       stddev_samp(total_price_usd) AS price_std, min(total_price_usd) AS price_min,
       max(total_price_usd) AS price_max, quantile_cont(total_price_usd, 0.5) AS price_median
FROM eq""", doubles=["price_mean", "price_std", "price_min", "price_max", "price_median"])
def a01(spark, sf):
    return P.summary_stats(materialized_quotes(spark, sf))


QUOTE_COLUMNS = ["quote_id", "quote_date", "part_description", "material", "process", "quantity", "lead_time_weeks", "rush_job",
                 "estimator", "total_price_usd"]


@register("a01_column_summary", oracle=EQ + "\n" + " UNION ALL ".join(
    f"SELECT {i + 1} AS position, '{c}' AS column_name, count(*) AS n_rows, count_if({c} IS NULL)::BIGINT AS n_null FROM eq" for i, c in enumerate(QUOTE_COLUMNS)))
def a01c(spark, sf):
    """A1: columns, rows and missing values."""
    return P.column_summary(materialized_quotes(spark, sf), QUOTE_COLUMNS)


A2_STACK = " UNION ALL ".join(
    f"SELECT '{n}' AS dimension, CAST({c} AS VARCHAR) AS category, unit_price FROM eq"
    for n, c in P.DIMENSIONS)


@register("a02_unit_price_by_dim", oracle=EQ + f""",
st AS ({A2_STACK})
SELECT dimension, category, avg(unit_price) AS mean_unit_price,
       stddev_samp(unit_price) AS std_unit_price, count(unit_price) AS n,
       quantile_cont(unit_price, 0.5) AS median_unit_price
FROM st WHERE category IS NOT NULL GROUP BY dimension, category""",
          doubles=["mean_unit_price", "std_unit_price", "median_unit_price"])
def a02(spark, sf):
    """A2: unit price by material / description / process / estimator."""
    return P.unit_price_by_dimension(materialized_quotes(spark, sf))


def _reg_sql(group: str = "") -> str:
    sel = f"{group}, " if group else ""
    return f"""
SELECT {sel}count(*) AS n, regr_slope(ly, lx) AS slope, regr_intercept(ly, lx) AS intercept,
       corr(lx, ly) AS r, var_pop(lx) AS sxx, var_pop(ly) AS syy
FROM (SELECT ln(CAST(quantity AS DOUBLE)) AS lx, ln(unit_price) AS ly,
             string_split(part_description, ' - ')[1] AS base_part FROM eq) t
{('GROUP BY ' + group) if group else ''}"""


@register("a03_volume_discount", oracle=EQ + f""",
g AS ({_reg_sql()})
SELECT n, slope, intercept, r, r * r AS r_squared,
       sqrt((1.0 - r * r) * syy / sxx / (n - 2)) AS std_err,
       r * sqrt((n - 2) / ((1.0 - r + 1e-20) * (1.0 + r + 1e-20))) AS t_stat,
       CAST(n - 2 AS BIGINT) AS dof
FROM g""", doubles=["slope", "intercept", "r", "r_squared", "std_err", "t_stat"])
def a03(spark, sf):
    return P.volume_discount(materialized_quotes(spark, sf))


@register("a03_volume_discount_pvalue")
def a03p(spark, sf):
    return P.volume_discount_pvalue(materialized_quotes(spark, sf))


@register("a04_volume_discount_by_part", oracle=EQ + f""",
g AS ({_reg_sql('base_part')})
SELECT base_part, slope, intercept, r * r AS r_squared, CAST(n AS BIGINT) AS n FROM g WHERE n >= 3""",
          doubles=["slope", "intercept", "r_squared"])
def a04(spark, sf):
    return P.volume_discount_by_part(materialized_quotes(spark, sf))


@register("a05_rush_premium", oracle=EQ + """,
grp AS (
  SELECT avg(CASE WHEN rush_job THEN unit_price END) AS rm, avg(CASE WHEN NOT rush_job THEN unit_price END) AS nm,
         count(CASE WHEN rush_job THEN 1 END) AS nr, count(CASE WHEN NOT rush_job THEN 1 END) AS nn
  FROM eq WHERE material IS NOT NULL AND process IS NOT NULL
  GROUP BY part_description, material, process),
ctl AS (SELECT avg(rm / nm) AS controlled_mean_ratio, count(*) AS n_controlled_groups FROM grp WHERE nr > 0 AND nn > 0),
marg AS (SELECT avg(CASE WHEN rush_job THEN unit_price END) AS rush_mean_unit_price,
                avg(CASE WHEN NOT rush_job THEN unit_price END) AS no_rush_mean_unit_price FROM eq)
SELECT controlled_mean_ratio, n_controlled_groups, rush_mean_unit_price / no_rush_mean_unit_price AS marginal_ratio,
       rush_mean_unit_price, no_rush_mean_unit_price FROM ctl CROSS JOIN marg""",
          doubles=["controlled_mean_ratio", "marginal_ratio", "rush_mean_unit_price",
                   "no_rush_mean_unit_price"])
def a05(spark, sf):
    """A5 + A6 + J3 + U3."""
    return P.rush_premium(materialized_quotes(spark, sf))


@register("a07_rush_by_part_material", oracle=EQ + """,
st AS (SELECT 'part_type' AS dimension, string_split(part_description, ' - ')[1] AS category, rush_job, unit_price FROM eq
       UNION ALL SELECT 'material', material, rush_job, unit_price FROM eq),
g AS (SELECT dimension, category,
        avg(CASE WHEN rush_job THEN unit_price END) AS rm, avg(CASE WHEN NOT rush_job THEN unit_price END) AS nm,
        count(CASE WHEN rush_job THEN 1 END) AS n_rush, count(CASE WHEN NOT rush_job THEN 1 END) AS n_no_rush
      FROM st WHERE category IS NOT NULL GROUP BY dimension, category)
SELECT dimension, category, rm / nm AS ratio, n_rush, n_no_rush FROM g WHERE n_rush > 0 AND n_no_rush > 0""",
          doubles=["ratio"])
def a07(spark, sf):
    return P.rush_premium_breakdown(materialized_quotes(spark, sf))


@register("a08_lead_time_correlation", oracle=EQ + """,
g AS (SELECT corr(CAST(lead_time_weeks AS DOUBLE), unit_price) AS r, count(*) AS n FROM eq)
SELECT r AS correlation, CAST(n AS BIGINT) AS n, r * sqrt((n - 2) / ((1.0 - r) * (1.0 + r))) AS t_stat,
       CAST(n - 2 AS BIGINT) AS dof FROM g""", doubles=["correlation", "t_stat"])
def a08(spark, sf):
    return P.lead_time_correlation(materialized_quotes(spark, sf))


@register("a08_lead_time_pvalue")
def a08p(spark, sf):
    return P.lead_time_correlation_pvalue(materialized_quotes(spark, sf))


@register("a09_lead_time_buckets", oracle=EQ + """,
b AS (SELECT CASE WHEN lead_time_weeks > 0 AND lead_time_weeks <= 4 THEN 'short (2-4)'
                  WHEN lead_time_weeks > 4 AND lead_time_weeks <= 8 THEN 'medium (5-8)'
                  WHEN lead_time_weeks > 8 AND lead_time_weeks <= 12 THEN 'long (9-12)' END AS bucket, unit_price FROM eq),
s AS (SELECT bucket, avg(unit_price) AS mean_unit_price, quantile_cont(unit_price, 0.5) AS median_unit_price,
             count(unit_price) AS n FROM b WHERE bucket IS NOT NULL GROUP BY bucket),
k AS (SELECT * FROM (VALUES (0, 'short (2-4)'), (1, 'medium (5-8)'), (2, 'long (9-12)')) t(bucket_order, bucket))
SELECT k.bucket, CAST(k.bucket_order AS INTEGER) AS bucket_order, s.mean_unit_price, s.median_unit_price,
       CAST(COALESCE(s.n, 0) AS BIGINT) AS n
FROM k LEFT JOIN s ON k.bucket = s.bucket""", doubles=["mean_unit_price", "median_unit_price"])
def a09(spark, sf):
    return P.lead_time_buckets(materialized_quotes(spark, sf))


@register("a10_contingency", oracle=EQ + """
SELECT CAST(estimator AS VARCHAR) AS row_level, CAST(part_description AS VARCHAR) AS col_level, count(*) AS n
FROM eq WHERE estimator IS NOT NULL AND part_description IS NOT NULL GROUP BY 1, 2""")
def a10(spark, sf):
    return P.contingency(materialized_quotes(spark, sf))


def _chi2_sql() -> str:
    stack = " UNION ALL ".join(
        f"SELECT '{a}_x_{b}' AS pair, CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y FROM eq"
        for a, b in P.CHI2_PAIRS)
    # Spark casts booleans to 'true'/'false'; DuckDB too.
    return EQ + f""",
st AS (SELECT * FROM ({stack}) s WHERE x IS NOT NULL AND y IS NOT NULL),
obs AS (SELECT pair, x, y, count(*) AS o FROM st GROUP BY pair, x, y),
rws AS (SELECT pair, x, sum(o) AS rt FROM obs GROUP BY pair, x),
cls AS (SELECT pair, y, sum(o) AS ct FROM obs GROUP BY pair, y),
dims AS (SELECT pair, (SELECT count(*) FROM rws r WHERE r.pair = t.pair) AS nx,
                (SELECT count(*) FROM cls c WHERE c.pair = t.pair) AS ny, sum(o) AS n
         FROM obs t GROUP BY pair),
grid AS (SELECT r.pair, r.x, c.y, r.rt, c.ct, CAST(COALESCE(o.o, 0) AS DOUBLE) AS o, d.n, (d.nx - 1) * (d.ny - 1) AS dof
         FROM rws r JOIN cls c ON r.pair = c.pair LEFT JOIN obs o ON o.pair = r.pair AND o.x = r.x AND o.y = c.y
         JOIN dims d ON d.pair = r.pair),
terms AS (SELECT pair, dof, CAST(rt AS DOUBLE) * CAST(ct AS DOUBLE) / CAST(n AS DOUBLE) AS e, abs(o - CAST(rt AS DOUBLE) * CAST(ct AS DOUBLE) / CAST(n AS DOUBLE)) AS diff FROM grid),
adj AS (SELECT pair, dof, e, CASE WHEN dof = 1 THEN diff - least(0.5, diff) ELSE diff END AS a FROM terms)
SELECT pair, sum(a * a / e) AS chi2, CAST(dof AS BIGINT) AS dof FROM adj GROUP BY pair, dof"""


@register("a11_chi_squared", oracle=_chi2_sql(), doubles=["chi2"])
def a11(spark, sf):
    return P.chi_squared(materialized_quotes(spark, sf))


@register("a11_chi_squared_pvalue")
def a11p(spark, sf):
    return P.chi_squared_pvalue(materialized_quotes(spark, sf))


@register("a12_mean_pivot", oracle=EQ + """
SELECT estimator, string_split(part_description, ' - ')[1] AS base_part, avg(unit_price) AS mean_unit_price,
       count(unit_price) AS n FROM eq GROUP BY 1, 2""", doubles=["mean_unit_price"])
def a12(spark, sf):
    return P.mean_pivot(materialized_quotes(spark, sf))


@register("a13_conditional_means", oracle=EQ + """,
c AS (SELECT * FROM eq WHERE material IS NOT NULL),
gm AS (SELECT part_description, material, avg(unit_price) AS gmean FROM c GROUP BY 1, 2),
res AS (SELECT estimator, avg(unit_price - gmean) AS adj FROM c JOIN gm USING (part_description, material) GROUP BY 1),
marg AS (SELECT estimator, avg(unit_price) AS marginal_mean FROM eq GROUP BY 1)
SELECT m.estimator, m.marginal_mean, (SELECT avg(unit_price) FROM c) + r.adj AS conditional_mean
FROM marg m LEFT JOIN res r ON m.estimator = r.estimator""", doubles=["marginal_mean", "conditional_mean"])
def a13(spark, sf):
    return P.conditional_means(materialized_quotes(spark, sf))
