"""Queries: validation and data quality."""

from __future__ import annotations

from .. import schema as S
from ..operators import quality as V
from ..sources.quotes import load_dirty_quotes, quote_requests
from .registry import register
from .sqlbase import dirty_cte, quotes_cte, with_ctes

DQ = with_ctes(quotes_cte(), dirty_cte())


def _in(values) -> str:
    return "(" + ", ".join(repr(v) if isinstance(v, int) else "'" + v + "'" for v in values) + ")"


def _sorted_join_sql(col: str, cond: str) -> str:
    return (f"array_to_string(list_transform(list_sort(list(DISTINCT {col}) FILTER (WHERE {cond})), "
            f"lambda x: CAST(x AS VARCHAR)), ',')")


_BADQ = f"quantity NOT IN {_in(S.VALID_QUANTITIES)}"
_UM = f"material IS NOT NULL AND material NOT IN {_in(S.VALID_MATERIALS)}"
_UP = f"process IS NOT NULL AND process NOT IN {_in(S.VALID_PROCESSES)}"
_UE = f"estimator IS NULL OR estimator NOT IN {_in(S.VALID_ESTIMATORS)}"
_RULES = [
    ("V01_non_positive_price", "critical", "count_if(total_price_usd <= 0)", "NULL"),
    ("V02_rush_null", "critical", "count_if(rush_job IS NULL)", "NULL"),
    ("V03_invalid_quantity", "critical", f"count_if({_BADQ})", _sorted_join_sql("quantity", _BADQ)),
    ("V04_missing_material", "warning", "count_if(material IS NULL)", "NULL"),
    ("V05_missing_process", "warning", "count_if(process IS NULL)", "NULL"),
    ("V06_unknown_material", "warning", f"count_if({_UM})", _sorted_join_sql("material", _UM)),
    ("V07_unknown_process", "warning", f"count_if({_UP})", _sorted_join_sql("process", _UP)),
    ("V08_unknown_estimator", "warning", f"count_if({_UE})", _sorted_join_sql("COALESCE(estimator, 'NULL')", _UE)),
    ("V09_duplicate_quote_id", "warning", "count(*) - count(DISTINCT quote_id)", "NULL"),
    ("V10_lead_time_below_1", "warning", "count_if(lead_time_weeks < 1)", "CAST(min(lead_time_weeks) AS VARCHAR)"),
]
_REPORT_SQL = DQ + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{r}' AS rule, '{s}' AS severity, CAST({n} AS BIGINT) AS n_rows, CAST({d} AS VARCHAR) AS detail FROM dirty"
    for r, s, n, d in _RULES)


@register("v01_validation_report", oracle=_REPORT_SQL)
def v01(spark, sf):
    """V1-V10 + U1: every rule in one aggregate over the dirty view."""
    return V.validation_report(load_dirty_quotes(spark, sf))


_INVALID = [("V03_invalid_quantity", "CAST(quantity AS VARCHAR)", _BADQ), ("V06_unknown_material", "material", _UM),
            ("V07_unknown_process", "process", _UP), ("V08_unknown_estimator", "COALESCE(estimator, 'NULL')", _UE)]


@register("v03_invalid_values", oracle=DQ + "\n" + " UNION ALL ".join(
    f"SELECT '{r}' AS rule, {v} AS value, count(*) AS n FROM dirty WHERE {c} GROUP BY 2" for r, v, c in _INVALID))
def v03(spark, sf):
    """V3, V6-V8 in detail: every value outside its domain, with its count."""
    return V.invalid_values(load_dirty_quotes(spark, sf))


_MISSING_COLS = ["quote_id", "quote_date", "part_description", "material", "process", "quantity",
                 "lead_time_weeks", "rush_job", "estimator", "total_price_usd"]


@register("v17_missing_counts", oracle=DQ + ",\nm AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS n_missing FROM dirty"
    for c in _MISSING_COLS) + ")\nSELECT * FROM m WHERE n_missing > 0")
def v17(spark, sf):
    return V.missing_counts(load_dirty_quotes(spark, sf))


@register("v18_missing_ids", oracle=DQ + """
SELECT quote_id, material IS NULL AS missing_material, process IS NULL AS missing_process,
       material IS NULL AND process IS NULL AS missing_both
FROM dirty WHERE material IS NULL OR process IS NULL""")
def v18(spark, sf):
    return V.missing_ids(load_dirty_quotes(spark, sf))


@register("v19_missing_overlap", oracle=DQ + """
SELECT quote_id FROM dirty WHERE material IS NULL
INTERSECT SELECT quote_id FROM dirty WHERE process IS NULL""")
def v19(spark, sf):
    return V.missing_overlap(load_dirty_quotes(spark, sf))


@register("v20_missing_by_group", oracle=DQ + """,
m AS (SELECT * FROM dirty WHERE material IS NULL OR process IS NULL)
SELECT 'estimator' AS dimension, estimator AS category, count(*) AS n FROM m GROUP BY 2
UNION ALL SELECT 'part_description', part_description, count(*) FROM m GROUP BY 2""")
def v20(spark, sf):
    return V.missing_by_group(load_dirty_quotes(spark, sf))


def _request_sql() -> str:
    desc = "trim(part_description)"
    checks = [
        ("part_description", "length must be 1-200",
         "part_description IS NULL OR length(part_description) < 1 OR length(part_description) > 200"),
        ("part_description", "must not be blank", f"length({desc}) = 0"),
        ("part_description", "must contain only printable ASCII characters",
         f"length({desc}) > 0 AND NOT regexp_matches({desc}, '{V.PRINTABLE}')"),
        ("material", "unknown material", _UM),
        ("process", "unknown process", _UP),
        ("quantity", "must be greater than 0", "quantity <= 0"),
        ("quantity", "invalid quantity", _BADQ),
        ("lead_time_weeks", "must be between 1 and 52", "NOT (lead_time_weeks BETWEEN 1 AND 52)"),
        ("estimator", "unknown estimator", f"estimator IS NOT NULL AND estimator NOT IN {_in(S.VALID_ESTIMATORS)}"),
    ]
    arr = ", ".join(f"CASE WHEN COALESCE(({c}), TRUE) THEN '{f}: {m}' END" for f, m, c in checks)
    return DQ + f""",
e AS (SELECT request_id, list_filter([{arr}], lambda x: x IS NOT NULL) AS errs FROM requests)
SELECT request_id, array_to_string(errs, '; ') AS errors, len(errs) = 0 AS is_valid FROM e"""


@register("v12_request_validation", oracle=_request_sql())
def v12(spark, sf):
    """All failing fields of each quote request."""
    return V.request_errors(quote_requests(load_dirty_quotes(spark, sf)))
