"""Queries: quote workflow from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import workflow as W
from ..operators.stage import cached_stage
from ..sources.events import load_workflow_events, outcome_requests, override_requests
from .registry import register
from .sqlbase import _s, with_ctes

TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_SQL = "'%Y-%m-%d %H:%M:%S.%f'"
_REASONS = "[" + ", ".join(_s(r) for r in S.OVERRIDE_REASONS) + "]"

WF_CTE = f"""
    wev AS (
      SELECT event_id,
        CAST(user_id AS VARCHAR) || '-' || CAST(CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 5) AS BIGINT) AS VARCHAR) AS quote_id,
        CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'override' WHEN 'click' THEN 'sent'
                        WHEN 'purchase' THEN 'outcome' WHEN 'error' THEN 'outcome' END AS event,
        CASE event_type WHEN 'purchase' THEN 'won' WHEN 'error' THEN 'lost' END AS outcome,
        CAST(ts AS TIMESTAMP) AS event_time,
        CAST(1000.0 AS DOUBLE) + CAST(10.0 AS DOUBLE) * CAST(user_id % 97 AS DOUBLE) AS model_price,
        CASE WHEN event_type = 'view' THEN CAST(1000.0 AS DOUBLE) + CAST(10.0 AS DOUBLE) * CAST(user_id % 97 AS DOUBLE) + value - CAST(100.0 AS DOUBLE) END AS human_price,
        CASE WHEN event_type = 'view' THEN ({_REASONS})[CAST(event_id % 8 AS INTEGER) + 1] END AS reason,
        row_number() OVER (ORDER BY ts, event_id) AS rn
      FROM events WHERE event_type IN ('signup', 'view', 'click', 'purchase', 'error')),
    mc AS (SELECT quote_id, min(rn) AS t_c FROM wev WHERE event = 'created' GROUP BY quote_id),
    e1 AS (SELECT w.*, mc.t_c FROM wev w LEFT JOIN mc USING (quote_id)),
    ms AS (SELECT quote_id, min(rn) AS t_s FROM e1 WHERE event = 'sent' AND rn > t_c GROUP BY quote_id),
    mr AS (SELECT quote_id, min(rn) AS t_r FROM e1 WHERE event = 'override' AND rn > t_c GROUP BY quote_id),
    e2 AS (SELECT e1.*, ms.t_s, mr.t_r FROM e1 LEFT JOIN ms USING (quote_id) LEFT JOIN mr USING (quote_id)),
    mo AS (SELECT quote_id, min(rn) AS t_o, arg_min(outcome, rn) AS o_kind FROM e2 WHERE event = 'outcome' AND rn > t_s GROUP BY quote_id),
    e3 AS (SELECT e2.*, mo.t_o, mo.o_kind FROM e2 LEFT JOIN mo USING (quote_id)),
    lc AS (
      SELECT *,
        CASE WHEN event = 'created' THEN (CASE WHEN rn = t_c THEN NULL ELSE 'ALREADY_EXISTS' END)
             WHEN t_c IS NULL OR rn < t_c THEN 'QUOTE_NOT_FOUND'
             WHEN event = 'override' THEN NULL
             WHEN event = 'sent' THEN (CASE WHEN rn = t_s THEN NULL WHEN t_o IS NOT NULL AND rn > t_o THEN 'QUOTE_CLOSED' ELSE 'ALREADY_SENT' END)
             WHEN event = 'outcome' THEN (CASE WHEN t_o IS NOT NULL AND rn = t_o THEN NULL ELSE 'INVALID_STATE' END) END AS code,
        CASE WHEN t_o IS NOT NULL AND rn >= t_o THEN o_kind WHEN t_s IS NOT NULL AND rn >= t_s THEN 'sent'
             WHEN t_r IS NOT NULL AND rn >= t_r THEN 'review' WHEN t_c IS NOT NULL AND rn >= t_c THEN 'draft' END AS status_after
      FROM e3),
    acc AS (SELECT * FROM lc WHERE code IS NULL),
    ov AS (SELECT event_id, quote_id, event_time, model_price, human_price, reason, rn,
                  human_price - model_price AS delta, (human_price - model_price) / model_price * 100 AS delta_pct
           FROM acc WHERE event = 'override'),
    ql AS (
      SELECT c.quote_id, l.status, c.event_time AS created_at, c.model_price,
             COALESCE(l.last_override, c.model_price) AS final_price, l.n_overrides
      FROM (SELECT * FROM acc WHERE event = 'created') c JOIN (
        SELECT quote_id, arg_max(status_after, rn) AS status,
               arg_max(human_price, rn) FILTER (WHERE event = 'override') AS last_override,
               count(*) FILTER (WHERE event = 'override') AS n_overrides
        FROM acc GROUP BY quote_id) l ON l.quote_id = c.quote_id)"""

WF = with_ctes(WF_CTE)


def _lc(spark, sf):
    """The replay, written once and shared by every workflow query."""
    return cached_stage(spark, "lifecycle", sf, lambda: W.lifecycle(load_workflow_events(spark, sf)))


@register("q03_lifecycle", oracle=WF + f"""
SELECT event_id, quote_id, event, outcome, strftime(event_time, {TS_SQL}) AS event_time, model_price, human_price,
       reason, code IS NULL AS accepted, code, status_after FROM lc""", doubles=["model_price", "human_price"])
def q03(spark, sf):
    """Q3: every event replayed with its acceptance code and status."""
    return _lc(spark, sf).withColumn("event_time", F.date_format("event_time", TS))


@register("q02_overrides", oracle=WF + f"""
SELECT event_id, quote_id, strftime(event_time, {TS_SQL}) AS event_time, model_price, human_price, reason, delta, delta_pct FROM ov""",
          doubles=["model_price", "human_price", "delta", "delta_pct"])
def q02(spark, sf):
    return W.overrides(_lc(spark, sf)).withColumn("event_time", F.date_format("event_time", TS))


@register("q05_quote_list", oracle=WF + f"""
SELECT quote_id, status, strftime(created_at, {TS_SQL}) AS created_at, model_price, final_price, n_overrides FROM ql""",
          doubles=["model_price", "final_price"])
def q05(spark, sf):
    """Q4 + Q5 + J10: current state of every quote, newest first."""
    return W.quote_list(_lc(spark, sf)).withColumn("created_at", F.date_format("created_at", TS))


@register("q06_timeline", oracle=WF + """,
g AS (SELECT quote_id, min(event_time) FILTER (WHERE event = 'created') AS created_at,
             max(event_time) FILTER (WHERE event = 'override') AS overridden_at,
             min(event_time) FILTER (WHERE event = 'sent') AS sent_at,
             min(event_time) FILTER (WHERE event = 'outcome') AS outcome_at,
             max(outcome) FILTER (WHERE event = 'outcome') AS outcome
      FROM acc GROUP BY quote_id)
SELECT quote_id, array_to_string(list_filter([
   'Created@' || strftime(created_at, '%Y-%m-%d %H:%M:%S'),
   CASE WHEN overridden_at IS NOT NULL THEN 'Overridden@' || strftime(overridden_at, '%Y-%m-%d %H:%M:%S') END,
   CASE WHEN sent_at IS NOT NULL THEN 'Sent@' || strftime(sent_at, '%Y-%m-%d %H:%M:%S') END,
   CASE WHEN outcome_at IS NOT NULL THEN upper(outcome[1]) || outcome[2:] || '@' || strftime(outcome_at, '%Y-%m-%d %H:%M:%S') END
 ], lambda x: x IS NOT NULL), ' | ') AS timeline
FROM g WHERE created_at IS NOT NULL""")
def q06(spark, sf):
    return W.quote_timeline(_lc(spark, sf))


@register("q07_status_counts", oracle=WF + "\nSELECT status, count(*) AS n FROM ql GROUP BY status")
def q07(spark, sf):
    return W.status_counts(W.quote_list(_lc(spark, sf)))


@register("s10_retention_90d", oracle=WF + f"""
SELECT quote_id, status, strftime(created_at, {TS_SQL}) AS created_at, model_price, final_price, n_overrides FROM ql
WHERE created_at >= (SELECT max(created_at) FROM ql) + INTERVAL 75 DAYS - INTERVAL 90 DAYS""", doubles=["model_price", "final_price"])
def s10(spark, sf):
    """S10 as of 75 days after the newest quote, so that the older half goes."""
    return W.retention(W.quote_list(_lc(spark, sf)), later_days=75).withColumn("created_at", F.date_format("created_at", TS))


@register("a31_daily_drift", oracle=WF + """,
cr AS (SELECT CAST(event_time AS DATE) AS day, count(*) AS n_created FROM acc WHERE event = 'created' GROUP BY 1),
od AS (SELECT CAST(event_time AS DATE) AS day, count(*) AS n_overrides, avg(abs(delta_pct)) AS mean_abs_delta_pct FROM ov GROUP BY 1)
SELECT strftime(COALESCE(cr.day, od.day), '%Y-%m-%d') AS day, COALESCE(n_created, 0) AS n_created, COALESCE(n_overrides, 0) AS n_overrides,
       mean_abs_delta_pct FROM cr FULL JOIN od ON cr.day = od.day""", doubles=["mean_abs_delta_pct"])
def a31(spark, sf):
    """Override rate signals per day (batch form of ST3)."""
    lc = _lc(spark, sf)
    return W.daily_drift(W.overrides(lc), lc).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register("a32_reason_outcomes", oracle=WF + """,
lst AS (SELECT quote_id, arg_max(reason, rn) AS reason FROM ov GROUP BY quote_id),
fin AS (SELECT quote_id, outcome FROM acc WHERE event = 'outcome'),
sh AS (SELECT reason, count(*) AS n_overrides FROM ov GROUP BY reason),
wn AS (SELECT l.reason, count(f.outcome) AS n_closed, count(*) FILTER (WHERE f.outcome = 'won') AS n_won
       FROM lst l LEFT JOIN fin f USING (quote_id) GROUP BY l.reason)
SELECT sh.reason, sh.n_overrides, sh.n_overrides / (SELECT count(*) FROM ov) * 100 AS share_pct,
       COALESCE(wn.n_closed, 0) AS n_closed, COALESCE(wn.n_won, 0) AS n_won
FROM sh LEFT JOIN wn ON sh.reason = wn.reason""", doubles=["share_pct"])
def a32(spark, sf):
    return W.reason_outcomes(_lc(spark, sf))


def _errors_sql(source: str, rules: list[tuple[str, str]]) -> str:
    found = "list_filter([" + ", ".join(f"CASE WHEN {bad} THEN {_s(text)} END" for bad, text in rules) + "], lambda x: x IS NOT NULL)"
    return f"SELECT event_id, array_to_string({found}, '; ') AS errors, len({found}) = 0 AS is_valid FROM ({source})"


def _in(col: str, values: list[str]) -> str:
    return f"{col} IS NOT NULL AND {col} NOT IN ({', '.join(_s(v) for v in values)})"


def _nth_sql(values: list[str], n: int) -> str:
    return f"([{', '.join(_s(v) for v in values)}])[CAST(event_id % {n} AS INTEGER) + 1]"


_OVERRIDES = f"""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN -5.0 WHEN event_id % 13 = 0 THEN 2e7 ELSE human_price END AS human_price,
  CASE WHEN event_id % 17 = 0 THEN 'gut_feeling' ELSE reason END AS reason,
  CASE WHEN event_id % 19 = 0 THEN repeat('x', 1001) ELSE 'checked' END AS reason_text,
  CASE WHEN event_id % 23 = 0 THEN 'Mori-san' WHEN event_id % 5 <> 0 THEN {_nth_sql(S.VALID_ESTIMATORS, 3)} END AS estimator_id
  FROM wev WHERE event = 'override'"""
_OUTCOMES = f"""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'cancelled' ELSE outcome END AS outcome,
  CASE WHEN event_id % 11 = 0 THEN 'weather' WHEN outcome = 'lost' THEN {_nth_sql(S.LOSS_REASONS, 5)} END AS reason,
  CASE WHEN event_id % 13 = 0 THEN repeat('x', 1001) ELSE 'as agreed' END AS reason_text,
  CASE WHEN event_id % 17 = 0 THEN 0.0 WHEN event_id % 4 <> 0 THEN model_price END AS final_price,
  CASE WHEN event_id % 19 = 0 THEN repeat('P', 101) ELSE 'PO-1' END AS po_number
  FROM wev WHERE event = 'outcome'"""


@register("v14_override_validation", oracle=WF + _errors_sql(_OVERRIDES, [
    ("human_price IS NULL OR human_price <= 0 OR human_price > 10000000", "human_price: must be > 0 and <= 10000000"),
    (_in("reason", S.OVERRIDE_REASONS), "reason_category: unknown reason"),
    ("length(reason_text) > 1000", "reason_text: more than 1000 characters"),
    (_in("estimator_id", S.VALID_ESTIMATORS), "estimator_id: unknown estimator")]))
def v14(spark, sf):
    """V14 on requests with planted defects."""
    return W.override_request_errors(override_requests(load_workflow_events(spark, sf)))


@register("v15_outcome_validation", oracle=WF + _errors_sql(_OUTCOMES, [
    ("outcome IS NULL OR outcome NOT IN ('won', 'lost', 'expired')", "outcome: must be won, lost or expired"),
    (_in("reason", S.LOSS_REASONS), "reason: unknown reason"),
    ("length(reason_text) > 1000", "reason_text: more than 1000 characters"),
    ("final_price <= 0", "final_negotiated_price: must be > 0"),
    ("length(po_number) > 100", "po_number: more than 100 characters")]))
def v15(spark, sf):
    """V15 on requests with planted defects."""
    return W.outcome_request_errors(outcome_requests(load_workflow_events(spark, sf)))
