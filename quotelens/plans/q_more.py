"""Queries: refit stability, propensity, rolling alarms, bias against the
debiased model, attribution, design columns, stored result tables, and the
scorecard with SQL on the stand-in models (A26, M16-M18, W7, T4, T9, M20, M21,
P13, P15, P18, S3, S4, L8, L9, L11, A30, T7, M15)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.features import feature_columns, feature_names, label_code
from ..operators import alarms as AL
from ..operators import attribution as AT
from ..operators import bias as B
from ..operators import evaluate as EV
from ..operators import importance as IM
from ..operators import lenses as L
from ..operators import linear as LN
from ..operators import models as M
from ..operators import propensity as PP
from ..operators import stability as ST
from ..operators import trees as TR
from ..operators.align import align
from ..operators.enrich import materialized_quotes
from ..operators.stage import cached_stage
from ..operators.workflow import overrides
from ..session import ensure_checkpoint_dir
from ..sources.csv_scan import write_table
from . import q_checked as QC
from .q_linear import FOLDS, WHOLE, _scored, linear_table, tree_table
from .q_models import FM, OOF, m0_fold_metrics, m0_oof_table
from .q_predict import _BIAS, _bias_rows
from .q_requests import requests_table
from .q_workflow import WF, _lc
from .registry import register
from .sqlbase import _d, _s, dirty_cte, enriched_cte, with_ctes


# ------------------------------------------------------------- A26, M16 ----
@register("a26_refit_stability")
def a26(spark, sf):
    """Coefficient of variation over 20 resampled refits."""
    return ST.refit_stability(materialized_quotes(spark, sf), LN.load_fits(linear_table(spark, sf).where(F.col("fold") == M.ALL)))


def _codes_sql(col: str) -> str:
    cases = " ".join(f"WHEN {_s(v)} THEN {i}" for i, v in enumerate(S.LABEL_CATEGORIES[col]))
    return f"CAST(CASE WHEN {col} IS NULL THEN {len(S.LABEL_CATEGORIES[col])} ELSE CASE {col} {cases} ELSE -1 END END AS DOUBLE)"


@register("m18_stratified_folds", oracle=with_ctes(enriched_cte()) + f"""
SELECT quote_id, {_codes_sql('estimator')} AS label, {_codes_sql('material')} AS material, {_codes_sql('process')} AS process,
  {_codes_sql('base_part_type')} AS base_part_type,
  CAST((row_number() OVER (PARTITION BY estimator ORDER BY quote_id) - 1) % 5 AS INTEGER) AS fold FROM eq""",
          doubles=["label", "material", "process", "base_part_type"])
def m18(spark, sf):
    """M18 + the stratified folds of M16 for every quote."""
    return PP.stratified_folds(PP.coded(materialized_quotes(spark, sf)), "label", "quote_id") \
        .select("quote_id", "label", "material", "process", "base_part_type", "fold")


@register("m16_propensity")
def m16(spark, sf):
    """Accuracy, baseline and flag."""
    return PP.verdict(PP.propensity(materialized_quotes(spark, sf)))


# ------------------------------------------------------------------ W7 ----
@register("w07_rolling_mean", oracle=WF + """
SELECT event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time, delta_pct, count(*) OVER w AS n_24h, avg(delta_pct) OVER w AS mean_24h
FROM ov WINDOW w AS (ORDER BY event_time RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)""",
          doubles=["delta_pct", "mean_24h"])
def w07(spark, sf):
    """Mean delta % over the last 24 hours at every override."""
    r = AL.rolling_mean(overrides(_lc(spark, sf)), "delta_pct")
    return r.withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


# --------------------------------------------------------------- T9, M17 ----
@register("t09_bias_report", oracle=_BIAS + """
SELECT row_number() OVER (ORDER BY avg(pct_bias) DESC, estimator) AS place, estimator, avg(pct_bias) AS mean_pct_bias,
  stddev_pop(pct_bias) AS std_pct_bias, count(*) AS n_quotes, quantile_cont(pct_bias, 0.5) AS median_pct_bias FROM br GROUP BY estimator""",
          doubles=["mean_pct_bias", "std_pct_bias", "median_pct_bias"])
def t09(spark, sf):
    """The bias summary by mean bias, largest first."""
    return B.ordered(B.bias_summary(_bias_rows(spark, sf)))


@register("m17_debiased_bias")
def m17(spark, sf):
    """Bias against the out-of-fold price of M9, with interval and label."""
    wide = _scored(spark, sf, {"trees": tree_table(spark, sf, FOLDS, ["M9"])}, ["M9"])
    rows = cached_stage(spark, "bias_m9", sf, lambda: B.bias_rows(
        wide.withColumn("model", F.lit("M9")).withColumn("pred", F.col("preds.M9")), "M9"))
    return B.ordered(B.bias_labels(B.bias_summary(rows), B.bootstrap_ci(rows)))


# ------------------------------------------------------------------ M20 ----
@register("m20_tree_attribution")
def m20(spark, sf):
    """The five largest contributions to each quote's M7 log price."""
    forests = TR.load_forests(tree_table(spark, sf, WHOLE, ["M7"]))
    rows = AT.tree_attribution(materialized_quotes(spark, sf).select("quote_id", TR.cell_key().alias("_key")), forests, "M7", M.ALL)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    return rows.select("quote_id", "base", (F.col("base") + total).alias("value"), F.to_json(F.transform(
        AT.top_features(F.col("contributions"), TR.FEATURES, 5), lambda x: F.struct(
            x["feature"].alias("feature"), F.round(x["contribution"], 4).alias("contribution")))).alias("top"))


@register("m20_linear_attribution")
def m20lin(spark, sf):
    """The five largest contributions to each quote's M2 log price."""
    q = materialized_quotes(spark, sf)
    fit = next(f for f in LN.load_fits(linear_table(spark, sf).where((F.col("fold") == M.ALL) & (F.col("model") == "M2"))))
    d, _ = LN.design(q)
    names = {LN._safe(c): (c, float(b)) for c, b in zip(fit["x"], fit["coef"])}
    means = d.agg(*[F.avg(c).alias(c) for c in names]).first()
    rows = AT.linear_attribution(d, {c: b for c, (_, b) in names.items()}, {c: means[c] for c in names}, fit["intercept"])
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    return rows.select("quote_id", "base", (F.col("base") + total).alias("value"), F.to_json(F.transform(
        AT.top_features(F.col("contributions"), [n for n, _ in names.values()], 5), lambda x: F.struct(
            x["feature"].alias("feature"), F.round(x["contribution"], 4).alias("contribution")))).alias("top"))


#: Stand-in coefficients of four features, for the SQL of the linear attribution.
STAND_IN = {"quantity": 0.75, "lead_time_weeks": -12.5, "complexity_score": 40.25, "rush": 130.0}


@register("m20_linear_attribution_checked", oracle=with_ctes(enriched_cte()) + f""",
x AS (SELECT quote_id, CAST(quantity AS DOUBLE) AS quantity, CAST(lead_time_weeks AS DOUBLE) AS lead_time_weeks,
        CAST(complexity_score AS DOUBLE) AS complexity_score, CAST(rush_job::INT AS DOUBLE) AS rush FROM eq),
m AS (SELECT {", ".join(f"avg({c}) AS m_{c}" for c in STAND_IN)} FROM x),
c AS (SELECT quote_id, feature, contribution FROM (SELECT quote_id, unnest([{", ".join(f"{{'feature': '{c}', 'contribution': ({c} - m_{c}) * {_d(b)}}}" for c, b in STAND_IN.items())}], recursive := true) FROM x CROSS JOIN m))
SELECT quote_id, row_number() OVER (PARTITION BY quote_id ORDER BY round(abs(contribution), 6) DESC, feature) AS place, feature, contribution
FROM c QUALIFY place <= 2""", doubles=["contribution"])
def m20c(spark, sf):
    """M20 (linear half) and T4 with stand-in coefficients: two features a quote."""
    q = materialized_quotes(spark, sf).select("quote_id", *[F.col(c).cast("double") for c in list(STAND_IN)[:3]],
                                              F.col("rush_job").cast("int").cast("double").alias("rush"))
    means = q.agg(*[F.avg(c).alias(c) for c in STAND_IN]).first().asDict()
    rows = AT.linear_attribution(q, STAND_IN, means, 0.0)
    top = AT.top_features(F.col("contributions"), list(STAND_IN), 2)
    return rows.select("quote_id", F.posexplode(top).alias("i", "x")) \
        .select("quote_id", (F.col("i") + 1).cast("long").alias("place"), "x.feature", "x.contribution")


@register("m21_permutation_importance")
def m21(spark, sf):
    """How much worse M7 prices when one feature is shuffled."""
    forests = TR.load_forests(tree_table(spark, sf, WHOLE, ["M7"]))
    return IM.permutation_importance(materialized_quotes(spark, sf), forests, "M7")


# ------------------------------------------------------- P13, P15, P18 ----
_LABEL_COLS = ["base_part_type", "material", "process", "estimator"]


def _label_sql(col: str) -> str:
    cases = " ".join(f"WHEN {_s(v)} THEN {i}" for i, v in enumerate(S.LABEL_CATEGORIES[col]))
    return f"CASE {col} {cases} ELSE -1 END"


@register("p13_label_codes", oracle=with_ctes(enriched_cte(), dirty_cte()) + ", u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS level, {_label_sql(c)} AS code FROM requests" for c in _LABEL_COLS if c != "base_part_type") + """)
SELECT feature, level, CAST(code AS DOUBLE) AS code, count(*) AS n FROM u GROUP BY ALL""", doubles=["code"])
def p13(spark, sf):
    """Label codes of every request, unseen and missing ones too."""
    r = requests_table(spark, sf)
    cols = [c for c in _LABEL_COLS if c != "base_part_type"]
    return r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("level"),
                                                 label_code(c, S.LABEL_CATEGORIES[c]).alias("code")) for c in cols])).alias("x")) \
        .groupBy("x.feature", "x.level", "x.code").agg(F.count(F.lit(1)).alias("n"))


def _totals(x, names):
    one = x.agg(*[F.sum(F.col(f"`{c}`").cast("double")).alias(f"t{i}") for i, c in enumerate(names)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"t{i}").alias("total")) for i, c in enumerate(names)]))
                      .alias("x")).select("x.*")


def _numeric_sql() -> dict[str, str]:
    tier = lambda c, t: f"CASE {c} " + " ".join(f"WHEN {_s(k)} THEN {_d(v)}" for k, v in t.items()) + f" ELSE {_d(S.DEFAULT_TIER)} END"
    return {"log_quantity": "ln(CAST(quantity AS DOUBLE))", "rush_job": "rush_job::INT", "lead_time_weeks": "lead_time_weeks",
            "missing_material": "(material IS NULL)::INT", "missing_process": "(process IS NULL)::INT",
            "material_cost_tier": tier("material", S.MATERIAL_COST_TIER), "process_precision_tier": tier("process", S.PROCESS_PRECISION_TIER),
            **{f: f for f in S.COMPLEXITY_FLAGS}, "complexity_score": "complexity_score"}


def _totals_sql(cols: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {_s(n)} AS feature, sum(CAST({e} AS DOUBLE)) AS total FROM eq" for n, e in cols.items())


_ONEHOT = {f"{c}_{v}": f"COALESCE(({c} = {_s(v)})::INT, 0)" for c in ["base_part_type", "material", "process"] for v in S.LABEL_CATEGORIES[c]}


@register("p15_design_without_estimator", oracle=with_ctes(enriched_cte()) + "\n" + _totals_sql(_numeric_sql() | _ONEHOT), doubles=["total"])
def p15(spark, sf):
    """Column totals of the one-hot matrix without the estimator."""
    names = feature_names("onehot", False)
    return _totals(materialized_quotes(spark, sf).select(*feature_columns("onehot", False)), names)


@register("p18_aligned_columns", oracle=with_ctes(enriched_cte()) + "\n" + _totals_sql(
    _numeric_sql() | {c: _label_sql(c) for c in ["base_part_type", "material", "process"]} | {"estimator": "-1"}), doubles=["total"])
def p18(spark, sf):
    """A matrix that lacks the estimator, aligned to the training columns."""
    x = materialized_quotes(spark, sf).select(*reversed(feature_columns("label", False)))
    return _totals(align(x, feature_names("label", True), -1.0), feature_names("label", True))


# --------------------------------------------------------------- S3, S4 ----
def _reports(spark, sf):
    folds = QC.checked_folds(spark, sf)
    return {"cv_summary": ("csv", EV.cv_summary(folds)), "fold_results": ("csv", folds), "comparison": ("csv", EV.comparison_table(folds)),
            "permutation": ("csv", EV.permutation_test(folds)), "wilcoxon": ("csv", EV.wilcoxon_test(folds)),
            "hypotheses": ("csv", EV.resolve_hypotheses(EV.comparison_table(folds), EV.permutation_test(folds))),
            "bias": ("json", B.bias_summary(_bias_rows(spark, sf))), "bands": ("json", QC.checked_band(spark, sf)),
            "error_profile": ("json", L.error_profile(m0_oof_table(spark, sf)))}


_M = len(QC.MODELS)
_HYP = sum(a in QC.MODELS and b in QC.MODELS for a, b, _ in EV.HYPOTHESES)


@register("s03_report_tables", oracle=with_ctes(enriched_cte()) + f""",
e AS (SELECT count(DISTINCT estimator) AS n FROM eq)
SELECT * FROM (VALUES ('cv_summary', 'csv', {_M}), ('fold_results', 'csv', {5 * _M}), ('comparison', 'csv', {_M}), ('permutation', 'csv', {_M * (_M - 1) // 2}),
  ('wilcoxon', 'csv', {_M * (_M - 1) // 2}), ('hypotheses', 'csv', {_HYP}), ('bands', 'json', 1), ('error_profile', 'json', 1)) t(report, format, n_rows)
  CROSS JOIN (SELECT 0 AS n_different)
UNION ALL SELECT 'bias', 'json', n, 0 FROM e""")
def s03(spark, sf):
    """Result tables written as CSV or JSON and read back: rows, and
    rows that differ after the round trip (numbers to nine digits)."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quotelens-reports/{uuid.uuid4().hex[:10]}"
    out = None
    for name, (fmt, df) in _reports(spark, sf).items():
        write_table(df.coalesce(1), f"{root}/{name}", fmt)
        reader = spark.read.schema(df.schema)
        back = reader.option("header", True).csv(f"{root}/{name}") if fmt == "csv" else reader.json(f"{root}/{name}")
        flat = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
        both = df.select(*flat, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
            back.select(*flat, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
        g = both.groupBy(df.columns).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
        one = g.agg(F.sum("b").cast("int").alias("n_rows"), F.sum(F.abs(F.col("a") - F.col("b"))).cast("int").alias("n_different")) \
            .select(F.lit(name).alias("report"), F.lit(fmt).alias("format"), "n_rows", "n_different")
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------- stand-ins: scorecard, A30, M15 ----
#: Given results of the lenses that refit or probe, a row a stand-in model: checks passed of ten, boundary tests passed.
GIVEN = {m: (10 - (3 * i) % 4, (2 * i + 3) % 6) for i, m in enumerate(QC.MODELS)}
_GIVEN_SQL = ", ".join(f"('{m}', {a}, {b}, {L.RATING_RANK[L.INTERPRETABILITY[m][0]]})" for m, (a, b) in GIVEN.items())


def _given(spark):
    return spark.createDataFrame([(m, a, 10, 10.0 * a, b) for m, (a, b) in GIVEN.items()],
                                 "model string, pass_count int, total_count int, pass_rate double, boundary int")


def _segments(spark, sf):
    return cached_stage(spark, "checked_segments", sf, lambda: L.segment_fairness(QC.preds_long(spark, sf)))


_CUTS = """
cuts AS (SELECT quantile_cont(actual, 0.25) AS q1, quantile_cont(actual, 0.5) AS q2, quantile_cont(actual, 0.75) AS q3 FROM oof),
pr AS (SELECT *, abs(actual - pred) / actual * 100 AS ape, (pred - actual) / actual * 100 AS sp FROM preds CROSS JOIN cuts),
st AS (
  SELECT model, 'by_price_quartile' AS segment, CASE WHEN actual <= q1 THEN 'Q1 (cheapest)' WHEN actual <= q2 THEN 'Q2' WHEN actual <= q3 THEN 'Q3' ELSE 'Q4 (priciest)' END AS category, ape FROM pr
  UNION ALL SELECT model, 'by_material', COALESCE(material, 'Missing'), ape FROM pr
  UNION ALL SELECT model, 'by_part_type', split_part(part_description, ' - ', 1), ape FROM pr
  UNION ALL SELECT model, 'by_quantity_band', CASE WHEN quantity > 0 AND quantity <= 1 THEN 'qty=1' WHEN quantity > 1 AND quantity <= 10 THEN 'qty=5-10' WHEN quantity > 10 AND quantity <= 50 THEN 'qty=20-50' WHEN quantity > 50 AND quantity <= 100 THEN 'qty=100' END, ape FROM pr
  UNION ALL SELECT model, 'by_estimator', estimator, ape FROM pr),
seg AS (SELECT model, segment, category, avg(ape) AS mape, count(*) AS n FROM st WHERE category IS NOT NULL GROUP BY ALL)"""
LENS_SQL = QC.PREDS + "," + QC._PAIRS.split(",\nd AS")[0] + "," + _CUTS


@register("t07_worst_segment_checked", oracle=LENS_SQL + """
SELECT model, segment, category, mape AS worst_segment_mape, n FROM seg WHERE n >= 10
QUALIFY row_number() OVER (PARTITION BY model ORDER BY mape DESC, segment DESC, category DESC) = 1""", doubles=["worst_segment_mape"])
def t07c(spark, sf):
    """T7 on the stand-in models."""
    return L.worst_segment(_segments(spark, sf))


@register("a30_acceptance_checked", oracle=LENS_SQL + """,
ep AS (SELECT model, quantile_cont(ape, 0.9) / quantile_cont(ape, 0.5) AS tail_ratio, skewness(sp) AS skew, avg(ape) AS mape FROM pr GROUP BY model),
w AS (SELECT model, max(mape) AS worst FROM seg WHERE n >= 20 GROUP BY model),
qs AS (SELECT model, CASE WHEN actual <= q1 THEN 1 WHEN actual <= q2 THEN 2 WHEN actual <= q3 THEN 3 ELSE 4 END AS q, sign(avg(sp)) AS s FROM pr GROUP BY ALL),
fl AS (SELECT model, count(*) FILTER (s * b < 0) AS sign_flips FROM (SELECT *, lag(s) OVER (PARTITION BY model ORDER BY q) AS b FROM qs) GROUP BY model),
sb AS (SELECT model, stddev_pop(MAPE) / avg(MAPE) AS fold_spread FROM fm GROUP BY model)
SELECT model, tail_ratio, tail_ratio < 3 AS light_tail, skew, skew BETWEEN -1 AND 1 AS symmetric, worst / mape AS segment_ratio, worst / mape < 2 AS fair,
  sign_flips, sign_flips <= 1 AS consistent, fold_spread, fold_spread < 0.3 AS stable,
  tail_ratio < 3 AND skew BETWEEN -1 AND 1 AND worst / mape < 2 AND sign_flips <= 1 AND fold_spread < 0.3 AS accepted
FROM ep JOIN w USING (model) JOIN fl USING (model) JOIN sb USING (model)""", doubles=["tail_ratio", "skew", "segment_ratio", "fold_spread"])
def a30c(spark, sf):
    """A30 on the stand-in models."""
    p = QC.preds_long(spark, sf)
    return L.acceptance(L.error_profile(p), _segments(spark, sf), L.calibration_by_quartile(p), L.fold_stability(QC.checked_folds(spark, sf)))


def _rank_sql(order: str) -> str:
    return f"greatest(1, least(5, 5 - CAST(floor((row_number() OVER (ORDER BY {order}, model) - 1) / (count(*) OVER ()) * 5) AS INTEGER)))"


_DOTS = "repeat('●', {0}) || repeat('○', 5 - {0})"
_NAMED = {x: x.replace("_", " ") for x in L.LENSES}
SCORE_SQL = LENS_SQL + f""",
given AS (SELECT * FROM (VALUES {_GIVEN_SQL}) t(model, passed, boundary, readable)),
base AS (
  SELECT model, avg(ape) AS mape, avg(sp) AS off FROM pr GROUP BY model),
lens AS (
  SELECT b.model, b.mape, b.off, (SELECT max(mape) FROM seg s WHERE s.model = b.model AND n >= 10) AS worst,
    (SELECT stddev_pop(MAPE) FROM fm f WHERE f.model = b.model) AS fold_std, g.passed, g.boundary, g.readable
  FROM base b JOIN given g USING (model)),
rk AS (
  SELECT model, mape, off, passed, fold_std, {_rank_sql('mape')} AS error_profile, {_rank_sql('worst')} AS segment_fairness,
    greatest(1, least(5, CAST(round_even(passed * 10 / 20, 0) AS INTEGER))) AS economic_coherence, {_rank_sql('abs(off)')} AS calibration,
    {_rank_sql('fold_std')} AS stability, {_rank_sql('boundary DESC')} AS boundary_behavior, readable AS interpretability FROM lens),
fit AS (SELECT *, mape < 14 AND passed = 10 AS qualifies, CASE WHEN model IN ('M1', 'M2', 'M3a', 'M3b', 'M4') THEN 'linear' WHEN model = 'M0' THEN 'lookup' ELSE 'tree' END AS family FROM rk)
SELECT model, mape, {", ".join(f"{x} AS rank_{x}" for x in L.LENSES)}, {", ".join(f"{_DOTS.format(x)} AS dots_{x}" for x in L.LENSES)},
  round_even(({" + ".join(L.LENSES)}) / 7, 2) AS average_rank,
  concat_ws(' ', model || ':', printf('%.1f%% MAPE, %s.', round_even(mape, 1), CASE WHEN off > 3 THEN 'conservative' WHEN off < -3 THEN 'aggressive' ELSE 'balanced' END),
    CASE WHEN passed < 10 THEN (10 - passed) || ' economic coherence violation(s).' END, printf('Fold stability: ±%.1f%%.', round_even(fold_std, 1)),
    'Strong on: ' || nullif(array_to_string(list_filter([{", ".join(f"CASE WHEN {x} >= 4 THEN '{n}' END" for x, n in _NAMED.items())}], lambda t: t IS NOT NULL), ', '), '') || '.',
    'Weak on: ' || nullif(array_to_string(list_filter([{", ".join(f"CASE WHEN {x} <= 2 THEN '{n}' END" for x, n in _NAMED.items())}], lambda t: t IS NOT NULL), ', '), '') || '.') AS narrative,
  qualifies, family, qualifies AND family <> 'lookup' AND (SELECT count(DISTINCT family) FROM fit WHERE qualifies AND family <> 'lookup') = 2 AS production_eligible
FROM fit"""


@register("l08_scorecard_checked", oracle=SCORE_SQL, doubles=["mape", "average_rank"])
def l08c(spark, sf):
    """T2, L8, L9, L11 on the stand-in models, with given coherence and
    boundary results."""
    p, g = QC.preds_long(spark, sf), _given(spark)
    none = spark.createDataFrame([], "model string, effective_params long")
    return L.scorecard(L.error_profile(p), L.worst_segment(_segments(spark, sf)), g.drop("boundary"), L.calibration(p),
                       L.fold_stability(QC.checked_folds(spark, sf)), g.select("model", F.col("boundary").alias("pass_count")),
                       L.complexity(g, none))


#: Stand-in fold metrics of all fourteen models: M0's, moved by a few per cent.
def _moved(i: int) -> str:
    return f"(1 + 0.01 * ((fold * {2 * i + 3} + {i}) % 11 - 5 - {i % 3}))"


_FM14 = FM + ", fm14 AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, fold, MAPE * {_moved(i)} AS MAPE FROM fm" for i, m in enumerate(S.MODEL_NAMES)) + ")"


@register("m15_hypotheses_checked", oracle=_FM14 + f""",
h AS (SELECT * FROM (VALUES {", ".join(f"({_s(a)}, {_s(b)}, {_s(q)})" for a, b, q in EV.HYPOTHESES)}) t(model_a, model_b, hypothesis)),
mean AS (SELECT model, avg(MAPE) AS mape FROM fm14 GROUP BY model),
d AS (SELECT h.model_a, h.model_b, a.fold, a.MAPE - b.MAPE AS d, row_number() OVER (PARTITION BY h.model_a, h.model_b ORDER BY a.fold) - 1 AS i
      FROM h JOIN fm14 a ON a.model = h.model_a JOIN fm14 b ON b.model = h.model_b AND a.fold = b.fold),
s AS (SELECT model_a, model_b, avg(d) AS diff FROM d GROUP BY ALL),
m AS (SELECT model_a, model_b, mask, avg(CASE WHEN (mask >> i) & 1 = 1 THEN d ELSE -d END) AS pm FROM d CROSS JOIN (SELECT unnest(range(0, 32)) AS mask) GROUP BY ALL),
p AS (SELECT model_a, model_b, avg((abs(pm) >= abs(diff) - 1e-12)::INT) AS p FROM m JOIN s USING (model_a, model_b) GROUP BY ALL)
SELECT hypothesis, model_a, model_b, x.mape AS mape_a, y.mape AS mape_b, CASE WHEN x.mape < y.mape THEN model_a ELSE model_b END AS winner,
  p AS p_value, p < 0.05 AS significant
FROM h JOIN mean x ON x.model = model_a JOIN mean y ON y.model = model_b JOIN p USING (model_a, model_b)""", doubles=["mape_a", "mape_b", "p_value"])
def m15c(spark, sf):
    """M15 + J9: all eleven hypotheses on stand-in fold metrics."""
    fm = m0_fold_metrics(spark, sf)
    moved = F.array(*[F.struct(F.lit(m).alias("m"), F.expr(f"MAPE * {_moved(i)}").cast("double").alias("v")) for i, m in enumerate(S.MODEL_NAMES)])
    fm14 = fm.select("fold", F.explode(moved).alias("x"), "MedAPE", "RMSE", "R2", "n") \
        .select(F.col("x.m").alias("model"), "fold", F.col("x.v").alias("MAPE"), "MedAPE", "RMSE", "R2", "n")
    return EV.resolve_hypotheses(EV.comparison_table(fm14), EV.permutation_test(fm14))
