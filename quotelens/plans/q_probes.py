"""Queries: coherence and boundary probes of M0 with their SQL (L3, L6); the
same operators score every model in ``q_linear.py``."""

from __future__ import annotations

from .. import schema as S
from ..operators import probes as PB
from ..operators.enrich import materialized_quotes
from .q_models import OOF, m0_tables
from .registry import register
from .sqlbase import _d, _s

_MATERIAL, _PROCESS = _s(PB.PROBE["material"]), _s(PB.PROBE["process"])


def _value(v) -> str:
    return "NULL" if v is None else _s(v) if isinstance(v, str) else str(v)


def _template(rows) -> str:
    out = []
    for check, pos, varied in rows:
        p = {**PB.PROBE, **varied}
        part = p["part_description"].split(" - ")[0]
        out.append(f"({_s(check)}, {pos}, {_s(part)}, {_value(p['material'])}, {_value(p['process'])}, {p['quantity']}, {p['rush_job']})")
    return f"probe AS (SELECT * FROM (VALUES {', '.join(out)}) t(chk, pos, part, material, process, quantity, rush))"


#: M0's price of each row of ``probe`` by the fit on all rows.
PRICED = f"""
priced AS (
  SELECT p.*, COALESCE(pm.value, sc.global_median) * COALESCE(mf.value, {_d(1.0)}) * COALESCE(pf.value, {_d(1.0)})
      * pow(CAST(p.quantity AS DOUBLE), {_d(1.0)} + sc.slope) * CASE WHEN p.rush THEN sc.rush_multiplier ELSE {_d(1.0)} END AS pred
  FROM probe p JOIN m0sc sc ON sc.k = {S.N_FOLDS}
    LEFT JOIN m0lv pm ON pm.k = {S.N_FOLDS} AND pm.dim = 'part' AND pm.level = p.part
    LEFT JOIN m0lv mf ON mf.k = {S.N_FOLDS} AND mf.dim = 'material' AND mf.level = p.material
    LEFT JOIN m0lv pf ON pf.k = {S.N_FOLDS} AND pf.dim = 'process' AND pf.level = p.process),
measured AS (SELECT *, CASE WHEN chk IN ('quantity_discount', 'quantity') THEN pred / quantity ELSE pred END AS v FROM priced)"""
DETERMINISTIC = f"""
{_template(PB.DETERMINISTIC)},{PRICED},
det AS (
  SELECT chk, count(*) FILTER (CASE WHEN chk IN ('material_ordering', 'process_ordering', 'rush_premium') THEN prev >= v
      WHEN chk = 'quantity_discount' THEN prev < v ELSE v < prev END) AS violations
  FROM (SELECT *, lag(v) OVER (PARTITION BY chk ORDER BY pos) AS prev FROM measured) WHERE prev IS NOT NULL GROUP BY chk)"""
_PART = "split_part(part_description, ' - ', 1)"
_PAIRS = [("material", "part", _s(PB.MATERIALS_ORDERED[0]), "proc", "10", "false"), ("material", "part", _s(PB.MATERIALS_ORDERED[-1]), "proc", "10", "false"),
          ("rush", "part", "mat", "proc", "10", "false"), ("rush", "part", "mat", "proc", "10", "true"),
          ("quantity", "part", "mat", "proc", "1", "false"), ("quantity", "part", "mat", "proc", "100", "false"),
          ("process", "part", "mat", _s(PB.PROCESSES_ORDERED[0]), "10", "false"), ("process", "part", "mat", _s(PB.PROCESSES_ORDERED[-1]), "10", "false"),
          ("complexity", "part", "mat", "proc", "10", "false"), ("complexity", "part", "mat", "proc", "10", "false")]
STOCHASTIC = f"""
combo AS (SELECT base_part_type AS part, COALESCE(material, {_MATERIAL}) AS mat, COALESCE(process, {_PROCESS}) AS proc, count(*) AS quotes
          FROM eq GROUP BY ALL),
probe AS ({" UNION ALL ".join(f"SELECT '{c}' AS chk, {i % 2} AS pos, {p} AS part, {m} AS material, {r} AS process, {n} AS quantity, {u} AS rush, quotes, part || '|' || mat || '|' || proc AS id FROM combo" for i, (c, p, m, r, n, u) in enumerate(_PAIRS))}),{PRICED},
both_ AS (SELECT id, chk, any_value(quotes) AS quotes, max(v) FILTER (pos = 0) AS a, max(v) FILTER (pos = 1) AS b FROM measured GROUP BY id, chk),
sto AS (
  SELECT chk, CAST(sum(CASE WHEN CASE WHEN chk IN ('material', 'process', 'rush') THEN a >= b WHEN chk = 'quantity' THEN a < b ELSE b < a END
      THEN quotes ELSE 0 END) AS BIGINT) AS violations, CAST(sum(quotes) AS BIGINT) AS total_probes FROM both_ GROUP BY chk)"""


@register("l03_deterministic_m0", oracle=OOF + "," + DETERMINISTIC + """
SELECT 'M0' AS model, chk AS "check", violations, violations = 0 AS passed FROM det""")
def l03d0(spark, sf):
    """L3b for M0."""
    return PB.deterministic_probes(spark, m0_tables(spark, sf))


@register("l03_stochastic_m0", oracle=OOF + "," + STOCHASTIC + """
SELECT 'M0' AS model, chk AS "check", violations, total_probes, violations / total_probes * 100 AS violation_rate, violations = 0 AS passed
FROM sto""", doubles=["violation_rate"])
def l03s0(spark, sf):
    """L3c for M0 over every quote."""
    return PB.stochastic_probes(materialized_quotes(spark, sf), m0_tables(spark, sf))


_SECOND = STOCHASTIC.replace("probe AS", "probe2 AS").replace("FROM probe p", "FROM probe2 p").replace("priced AS", "priced2 AS") \
    .replace("FROM priced)", "FROM priced2)").replace("measured AS", "measured2 AS").replace("FROM measured GROUP", "FROM measured2 GROUP")


@register("l03_summary_m0", oracle=OOF + "," + DETERMINISTIC + "," + _SECOND + """,
u AS (SELECT violations FROM det UNION ALL SELECT violations FROM sto)
SELECT 'M0' AS model, count(*) FILTER (violations = 0) AS pass_count, count(*) AS total_count,
  count(*) FILTER (violations = 0) / count(*) * 100 AS pass_rate FROM u""", doubles=["pass_rate"])
def l03m0(spark, sf):
    """L3d for M0: pass count out of 10 checks and pass rate."""
    t = m0_tables(spark, sf)
    return PB.coherence_summary(PB.deterministic_probes(spark, t), PB.stochastic_probes(materialized_quotes(spark, sf), t))


_MODE = "CASE WHEN abs({0} - 1) < 0.05 THEN 'flat' WHEN {0} > {1} THEN 'explosive' ELSE 'normal' END"


@register("l06_boundary_m0", oracle=OOF + "," + _template(PB.BOUNDARY) + "," + PRICED + f""",
g AS (SELECT {", ".join(f"min(pred) FILTER (chk = '{c}') AS {c}" for c in ["q100", "q200", "q1000", "floor", "ceiling", "with_material", "without_material"])} FROM priced),
r AS (SELECT *, q200 / q100 AS r200, q1000 / q100 AS r1000 FROM g)
SELECT 'M0' AS model, r200 AS ratio_200, r200 > 1 AND r200 < 3 AS reasonable_200, {_MODE.format("r200", 3)} AS failure_mode_200,
  r1000 AS ratio_1000, r1000 > 1 AND r1000 < 15 AS reasonable_1000, {_MODE.format("r1000", 15)} AS failure_mode_1000,
  floor AS min_prediction, floor >= 50 AS floor_passed, ceiling AS max_prediction, ceiling <= 500000 AS ceiling_passed,
  abs(with_material - without_material) / with_material * 100 AS missing_degradation_pct, without_material IS NOT NULL AS handles_missing,
  CAST((r200 > 1 AND r200 < 3)::INT + (r1000 > 1 AND r1000 < 15)::INT + (floor >= 50)::INT + (ceiling <= 500000)::INT
    + (without_material IS NOT NULL)::INT AS INTEGER) AS pass_count
FROM r""", doubles=["ratio_200", "ratio_1000", "min_prediction", "max_prediction", "missing_degradation_pct"])
def l06m0(spark, sf):
    """L6 for M0."""
    return PB.boundary_probes(spark, m0_tables(spark, sf))
