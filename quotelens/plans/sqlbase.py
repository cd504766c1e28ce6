"""DuckDB SQL for the oracle: the same quotes view, parse and enriched
table, written as CTE text. Each oracle query is ``WITH <ctes> SELECT``.

All numeric literals are cast to DOUBLE so products are evaluated in
binary floating point in the same order as the Spark expressions.
"""

from __future__ import annotations

from .. import schema as S
from ..sources import quotes as Q


def _d(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _s(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_s(v) if isinstance(v, str) or v is None else _d(v) for v in values) + "]"


def _pick(values, idx_sql: str) -> str:
    return f"({_list(values)})[CAST({idx_sql} AS INTEGER) + 1]"


def _case(mapping: dict, key_sql: str, default="NULL") -> str:
    whens = " ".join(f"WHEN {key_sql} = {_s(k)} THEN {_s(v) if isinstance(v, str) else _d(v)}"
                     for k, v in mapping.items())
    return f"CASE {whens} ELSE {default} END"


def quotes_cte() -> str:
    bn = "CAST(split_part(p_brand, '#', 2) AS INTEGER)"
    base = _pick(S.BASE_PART_TYPES, "p_partkey % 10")
    proc = (f"CASE WHEN p_type = 'ECONOMY' THEN (CASE WHEN p_size < 10 THEN NULL ELSE 'CNC Turning' END) "
            f"ELSE {_case(Q.PROCESS_BY_TYPE, 'p_type')} END")
    pa = f"""
    pa0 AS (
      SELECT p_partkey, p_brand, p_type, p_size, {bn} AS bn, {base} AS b,
             p_size % 11 AS mod_idx
      FROM part),
    pa1 AS (
      SELECT *,
        CASE WHEN p_partkey % 29 = 5 THEN {_s(Q.UNKNOWN_PART_TEXT)}
             WHEN p_partkey % 17 = 3 THEN left(b, length(b) - 2) || right(b, 1)
             ELSE b END AS base_text,
        {_pick(Q.MODIFIER_BY_SIZE, 'mod_idx')} AS modifier,
        CASE WHEN bn = {Q.MISSING_MATERIAL_BRAND} THEN NULL ELSE {_pick(Q.MATERIAL_BY_BRAND, 'bn % 5')} END AS material,
        {proc} AS process
      FROM pa0),
    pa AS (
      SELECT p_partkey,
        CASE WHEN modifier IS NULL THEN base_text ELSE base_text || ' - ' || modifier END AS part_description,
        material, process,
        CAST(COALESCE(CASE WHEN bn = {Q.MISSING_MATERIAL_BRAND} THEN NULL ELSE bn % 5 + 1 END, 3) AS DOUBLE) AS _mt,
        CAST(COALESCE({_case(S.PROCESS_PRECISION_TIER, 'process')}, 3) AS DOUBLE) AS _pt,
        CAST({_pick(Q.PLANTED_COMPLEXITY, 'mod_idx')} AS DOUBLE) AS _cx,
        CAST(p_partkey % 10 AS DOUBLE) AS _bk
      FROM pa1)"""
    q_idx = "((CAST(l_quantity AS INTEGER) - 1) % 6)"
    factors = [
        _d(100.0), _d(Q.PLANTED_BASE_PRICE),
        f"({_d(0.5)} + {_d(0.1)} * _bk)",
        f"({_d(0.6)} + {_d(0.2)} * _mt)",
        f"({_d(0.7)} + {_d(0.1)} * _pt)",
        f"({_d(1.0)} + {_d(0.15)} * _cx)",
        _pick(Q.PLANTED_QTY_FACTOR, q_idx),
        f"(CASE WHEN o_orderpriority = '1-URGENT' THEN {_d(Q.PLANTED_RUSH)} ELSE {_d(1.0)} END)",
        _pick(Q.PLANTED_ESTIMATOR_FACTOR, "l_suppkey % 3"),
        f"({_d(0.9)} + {_d(2.0)} * l_discount)",
    ]
    prod = factors[0]
    for f in factors[1:]:
        prod = f"({prod} * {f})"
    d = "date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))"
    return pa + f""",
    quotes AS (
      SELECT
        concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                  CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                  strftime(l_shipdate, '%Y%m%d')) AS quote_id,
        CAST(l_shipdate AS DATE) AS quote_date,
        part_description, material, process,
        CAST({_pick(Q.QUANTITY_BY_INDEX, q_idx)} AS INTEGER) AS quantity,
        CAST(2 + ((({d}) % 11 + 11) % 11) AS INTEGER) AS lead_time_weeks,
        (o_orderpriority = '1-URGENT') AS rush_job,
        {_pick(Q.ESTIMATOR_BY_SUPP, 'l_suppkey % 3')} AS estimator,
        CAST(floor({prod}) / {_d(100.0)} AS DOUBLE) AS total_price_usd,
        CAST(l_extendedprice AS DOUBLE) AS raw_price
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN pa ON l_partkey = p_partkey)"""


def lcs_sql(a: str, b: str) -> str:
    """LCS length of two non-empty strings, as DuckDB list lambdas."""
    row = (f"list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, greatest("
           f"prev[j + 1], acc[-1], CASE WHEN ch = substr({b}, j, 1) THEN prev[j] + 1 ELSE 0 END)), [0])")
    zeros = f"list_transform(range(0, length({b}) + 1), lambda j: 0)"
    return f"list_reduce(string_split({a}, ''), lambda prev, ch: {row}, {zeros})[length({b}) + 1]"


def ratio_sql(a: str, b: str) -> str:
    tot = f"CAST(length({a}) + length({b}) AS DOUBLE)"
    return (f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN {_d(0.0)} "
            f"WHEN {_d(200.0)} * CAST(least(length({a}), length({b})) AS DOUBLE) / {tot} < {_d(S.FUZZY_MATCH_THRESHOLD)} THEN {_d(0.0)} "
            f"ELSE ({_d(1.0)} - ({tot} - {_d(2.0)} * CAST({lcs_sql(a, b)} AS DOUBLE)) / {tot}) * {_d(100.0)} END)")


def parsed_cte(source: str = "quotes") -> str:
    bases = ", ".join(f"({i}, {_s(n)})" for i, n in enumerate(S.BASE_PART_TYPES))
    mods = ", ".join(f"({i}, {_s(t)}, {_s(f)}, {w})" for i, (t, f, w) in enumerate(S.MODIFIER_REGISTRY))
    thr = _d(S.FUZZY_MATCH_THRESHOLD)
    flag_cols = ",\n        ".join(f"max(CASE WHEN flag = {_s(f)} THEN 1 ELSE 0 END) AS {f}"
                                  for f in S.COMPLEXITY_FLAGS)
    flag_out = ",\n        ".join(f"CAST(COALESCE(mf.{f}, 0) AS INTEGER) AS {f}" for f in S.COMPLEXITY_FLAGS)
    return f"""
    base_reg AS (SELECT * FROM (VALUES {bases}) t(reg_pos, reg_name)),
    mod_reg AS (SELECT * FROM (VALUES {mods}) t(reg_pos, reg_name, flag, weight)),
    dsplit AS (
      SELECT description,
        trim(CASE WHEN position(' - ' IN description) > 0 THEN substr(description, 1, position(' - ' IN description) - 1) ELSE description END) AS base_raw,
        trim(CASE WHEN position(' - ' IN description) > 0 THEN substr(description, position(' - ' IN description) + 3) ELSE '' END) AS mod_raw
      FROM (SELECT DISTINCT part_description AS description FROM {source} WHERE part_description IS NOT NULL)),
    bscore AS (
      SELECT description, reg_pos, reg_name, base_raw = reg_name AS exact,
        CASE WHEN base_raw = reg_name THEN {_d(100.0)} ELSE {ratio_sql('base_raw', 'reg_name')} END AS score
      FROM dsplit CROSS JOIN base_reg),
    bbest AS (
      SELECT description, bool_or(exact) AS is_exact,
        arg_max(reg_name, (score, -reg_pos)) AS best_name, max(score) AS best_score
      FROM bscore GROUP BY description),
    pieces AS (
      SELECT description, pos AS piece_pos, trim(piece) AS piece
      FROM (SELECT description, unnest(string_split(mod_raw, ',')) AS piece,
                   generate_subscripts(string_split(mod_raw, ','), 1) AS pos
            FROM dsplit WHERE mod_raw <> '')),
    mscore AS (
      SELECT description, piece_pos, reg_pos, flag, weight,
        CASE WHEN piece = reg_name THEN {_d(100.0)} ELSE {ratio_sql('piece', 'reg_name')} END AS score
      FROM pieces CROSS JOIN mod_reg),
    mbest AS (
      SELECT description, piece_pos, max(score) AS score,
        arg_max(flag, (score, -reg_pos)) AS flag, arg_max(weight, (score, -reg_pos)) AS weight
      FROM mscore GROUP BY description, piece_pos),
    mflags AS (
      SELECT description,
        {flag_cols},
        CAST(sum(weight) AS INTEGER) AS complexity_score
      FROM mbest WHERE score >= {thr} GROUP BY description),
    parsed AS (
      SELECT b.description,
        CASE WHEN is_exact OR best_score >= {thr} THEN best_name ELSE {_s(S.UNKNOWN_PART)} END AS base_part_type,
        NOT is_exact AS fuzzy_matched,
        CASE WHEN is_exact THEN {_d(100.0)} WHEN best_score >= {thr} THEN best_score ELSE {_d(0.0)} END AS match_score,
        {flag_out},
        CAST(COALESCE(mf.complexity_score, 0) AS INTEGER) AS complexity_score
      FROM bbest b LEFT JOIN mflags mf ON b.description = mf.description)"""


def fold_sql(key: str = "quote_id", k: int = S.N_FOLDS) -> str:
    return f"CAST((('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8))::BIGINT) % {k} AS INTEGER)"


def hash_sql(key: str = "quote_id") -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8))::BIGINT)"


def enriched_cte() -> str:
    return quotes_cte() + "," + parsed_cte("quotes") + f""",
    eq AS (
      SELECT q.*, p.base_part_type, p.fuzzy_matched, p.match_score,
        {', '.join('p.' + f for f in S.COMPLEXITY_FLAGS)}, p.complexity_score,
        q.total_price_usd / q.quantity AS unit_price,
        {fold_sql('q.quote_id')} AS fold
      FROM quotes q LEFT JOIN parsed p ON q.part_description = p.description)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(c for c in ctes if c)


def m0_oof_cte() -> str:
    """M0 out-of-fold predictions in SQL (needs ``eq``)."""
    return f"""
    folds AS (SELECT CAST(range AS INTEGER) AS k FROM range({S.N_FOLDS + 1})),
    train AS (SELECT f.k, e.* FROM eq e JOIN folds f ON e.fold <> f.k),
    m0st AS (
      SELECT k, 'global' AS dim, '*' AS level, unit_price FROM train
      UNION ALL SELECT k, 'part', base_part_type, unit_price FROM train
      UNION ALL SELECT k, 'material', material, unit_price FROM train
      UNION ALL SELECT k, 'process', process, unit_price FROM train
      UNION ALL SELECT k, 'rush', CAST(rush_job AS VARCHAR), unit_price FROM train),
    m0med AS (SELECT k, dim, level, quantile_cont(unit_price, 0.5) AS med FROM m0st WHERE level IS NOT NULL GROUP BY k, dim, level),
    m0glob AS (SELECT k, med AS global_median FROM m0med WHERE dim = 'global'),
    m0rush AS (SELECT k, max(CASE WHEN level = 'true' THEN med END) / max(CASE WHEN level = 'false' THEN med END) AS rm
               FROM m0med WHERE dim = 'rush' GROUP BY k),
    m0slope AS (SELECT k, regr_slope(ln(unit_price), ln(CAST(quantity AS DOUBLE))) AS slope FROM train GROUP BY k),
    m0sc AS (SELECT g.k, g.global_median, COALESCE(s.slope, {_d(S.M0_DEFAULT_SLOPE)}) AS slope,
                    COALESCE(r.rm, {_d(S.M0_DEFAULT_RUSH)}) AS rush_multiplier
             FROM m0glob g LEFT JOIN m0slope s ON s.k = g.k LEFT JOIN m0rush r ON r.k = g.k),
    m0lv AS (SELECT m.k, m.dim, m.level, CASE WHEN m.dim = 'part' THEN m.med ELSE m.med / g.global_median END AS value
             FROM m0med m JOIN m0glob g ON g.k = m.k WHERE m.dim IN ('part', 'material', 'process')),
    oof AS (
      SELECT e.quote_id, e.fold, 'M0' AS model, e.total_price_usd AS actual,
        COALESCE(pm.value, sc.global_median) * COALESCE(mf.value, {_d(1.0)}) * COALESCE(pf.value, {_d(1.0)})
          * pow(CAST(e.quantity AS DOUBLE), {_d(1.0)} + sc.slope)
          * CASE WHEN e.rush_job THEN sc.rush_multiplier ELSE {_d(1.0)} END AS pred,
        e.material, e.part_description, e.base_part_type, e.quantity, e.estimator, e.rush_job, e.quote_date
      FROM eq e JOIN m0sc sc ON sc.k = e.fold
        LEFT JOIN m0lv pm ON pm.k = e.fold AND pm.dim = 'part' AND pm.level = e.base_part_type
        LEFT JOIN m0lv mf ON mf.k = e.fold AND mf.dim = 'material' AND mf.level = e.material
        LEFT JOIN m0lv pf ON pf.k = e.fold AND pf.dim = 'process' AND pf.level = e.process)"""


def fold_metrics_cte(src: str = "oof") -> str:
    return f"""
    fm AS (
      SELECT model, fold, avg(abs(actual - pred) / abs(actual)) * 100 AS MAPE,
        quantile_cont(abs(actual - pred) / abs(actual), 0.5) * 100 AS MedAPE,
        sqrt(avg((actual - pred) * (actual - pred))) AS RMSE,
        CASE WHEN var_pop(actual) * count(*) > 0
             THEN 1.0 - sum((actual - pred) * (actual - pred)) / (var_pop(actual) * count(*)) ELSE 0.0 END AS R2,
        count(*) AS n
      FROM {src} GROUP BY model, fold)"""


def dirty_cte() -> str:
    """The dirty view and the request rows (needs ``quotes``)."""
    from ..sources import quotes as Q
    h = hash_sql("quote_id")
    return f"""
    dq0 AS (SELECT *, {h} % {Q.DIRTY_MODULUS} AS _r FROM quotes),
    dq1 AS (
      SELECT quote_id, quote_date,
        CASE WHEN _r = 8 THEN part_description || {_s(Q.DIRTY_NON_ASCII_SUFFIX)} WHEN _r = 9 THEN '' ELSE part_description END AS part_description,
        CASE WHEN _r = 3 THEN 'Unobtanium' ELSE material END AS material,
        CASE WHEN _r = 4 THEN 'Laser' ELSE process END AS process,
        CASE WHEN _r = 2 THEN 7 ELSE quantity END AS quantity,
        CASE WHEN _r = 6 THEN 0 ELSE lead_time_weeks END AS lead_time_weeks,
        CASE WHEN _r = 1 THEN NULL ELSE rush_job END AS rush_job,
        CASE WHEN _r = 5 THEN 'Mori-san' ELSE estimator END AS estimator,
        CASE WHEN _r = 0 THEN {_d(-1.0)} ELSE total_price_usd END AS total_price_usd,
        _r
      FROM dq0),
    dirty AS (SELECT * EXCLUDE (_r) FROM dq1 UNION ALL SELECT * EXCLUDE (_r) FROM dq1 WHERE _r = 7),
    requests AS (
      SELECT DISTINCT quote_id AS request_id, part_description, material, process, quantity, rush_job, lead_time_weeks,
        CASE WHEN {h} % 20 = 0 THEN NULL ELSE estimator END AS estimator, quote_date
      FROM dirty)"""
