"""The ``quotes`` view: one historical quote per line item.

The driver's tables are TPC-H shaped, so quotes are derived from
``lineitem JOIN orders JOIN part`` with pure column expressions (the
same expressions run in the DuckDB oracle). Per-part attributes are
computed on ``part`` before the join, so the wide string work happens
once per part, not once per line item.

At cluster scale this view is the one table every job reads; build it
once with :func:`materialize` (written under the checkpoint folder) and
let the downstream jobs read the written copy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.stage import cached_stage
from .tables import read_table

# ---- FIXED VALUES: how driver columns map onto the quote domain -----------
# p_size % 11 -> modifier text (9 = no modifier, 10 = two modifiers)
MODIFIER_BY_SIZE = [
    "thin walls",
    "complex internal channels",
    "high precision",
    "hardened",
    "threaded",
    "aerospace grade",
    "EMI shielded",
    "high fin density",
    "standard",
    None,
    "threaded, hardened",
]
# complexity used by the planted price, same index as MODIFIER_BY_SIZE
PLANTED_COMPLEXITY = [2, 3, 2, 1, 1, 1, 1, 2, 0, 0, 2]
# l_suppkey % 3 -> estimator, and the planted estimator factor
ESTIMATOR_BY_SUPP = ["Sato-san", "Suzuki-san", "Tanaka-san"]
PLANTED_ESTIMATOR_FACTOR = [0.93, 1.0, 1.09]
# (int(l_quantity) - 1) % 6 -> quantity, and the planted quantity factor
QUANTITY_BY_INDEX = [1, 5, 10, 20, 50, 100]
PLANTED_QTY_FACTOR = [1.0, 3.68, 6.46, 11.32, 23.78, 41.69]
# brand number % 5 -> material (brand 25 -> NULL)
MATERIAL_BY_BRAND = ["Aluminum 6061", "Aluminum 7075", "Stainless Steel 17-4 PH",
                     "Titanium Grade 5", "Inconel 718"]
MISSING_MATERIAL_BRAND = 25
# p_type -> process (ECONOMY with p_size < 10 -> NULL, else CNC Turning)
PROCESS_BY_TYPE = {
    "SMALL": "Surface Grinding",
    "STANDARD": "CNC Turning",
    "MEDIUM": "3-Axis Milling",
    "PROMO": "Wire EDM",
    "LARGE": "5-Axis Milling",
}
UNKNOWN_PART_TEXT = "Garden Gnome Stand"
PLANTED_BASE_PRICE = 220.0
PLANTED_RUSH = 1.55


def _pick(values: list, index: Column) -> Column:
    """Literal array lookup by a 0-based index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _case(pairs: dict, key: Column, default=None) -> Column:
    expr = None
    for k, v in pairs.items():
        expr = F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default))


def part_attributes(part: DataFrame) -> DataFrame:
    """Per-part quote attributes (description, material, process, tiers)."""
    bn = F.substring_index(F.col("p_brand"), "#", -1).cast("int")
    base = _pick(S.BASE_PART_TYPES, F.col("p_partkey") % 10)
    typo = F.concat(F.expr("substring(b, 1, length(b) - 2)"), F.expr("substring(b, length(b), 1)"))
    mod_idx = F.col("p_size") % 11
    mat_idx = bn % 5
    material = F.when(bn == MISSING_MATERIAL_BRAND, F.lit(None).cast("string")).otherwise(
        _pick(MATERIAL_BY_BRAND, mat_idx))
    process = (
        F.when(F.col("p_type") == "ECONOMY",
               F.when(F.col("p_size") < 10, F.lit(None).cast("string")).otherwise(F.lit("CNC Turning")))
        .otherwise(_case(PROCESS_BY_TYPE, F.col("p_type")))
    )
    return (
        part.select("p_partkey", "p_brand", "p_type", "p_size")
        .withColumn("b", base)
        .withColumn("_base_text",
                    F.when(F.col("p_partkey") % 29 == 5, F.lit(UNKNOWN_PART_TEXT))
                    .when(F.col("p_partkey") % 17 == 3, typo)
                    .otherwise(F.col("b")))
        .withColumn("_modifier", _pick(MODIFIER_BY_SIZE, mod_idx))
        .select(
            "p_partkey",
            F.when(F.col("_modifier").isNull(), F.col("_base_text"))
            .otherwise(F.concat(F.col("_base_text"), F.lit(" - "), F.col("_modifier")))
            .alias("part_description"),
            material.alias("material"),
            process.alias("process"),
            # planted-price inputs
            F.coalesce(F.when(bn == MISSING_MATERIAL_BRAND, F.lit(None)).otherwise(mat_idx + 1),
                       F.lit(3)).cast("double").alias("_mt"),
            F.coalesce(_case(S.PROCESS_PRECISION_TIER, process), F.lit(3)).cast("double").alias("_pt"),
            _pick(PLANTED_COMPLEXITY, mod_idx).cast("double").alias("_cx"),
            (F.col("p_partkey") % 10).cast("double").alias("_bk"),
        )
    )


def quotes_from_tables(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Map line items onto the historical-quote schema (see FIXTURES.md)."""
    return quotes_with_parts(lineitem, orders, part_attributes(part))


def quotes_with_parts(lineitem: DataFrame, orders: DataFrame, pa: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The quotes of line items whose parts' attributes are made already, with
    the attributes in ``keep``. What a table alone decides is computed before
    its join, so that narrow columns are shuffled: an order gives its day and
    whether it is urgent, and only the weeks between the days go on."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                         ((F.col("l_quantity").cast("int") - 1) % 6).alias("_q"), "l_extendedprice", "l_discount", "l_shipdate")
    o = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("_day"), (F.col("o_orderpriority") == "1-URGENT").alias("_rush"))
    d = F.datediff(F.col("l_shipdate").cast("date"), F.col("_day"))
    lines = li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "_q", "l_extendedprice", "l_discount",
        F.col("l_shipdate").cast("date").alias("l_shipdate"), (F.lit(2) + F.pmod(d, F.lit(11))).cast("int").alias("_weeks"), "_rush")
    j = lines.join(pa, lines.l_partkey == pa.p_partkey)
    q_idx = F.col("_q")
    rush = F.col("_rush")
    sup_idx = F.col("l_suppkey") % 3
    factors = [
        F.lit(100.0), F.lit(PLANTED_BASE_PRICE),
        F.lit(0.5) + F.lit(0.1) * F.col("_bk"),
        F.lit(0.6) + F.lit(0.2) * F.col("_mt"),
        F.lit(0.7) + F.lit(0.1) * F.col("_pt"),
        F.lit(1.0) + F.lit(0.15) * F.col("_cx"),
        _pick(PLANTED_QTY_FACTOR, q_idx),
        F.when(rush, F.lit(PLANTED_RUSH)).otherwise(F.lit(1.0)),
        _pick(PLANTED_ESTIMATOR_FACTOR, sup_idx),
        F.lit(0.9) + F.lit(2.0) * F.col("l_discount"),
    ]
    price = F.floor(reduce(lambda a, b: a * b, factors)) / F.lit(100.0)
    return j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    F.date_format(F.col("l_shipdate"), "yyyyMMdd")).alias("quote_id"),
        F.col("l_shipdate").cast("date").alias("quote_date"),
        "part_description",
        "material",
        "process",
        _pick(QUANTITY_BY_INDEX, q_idx).cast("int").alias("quantity"),
        F.col("_weeks").alias("lead_time_weeks"),
        rush.alias("rush_job"),
        _pick(ESTIMATOR_BY_SUPP, sup_idx).alias("estimator"),
        price.cast("double").alias("total_price_usd"),
        F.col("l_extendedprice").cast("double").alias("raw_price"),
        *keep,
    )


def load_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotes view over the driver tables in ``sf_dir``."""
    return quotes_from_tables(
        read_table(spark, sf_dir, "lineitem"),
        read_table(spark, sf_dir, "orders"),
        read_table(spark, sf_dir, "part"),
    )


# ---- FIXED VALUES: planted defects of the dirty view (h % 997) -------------
DIRTY_MODULUS = 997
DIRTY_NON_ASCII_SUFFIX = " ü"


def _h() -> Column:
    return F.conv(F.substring(F.md5(F.col("quote_id")), 1, 8), 16, 10).cast("bigint")


def dirty_quotes(quotes: DataFrame) -> DataFrame:
    """Deterministic defects for the quality rules: bad price, NULL rush,
    bad quantity, unknown material / process / estimator, lead time 0,
    duplicated rows, non-ASCII and blank descriptions."""
    r = F.pmod(_h(), F.lit(DIRTY_MODULUS))
    d = quotes.withColumn("_r", r).select(
        "quote_id", "quote_date",
        F.when(F.col("_r") == 8, F.concat(F.col("part_description"), F.lit(DIRTY_NON_ASCII_SUFFIX)))
        .when(F.col("_r") == 9, F.lit("")).otherwise(F.col("part_description")).alias("part_description"),
        F.when(F.col("_r") == 3, F.lit("Unobtanium")).otherwise(F.col("material")).alias("material"),
        F.when(F.col("_r") == 4, F.lit("Laser")).otherwise(F.col("process")).alias("process"),
        F.when(F.col("_r") == 2, F.lit(7)).otherwise(F.col("quantity")).alias("quantity"),
        F.when(F.col("_r") == 6, F.lit(0)).otherwise(F.col("lead_time_weeks")).alias("lead_time_weeks"),
        F.when(F.col("_r") == 1, F.lit(None).cast("boolean")).otherwise(F.col("rush_job")).alias("rush_job"),
        F.when(F.col("_r") == 5, F.lit("Mori-san")).otherwise(F.col("estimator")).alias("estimator"),
        F.when(F.col("_r") == 0, F.lit(-1.0)).otherwise(F.col("total_price_usd")).alias("total_price_usd"),
        "_r")
    copies = F.when(F.col("_r") == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.withColumn("_copy", F.explode(copies)).drop("_r", "_copy")


def load_dirty_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty view, written once and shared by the quality queries."""
    return cached_stage(spark, "dirty_quotes", sf_dir, lambda: dirty_quotes(load_quotes(spark, sf_dir)))


def quote_requests(dirty: DataFrame) -> DataFrame:
    """Quote requests (Q1, V12, V13, ST1): every quote, price dropped,
    estimator absent for every twentieth."""
    h = _h()
    return dirty.select(
        F.col("quote_id").alias("request_id"), "part_description", "material", "process", "quantity",
        "rush_job", "lead_time_weeks",
        F.when(F.pmod(h, F.lit(20)) == 0, F.lit(None).cast("string")).otherwise(F.col("estimator")).alias("estimator"),
        "quote_date").dropDuplicates(["request_id"])
