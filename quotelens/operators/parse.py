"""Part-description parser as a similarity join.

``"<base> - <modifier>[, <modifier>]"``: the text before the first
``" - "`` is matched to the base registry (exact, else best indel ratio
>= 85 with ties going to registry order, else UNKNOWN); each comma
separated modifier is matched the same way against the modifier
registry and unknown modifiers are ignored. A repeated modifier adds
its weight again.

The parse runs on DISTINCT descriptions only: a partial aggregate
collapses hot descriptions before the shuffle, and the registries are
fixed-size literal tables (10 and 9 rows) that are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.fuzzy import indel_ratio, ratio_upper_bound

SEP = " - "
#: What a parse gives, in order.
PARSED = ("base_part_type", "fuzzy_matched", "match_score", *S.COMPLEXITY_FLAGS, "complexity_score")


def _registries(spark: SparkSession):
    bases = spark.createDataFrame([(i, n) for i, n in enumerate(S.BASE_PART_TYPES)],
                                  "reg_pos int, reg_name string")
    mods = spark.createDataFrame([(i, t, f, w) for i, (t, f, w) in enumerate(S.MODIFIER_REGISTRY)],
                                 "reg_pos int, reg_name string, flag string, weight int")
    return F.broadcast(bases), F.broadcast(mods)


def _score(raw: str) -> F.Column:
    exact = F.col(raw) == F.col("reg_name")
    return (F.when(exact, F.lit(100.0))
            .when(ratio_upper_bound(F.col(raw), F.col("reg_name")) < S.FUZZY_MATCH_THRESHOLD, F.lit(0.0))
            .otherwise(indel_ratio(F.col(raw), F.col("reg_name"))))


def split_description(col: str = "part_description") -> list:
    """Split at the first separator only, both sides trimmed."""
    pos = F.locate(SEP, F.col(col))
    base_raw = F.trim(F.when(pos > 0, F.expr(f"substring(`{col}`, 1, locate('{SEP}', `{col}`) - 1)"))
                      .otherwise(F.col(col)))
    mod_raw = F.trim(F.when(pos > 0, F.expr(f"substring(`{col}`, locate('{SEP}', `{col}`) + {len(SEP)})"))
                     .otherwise(F.lit("")))
    return [base_raw.alias("base_raw"), mod_raw.alias("mod_raw")]


def parse_distinct(descriptions: DataFrame, col: str = "part_description") -> DataFrame:
    """One row per distinct description: base_part_type, fuzzy_matched,
    match_score, the 9 flags (0/1) and complexity_score."""
    spark = descriptions.sparkSession
    bases, mods = _registries(spark)
    d = descriptions.select(F.col(col).alias("description")).where(F.col("description").isNotNull()) \
        .distinct().select("description", *split_description("description"))

    # --- base: best registry entry per description (W6: score desc, registry order)
    scored = d.select("description", "base_raw").crossJoin(bases) \
        .withColumn("score", _score("base_raw")) \
        .withColumn("exact", F.col("base_raw") == F.col("reg_name"))
    best = scored.groupBy("description").agg(
        F.max("exact").alias("is_exact"),
        F.max(F.struct(F.col("score"), (-F.col("reg_pos")).alias("neg_pos"), F.col("reg_name"))).alias("b"))
    base = best.select(
        "description",
        F.when(F.col("is_exact") | (F.col("b.score") >= S.FUZZY_MATCH_THRESHOLD), F.col("b.reg_name"))
        .otherwise(F.lit(S.UNKNOWN_PART)).alias("base_part_type"),
        (~F.col("is_exact")).alias("fuzzy_matched"),
        F.when(F.col("is_exact"), F.lit(100.0))
        .when(F.col("b.score") >= S.FUZZY_MATCH_THRESHOLD, F.col("b.score"))
        .otherwise(F.lit(0.0)).alias("match_score"),
    )

    # --- modifiers: explode, best registry entry per piece, keep matches
    pieces = d.where(F.col("mod_raw") != "").select(
        "description", F.posexplode(F.split(F.col("mod_raw"), ",")).alias("piece_pos", "piece"))
    pieces = pieces.withColumn("piece", F.trim(F.col("piece")))
    mscored = pieces.crossJoin(mods).withColumn("score", _score("piece"))
    mbest = mscored.groupBy("description", "piece_pos").agg(
        F.max(F.struct(F.col("score"), (-F.col("reg_pos")).alias("neg_pos"), F.col("flag"),
                       F.col("weight"))).alias("m"))
    matched = mbest.where(F.col("m.score") >= S.FUZZY_MATCH_THRESHOLD) \
        .select("description", F.col("m.flag").alias("flag"), F.col("m.weight").alias("weight"))
    flags = matched.groupBy("description").agg(
        *[F.max(F.when(F.col("flag") == f, 1).otherwise(0)).alias(f) for f in S.COMPLEXITY_FLAGS],
        F.sum("weight").cast("int").alias("complexity_score"))

    out = base.join(flags, "description", "left")
    return out.select(
        "description", "base_part_type", "fuzzy_matched", "match_score",
        *[F.coalesce(F.col(f), F.lit(0)).cast("int").alias(f) for f in S.COMPLEXITY_FLAGS],
        F.coalesce(F.col("complexity_score"), F.lit(0)).cast("int").alias("complexity_score"),
    )


def with_parsed_description(df: DataFrame, col: str = "part_description") -> DataFrame:
    """Attach the parse to every row. The parsed table has one row per
    distinct description; adaptive execution broadcasts it if its bytes
    allow, and else splits skewed descriptions."""
    parsed = parse_distinct(df, col)
    return df.join(parsed, df[col] == parsed["description"], "left").drop("description")
