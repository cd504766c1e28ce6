"""All fourteen models as tables: fitted in one go, stored in versions, and
scored side by side in one pass without a shuffle (S5-S8, R1, R2, J6).

A model set is a handful of small tables: M0's levels and scalars, the linear
coefficients, the tree nodes, error bands and training bounds. Each holds the
fits of the five training folds and, as fold ``ALL``, that of all rows; a row
is scored by the fit that its ``fold`` column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from . import cv
from . import linear as LN
from . import trees as TR
from .predict import array_median
from .stage import write_stage

ALL = S.N_FOLDS
LINEAR = ["M1", "M2", "M3a", "M3b", "M4"]
TABLES = ["m0_levels", "m0_scalars", "linear", "trees"]
#: What scoring needs of a quote.
NEEDS = ["part_description", "material", "process", "quantity", "rush_job", "lead_time_weeks", "estimator", "quote_date",
         "base_part_type", *S.COMPLEXITY_FLAGS, "complexity_score"]


# -------------------------------------------------------------- fitting ----
def linear_table(q: DataFrame) -> DataFrame:
    return write_stage(LN.coefficient_table(q.sparkSession, LN.fit_linear(q)).coalesce(1), "linear")


def tree_table(q: DataFrame, models=None, folds=None, cells: DataFrame | None = None) -> DataFrame:
    """The trees of some models and fits (all by default); a fit does not
    depend on what else is fitted. ``cells`` gives the quotes' cells if they
    are made already."""
    return write_stage(TR.fit_trees(q, models, folds, cells), "trees")


def fit_models(q: DataFrame, made: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of all models, each written once; ``made`` gives those that
    are made already."""
    made = dict(made or {})
    if "m0_levels" not in made:
        levels, scalars = cv.m0_fit(q)
        made |= {"m0_levels": write_stage(levels, "m0-levels"), "m0_scalars": scalars}
    if "linear" not in made:
        made["linear"] = linear_table(q)
    if "trees" not in made:
        made["trees"] = tree_table(q)
    return made


# -------------------------------------------------------------- scoring ----
def score_wide(rows: DataFrame, tables: dict[str, DataFrame], keep: tuple[str, ...] = (), models=None,
               folds=range(S.N_FOLDS)) -> DataFrame:
    """``quote_id, fold, *keep, preds`` with a struct of one price a
    model (a model without a fit is left out, and ``tables`` need hold no others'). Parameter tables are small and
    joined or sent to the tasks; nothing is shuffled. ``folds`` names the
    fits that the rows use: only these are sent."""
    spark = rows.sparkSession
    models = S.MODEL_NAMES if models is None else models
    fits = LN.load_fits(tables["linear"].where(F.col("fold").isin(*folds))) if "linear" in tables else []
    forests = TR.load_forests(tables["trees"].where(F.col("fold").isin(*folds))) if "trees" in tables else None
    r = rows
    for c in ("unit_price", "total_price_usd"):  # requests have no price yet
        if c not in r.columns:
            r = r.withColumn(c, F.lit(None).cast("double"))
    extra = [c for c in keep if c not in ("quote_id", "fold")]
    r = r.select("quote_id", "fold", "unit_price", "total_price_usd", *NEEDS, *[F.col(c).alias(f"_keep_{c}") for c in extra])
    r = r.withColumn("_key", TR.cell_key()).withColumn("k", F.col("fold"))
    if "M0" in models and "m0_levels" in tables:
        r = cv.m0_score(r, tables["m0_levels"], tables["m0_scalars"]).withColumnRenamed("pred", "_m0")
    else:
        r = r.withColumn("_m0", F.lit(None).cast("double"))
    prices_of, linear = LN.linear_prices(spark, fits, folds)
    d = r if prices_of is None else r.withColumn("linear", prices_of)
    prices: dict[str, Column] = ({"M0": F.col("_m0")} if "m0_levels" in tables else {}) | {m: F.col(f"linear.{m}") for m in linear}
    grown = [m for m in models if forests is not None and m in forests.models]
    if grown:
        d = d.withColumn("_trees", TR.tree_predictions(spark, forests, grown)(F.col("_key"), F.col("fold")))
        prices |= {m: F.col(f"_trees.{m}") for m in grown}
    preds = F.struct(*[prices[m].cast("double").alias(m) for m in models if m in prices])
    return d.select("quote_id", "fold", *[F.col(f"_keep_{c}").alias(c) for c in extra], preds.alias("preds"))


def scored_models(wide: DataFrame) -> list[str]:
    return wide.schema["preds"].dataType.names


def long_form(wide: DataFrame) -> DataFrame:
    """A row for each quote and model: ``model, pred`` beside the other columns."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"preds.{m}").alias("pred")) for m in scored_models(wide)])
    others = [c for c in wide.columns if c != "preds"]
    return wide.select(*others, F.explode(pairs).alias("_p")).select(*others, "_p.model", "_p.pred")


def score_requests(requests: DataFrame, tables: dict[str, DataFrame], models=None) -> DataFrame:
    """``request_id, preds, estimator_range`` for parsed requests
    (``request_id`` and NEEDS). With an estimator each model prices the
    request as it is. Without one, the models that never see the estimator
    do so, the others price it with each estimator and give the median;
    ``estimator_range`` then maps each estimator to the median over those
    models. Only requests without an estimator are shuffled, three rows
    each."""
    need = [c for c in NEEDS if c != "estimator"]
    each = F.when(F.col("estimator").isNull(), F.array(*[F.lit(e) for e in S.VALID_ESTIMATORS])).otherwise(F.array("estimator"))
    rows = requests.select(F.col("request_id").alias("quote_id"), F.lit(ALL).alias("fold"), *need,
                           F.col("estimator").isNull().alias("absent"), F.explode(each).alias("estimator"))
    wide = score_wide(rows, tables, keep=("absent", "estimator"), models=models, folds=[ALL])
    names = scored_models(wide)
    aware = [m for m in names if m not in S.DEBIASED_MODELS]
    known = wide.where(~F.col("absent")).select(F.col("quote_id").alias("request_id"), "preds",
                                                F.lit(None).cast("map<string,double>").alias("estimator_range"))
    if not aware:
        other = wide.where("absent").where(F.col("estimator") == S.VALID_ESTIMATORS[0]) \
            .select(F.col("quote_id").alias("request_id"), "preds", F.lit(None).cast("map<string,double>").alias("estimator_range"))
        return known.unionByName(other)
    of = wide.where("absent").withColumn("median", array_median(F.array(*[F.col(f"preds.{m}") for m in aware])))
    picked = {m: F.first(F.col(f"preds.{m}")) if m in S.DEBIASED_MODELS else array_median(F.collect_list(F.col(f"preds.{m}")))
              for m in names}
    other = of.groupBy("quote_id").agg(
        *[c.alias(f"_{m}") for m, c in picked.items()],
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("estimator", "median")))).alias("estimator_range"))
    return known.unionByName(other.select(F.col("quote_id").alias("request_id"),
                                          F.struct(*[F.col(f"_{m}").alias(m) for m in names]).alias("preds"), "estimator_range"))


# ------------------------------------------------------------- versions ----
def _path(spark: SparkSession, uri: str):
    return spark._jvm.org.apache.hadoop.fs.Path(uri)


def publish(tables: dict[str, DataFrame], root: str, version: str | None = None) -> str:
    """Write the tables into a folder of their own and only then add
    a pointer row that names it. A publication that breaks off leaves the
    former version current."""
    spark = next(iter(tables.values())).sparkSession
    version = version or uuid.uuid4().hex[:12]
    base = f"{root.rstrip('/')}/version={version}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/{name}")
    spark.createDataFrame([(n,) for n in sorted(tables)], "name string").coalesce(1) \
        .write.mode("errorifexists").parquet(f"{base}/contents")
    point_to(spark, root, version)
    return version


POINTER = "seq long, version string"


def history(spark: SparkSession, root: str) -> DataFrame:
    """The pointer rows: which version was made current, in order."""
    path = f"{root.rstrip('/')}/pointer"
    p = _path(spark, path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], POINTER)
    return spark.read.schema(POINTER).parquet(path)


def point_to(spark: SparkSession, root: str, version: str) -> None:
    """Make a stored version the current one: a newer one as well as an older
    one (rollback)."""
    done = _path(spark, f"{root.rstrip('/')}/version={version}/contents/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        raise ValueError(f"version {version} is not stored as a whole under {root}")
    last = history(spark, root).agg(F.max("seq")).first()[0] or 0
    spark.createDataFrame([(last + 1, version)], POINTER).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/pointer")


def current_version(spark: SparkSession, root: str) -> str:
    got = history(spark, root).agg(F.max_by("version", "seq")).first()[0]
    if got is None:
        raise ValueError(f"no version was published under {root}")
    return got


def load(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version, by default of the current one."""
    version = version or current_version(spark, root)
    base = f"{root.rstrip('/')}/version={version}"
    return {r["name"]: spark.read.parquet(f"{base}/{r['name']}") for r in spark.read.parquet(f"{base}/contents").collect()}
