"""Materialized stages: written tables under the checkpoint folder.

A stage is written as parquet into the folder the session names in
``spark.checkpoint.dir`` (set only when unset, e.g. in tests) and read
back, so downstream jobs get column pruning and predicate pushdown, the
lineage is cut, and the data survives executor loss.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_CACHE: dict = {}


def write_stage(df: DataFrame, name: str = "stage") -> DataFrame:
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/quotelens-stages/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:10]}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Newest change of each table of an input folder: what is built from
    changed tables is built anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir.rstrip("/"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((str(s.getPath().getName()), int(s.getModificationTime()), int(s.getLen())) for s in fs.listStatus(path)))


def cached_value(spark: SparkSession, name: str, sf_dir: str, build):
    """What ``build()`` gives, made once per application and state of the
    input folder."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    stamp = input_stamp(spark, sf_dir)
    hit = _CACHE.get(key)
    if hit is None or hit[0] != stamp:
        hit = _CACHE[key] = (stamp, build())
    return hit[1]


def cached_stage(spark: SparkSession, name: str, sf_dir: str, build) -> DataFrame:
    """Build and write a shared intermediate once per application and state
    of the input folder (e.g. the enriched quotes, out-of-fold predictions)."""
    return cached_value(spark, name, sf_dir, lambda: write_stage(build(), name))
