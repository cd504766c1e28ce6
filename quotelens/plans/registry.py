"""Query registry: name -> Spark builder, DuckDB oracle SQL.

Every registered query reads the driver tables (or data Spark derives
from them). Double columns are rounded to ``DIGITS`` decimals on both
sides because the two engines sum in different orders."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None
    doubles: list[str] = field(default_factory=list)


REGISTRY: dict[str, Entry] = {}


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def wrap_oracle(sql: str, doubles: list[str], digits: int = DIGITS) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f'round(CAST("{c}" AS DOUBLE), {digits}) AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS oracle_result"


def register(name: str, oracle: str | None = None, doubles: list[str] | None = None):
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        REGISTRY[name] = Entry(name, build, wrap_oracle(oracle, doubles or []) if oracle else None,
                               doubles or [])
        return fn
    return deco
