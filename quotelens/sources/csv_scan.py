"""S1 typed CSV scan and S3-S6 sinks.

The historical quote CSV is read as strings under its own header (no
inference), checked for the required columns, blanks become NULL,
and values are converted with ``try_*`` casts (ANSI mode would raise on
a bad cast; bad values surface as NULL and are caught by the quality
rules instead)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def load_quotes_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    missing = set(S.EXPECTED_COLUMNS) - set(raw.columns)
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(sorted(missing))}")

    def blank(c: str):
        return F.when(F.trim(F.col(c)) == "", F.lit(None)).otherwise(F.col(c))

    return raw.select(
        blank("QuoteID").alias("quote_id"),
        F.to_date(blank("Date"), "yyyy-MM-dd").alias("quote_date"),
        blank("PartDescription").alias("part_description"),
        blank("Material").alias("material"),
        blank("Process").alias("process"),
        F.expr("try_cast(Quantity AS INT)").alias("quantity"),
        F.expr("try_cast(LeadTimeWeeks AS INT)").alias("lead_time_weeks"),
        F.when(F.col("RushJob") == "Yes", F.lit(True)).when(F.col("RushJob") == "No", F.lit(False))
        .otherwise(F.lit(None).cast("boolean")).alias("rush_job"),
        blank("Estimator").alias("estimator"),
        F.expr("try_cast(TotalPrice_USD AS DOUBLE)").alias("total_price_usd"),
    )


def to_reference_csv_shape(q: DataFrame) -> DataFrame:
    """The quote table in the historical CSV layout (column names, Yes/No)."""
    return q.select(
        F.col("quote_id").alias("QuoteID"), F.date_format("quote_date", "yyyy-MM-dd").alias("Date"),
        F.col("part_description").alias("PartDescription"), F.col("material").alias("Material"),
        F.col("process").alias("Process"), F.col("quantity").alias("Quantity"),
        F.col("lead_time_weeks").alias("LeadTimeWeeks"),
        F.when(F.col("rush_job"), "Yes").otherwise("No").alias("RushJob"),
        F.col("estimator").alias("Estimator"), F.col("total_price_usd").alias("TotalPrice_USD"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """S3 / S4 / S6 / S9 sink: csv, json or parquet, optionally partitioned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
