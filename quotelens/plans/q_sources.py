"""Queries: CSV scan round trip (S1, S3), JSON columns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.csv_scan import load_quotes_csv, to_reference_csv_shape, write_table
from ..sources.quotes import load_quotes
from ..sources.tables import read_table
from .registry import register
from .sqlbase import quotes_cte, with_ctes


@register("s01_csv_scan_roundtrip", oracle=with_ctes(quotes_cte()) + """
SELECT quote_id, strftime(quote_date, '%Y-%m-%d') AS quote_date, part_description, material, process, quantity,
       lead_time_weeks, rush_job, estimator, total_price_usd FROM quotes""", doubles=["total_price_usd"])
def s01(spark, sf):
    """S1 + S3: the quote table written as the historical CSV layout to the
    shared folder and read back through the typed CSV scan."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quotelens-csv/{uuid.uuid4().hex[:10]}"
    write_table(to_reference_csv_shape(load_quotes(spark, sf)), path, "csv")
    return load_quotes_csv(spark, path).withColumn("quote_date", F.date_format("quote_date", "yyyy-MM-dd"))


@register("s11_json_columns", oracle="""
WITH p AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
g AS (SELECT event_type, count(*) AS n, count(k) AS n_k, sum(k)::BIGINT AS sum_k, max(k) AS max_k FROM p GROUP BY event_type)
SELECT event_type, n, n_k, sum_k, max_k, '{"n":' || n || ',"sum_k":' || sum_k || '}' AS summary FROM g""")
def s11(spark, sf):
    """A JSON text column read as typed fields, and a struct written as
    JSON text."""
    p = read_table(spark, sf, "events", ["event_type", "props"]).select(
        "event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    g = p.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("n_k"), F.sum("k").alias("sum_k"),
                                    F.max("k").alias("max_k"))
    return g.withColumn("summary", F.to_json(F.struct("n", "sum_k")))
