"""Workflow events derived from the driver's ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from .tables import read_table

# ---- FIXED VALUES: event mapping -------------------------------------------
EVENT_BY_TYPE = {"signup": "created", "view": "override", "click": "sent",
                 "purchase": "outcome", "error": "outcome"}
OUTCOME_BY_TYPE = {"purchase": "won", "error": "lost"}
QUOTE_BLOCK_DAYS = 5
EPOCH = "2024-01-01"


def _case(mapping: dict, key: Column) -> Column:
    e = None
    for k, v in mapping.items():
        e = F.when(key == k, F.lit(v)) if e is None else e.when(key == k, F.lit(v))
    return e


def workflow_events(events: DataFrame) -> DataFrame:
    """One workflow event per driver event: quote id = user + 5-day block."""
    block = F.floor(F.datediff(F.col("ts").cast("date"), F.lit(EPOCH).cast("date")) / QUOTE_BLOCK_DAYS).cast("long")
    model_price = (F.lit(1000.0) + F.lit(10.0) * (F.col("user_id") % 97).cast("double"))
    ev = _case(EVENT_BY_TYPE, F.col("event_type"))
    return events.select(
        "event_id",
        F.concat_ws("-", F.col("user_id").cast("string"), block.cast("string")).alias("quote_id"),
        ev.alias("event"),
        _case(OUTCOME_BY_TYPE, F.col("event_type")).alias("outcome"),
        F.col("ts").cast("timestamp").alias("event_time"),
        model_price.alias("model_price"),
        F.when(ev == "override", model_price + F.col("value") - F.lit(100.0)).alias("human_price"),
        F.when(ev == "override", F.element_at(F.array(*[F.lit(r) for r in S.OVERRIDE_REASONS]),
                                              (F.col("event_id") % 8).cast("int") + 1)).alias("reason"),
    ).where(F.col("event").isNotNull())


def load_workflow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow_events(read_table(spark, sf_dir, "events",
                                      ["event_id", "ts", "user_id", "event_type", "value"]))


def _nth(values: list[str], n: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n).cast("int") + 1)


def _each(n: int) -> Column:
    return F.col("event_id") % n == 0


def override_requests(ev: DataFrame) -> DataFrame:
    """Override requests of the events, with defects planted by event id."""
    return ev.where(F.col("event") == "override").select(
        "event_id", F.when(_each(11), -5.0).when(_each(13), 2e7).otherwise(F.col("human_price")).alias("human_price"),
        F.when(_each(17), "gut_feeling").otherwise(F.col("reason")).alias("reason"),
        F.when(_each(19), F.repeat(F.lit("x"), 1001)).otherwise(F.lit("checked")).alias("reason_text"),
        F.when(_each(23), "Mori-san").when(~_each(5), _nth(S.VALID_ESTIMATORS, 3)).alias("estimator_id"))


def outcome_requests(ev: DataFrame) -> DataFrame:
    """Outcome requests of the events, with defects planted by event id."""
    return ev.where(F.col("event") == "outcome").select(
        "event_id", F.when(_each(7), "cancelled").otherwise(F.col("outcome")).alias("outcome"),
        F.when(_each(11), "weather").when(F.col("outcome") == "lost", _nth(S.LOSS_REASONS, 5)).alias("reason"),
        F.when(_each(13), F.repeat(F.lit("x"), 1001)).otherwise(F.lit("as agreed")).alias("reason_text"),
        F.when(_each(17), 0.0).when(~_each(4), F.col("model_price")).alias("final_price"),
        F.when(_each(19), F.repeat(F.lit("P"), 101)).otherwise(F.lit("PO-1")).alias("po_number"))
