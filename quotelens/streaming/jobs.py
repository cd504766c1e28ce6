"""Structured Streaming forms of the online pieces.

* ST3 drift: overrides per sliding 24 h window (1 h slide) with a
  watermark.
* ST2 lifecycle: ``applyInPandasWithState`` keyed by quote. A quote's events
  wait in its state until the watermark has passed them and are then applied
  in event-time order, whatever files and batches they came in; the state goes
  90 days after the quote's last event.

Events may be up to ``DISORDER`` out of order across files; later ones are
dropped by the watermark. Each runner drains the available input with
``trigger(availableNow)`` into a parquet sink under the checkpoint folder.
Then one closing event far in the future moves the watermark past everything,
so that windows still open and events still waiting come out as well; its own
rows are removed. The returned table equals the batch form."""

from __future__ import annotations

import datetime
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.alarms import alarms
from ..session import ensure_checkpoint_dir
from ..sources.events import workflow_events

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


DISORDER = "90 days"
EXPIRY_DAYS = 90
CLOSING_ID = -1


def event_stream(spark: SparkSession, sf_dir: str, closing: str) -> DataFrame:
    """The events table as a stream, one file a batch, with the closing
    event's folder."""
    tables = [f"{sf_dir.rstrip("/")}/events.parque[t]", closing]  # a pattern, as the table is a file or a folder
    both = [spark.readStream.format("parquet").schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).load(t) for t in tables]
    return both[0].unionByName(both[1])


def _drain(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Run ``build(stream)`` over all input and then over the closing event;
    waits for as long as that takes, and raises what the query raises."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quotelens-streams/{name}-{uuid.uuid4().hex[:10]}"
    closing = f"{root}/closing"
    spark.createDataFrame([], EVENTS_SCHEMA).write.parquet(closing)
    last = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").agg(F.max("ts").alias("t")).first()["t"]
    last = last or datetime.datetime(2000, 1, 1)
    out = None
    for closed in (False, True):
        if closed:
            far = last + datetime.timedelta(days=3 * EXPIRY_DAYS)
            spark.createDataFrame([(CLOSING_ID, far, CLOSING_ID, "view", 0.0, None)], EVENTS_SCHEMA) \
                .write.mode("append").parquet(closing)
        out = build(event_stream(spark, sf_dir, closing))
        q = (out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/chk")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def _override_windows(ev: DataFrame) -> DataFrame:
    d = (F.col("human_price") - F.col("model_price")) / F.col("model_price") * 100
    override = F.col("event") == "override"
    agg = ev.where(override | (F.col("event") == "created")).groupBy(F.window("event_time", "24 hours", "1 hour").alias("w")).agg(
        F.count(F.when(override, 1)).alias("n_overrides"), F.count(F.when(~override, 1)).alias("n_created"),
        F.avg(F.when(override, F.abs(d))).alias("mean_abs_delta_pct"))
    rate = F.when(F.col("n_created") > 0, F.col("n_overrides") / F.col("n_created"))
    often, far = alarms(rate, F.col("mean_abs_delta_pct"))
    return agg.where("n_overrides > 0").select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_overrides", "n_created",
        rate.alias("override_rate"), "mean_abs_delta_pct", often.alias("rate_alarm"), far.alias("delta_alarm"))


def drift_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: per 24 h window sliding by 1 h with an override: overrides,
    created quotes, rate, mean |delta %|, and the two alarms."""
    return _drain(spark, sf_dir, "drift", lambda st: _override_windows(
        workflow_events(st).withWatermark("event_time", DISORDER)))


def drift_windows_batch(ev: DataFrame) -> DataFrame:
    """Batch twin of ST3."""
    return _override_windows(ev)


LC_OUT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("quote_id", T.StringType()),
    T.StructField("event", T.StringType()), T.StructField("accepted", T.BooleanType()),
    T.StructField("code", T.StringType()), T.StructField("status_after", T.StringType()),
])
LC_STATE = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("last_ms", T.LongType()),
    T.StructField("times", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("events", T.ArrayType(T.StringType())), T.StructField("outcomes", T.ArrayType(T.StringType())),
])
CLOSED = ("won", "lost", "expired")


def next_status(status: str | None, event: str, outcome: str | None) -> tuple[str | None, str | None]:
    """``(status, error code)`` after one event."""
    if event == "created":
        return ("draft", None) if status is None else (status, "ALREADY_EXISTS")
    if status is None:
        return None, "QUOTE_NOT_FOUND"
    if event == "override":
        return "review" if status == "draft" else status, None
    if event == "sent":
        code = "ALREADY_SENT" if status == "sent" else "QUOTE_CLOSED" if status in CLOSED else None
        return (status, code) if code else ("sent", None)
    return (outcome, None) if status == "sent" else (status, "INVALID_STATE")


def _lifecycle_step(key, batches, state):
    """New events wait in the state; those that the watermark has passed are
    applied in time order."""
    status, last, *lists = state.get if state.exists else (None, 0, [], [], [], [])
    waiting = list(zip(*lists))
    for pdf in batches:
        at = pdf["event_time"].astype("datetime64[us]").astype("int64")
        waiting += zip(at.tolist(), pdf["event_id"].tolist(), pdf["event"], pdf["outcome"])
    waiting.sort(key=lambda w: w[:2])
    mark = state.getCurrentWatermarkMs()
    rows = []
    while waiting and waiting[0][0] // 1000 < mark:
        at, eid, event, outcome = waiting.pop(0)
        status, code = next_status(status, event, outcome)
        last = max(last, at // 1000)
        rows.append((int(eid), key[0], event, code is None, code, status))
    expiry = last + EXPIRY_DAYS * 86_400_000
    if not waiting and expiry <= mark:
        if state.exists:
            state.remove()
    else:
        state.update((status, int(last), *[list(c) for c in (zip(*waiting) if waiting else ([], [], [], []))]))
        state.setTimeoutTimestamp(max(mark, waiting[0][0] // 1000 if waiting else expiry) + 1)
    yield pd.DataFrame(rows, columns=[f.name for f in LC_OUT.fields])


def lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: lifecycle replay as a keyed stateful stream; equals the batch
    replay (Q3) for any split of the events over files."""
    def build(stream: DataFrame) -> DataFrame:
        ev = workflow_events(stream).select("event_id", "quote_id", "event", "outcome", "event_time")
        return ev.withWatermark("event_time", DISORDER).groupBy("quote_id").applyInPandasWithState(
            _lifecycle_step, LC_OUT, LC_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return _drain(spark, sf_dir, "lifecycle", build).where(F.col("event_id") != CLOSING_ID)
