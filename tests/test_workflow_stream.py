"""Lifecycle: stream equals batch; state rules on a hand-built history;
M0 respects the planted economics (coherence probes)."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001, SF01
from quotelens.operators.workflow import lifecycle


def test_stream_equals_batch_for_events_dealt_over_files(spark, tmp_path):
    """Events dealt at random over four files, read one file a batch."""
    spark.read.parquet(f"{SF001}/events.parquet").orderBy(F.rand(3)).repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("st2_stream_equals_batch", "st3_drift_equals_batch"):
        r = E.queries()[name](spark, str(tmp_path)).first()
        assert r["n_batch"] == r["n_stream"] > 0 and r["n_different"] == 0


def test_lifecycle_rules(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = [  # (event_id, quote_id, event, outcome, minute)
        (1, "A", "override", None, 0), (2, "A", "created", None, 1), (3, "A", "outcome", "won", 2),
        (4, "A", "override", None, 3), (5, "A", "sent", None, 4), (6, "A", "sent", None, 5),
        (7, "A", "outcome", "lost", 6), (8, "A", "sent", None, 7), (9, "A", "created", None, 8),
    ]
    rows = [(i, q, e, o, t0 + dt.timedelta(minutes=m), 1000.0, 1100.0 if e == "override" else None,
             "other" if e == "override" else None) for i, q, e, o, m in ev]
    df = spark.createDataFrame(rows, "event_id long, quote_id string, event string, outcome string, "
                                     "event_time timestamp, model_price double, human_price double, reason string")
    got = {r["event_id"]: (r["code"], r["status_after"]) for r in lifecycle(df).collect()}
    assert got[1] == ("QUOTE_NOT_FOUND", None)
    assert got[2] == (None, "draft")
    assert got[3] == ("INVALID_STATE", "draft")
    assert got[4] == (None, "review")
    assert got[5] == (None, "sent")
    assert got[6] == ("ALREADY_SENT", "sent")
    assert got[7] == (None, "lost")
    assert got[8] == ("QUOTE_CLOSED", "lost")
    assert got[9] == ("ALREADY_EXISTS", "lost")


def test_m0_coherence(spark):
    # strongly planted effects hold even on the smallest table
    d = {r["check"]: r["passed"] for r in E.queries()["l03_deterministic_m0"](spark, SF001).collect()}
    assert d["material_ordering"] and d["rush_premium"] and d["quantity_discount"]
    # with 60k rows every check passes
    r = E.queries()["l03_summary_m0"](spark, SF01).first()
    assert r["total_count"] == 10 and r["pass_count"] == 10
