"""Rolling drift (W7) and its alarms (ST3): the mean of the last 24 hours at
every override, and what counts as too much.

A range frame over one time axis would bring all events into one task. Here
an axis of minutes carries prefix sums (by day, then over the days); the 24
hours before an event are the whole minutes between, by a difference of two
prefix sums, and two minutes at the edges, whose events are compared within
their minute alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE, DAY = 60, 1440
MOST_OVERRIDDEN, MOST_DELTA = 0.5, 30.0


def alarms(rate: Column, delta: Column) -> tuple[Column, Column]:
    """More than half of the quotes overridden; a mean |delta| above 30 %."""
    return F.coalesce(rate > MOST_OVERRIDDEN, F.lit(False)), F.coalesce(delta > MOST_DELTA, F.lit(False))


def rolling_mean(events: DataFrame, value: str, time: str = "event_time", key: str = "event_id") -> DataFrame:
    """``key, time, value, n_24h, mean_24h`` of each event: count and mean
    over the events from 24 hours before up to its own time, both included."""
    e = events.where(F.col(value).isNotNull() & F.col(time).isNotNull()) \
        .select(F.col(key).alias("key"), F.col(time).alias("time"), F.col(value).cast("double").alias("v"),
                F.unix_micros(time).alias("us"))
    minute = lambda us: F.floor(us / (MINUTE * 1_000_000)).cast("long")
    e = e.withColumn("b", minute(F.col("us")))
    # prefix sums over minutes; the minutes asked for are there too, with nothing
    own = e.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    asked = own.select(F.explode(F.array(F.col("b") - 1, F.col("b") - DAY)).alias("b"), F.lit(0).cast("long").alias("n"),
                       F.lit(0.0).alias("s"))
    axis = own.unionByName(asked).groupBy("b").agg(F.sum("n").alias("n"), F.sum("s").alias("s")) \
        .withColumn("day", F.floor(F.col("b") / DAY))
    days = axis.groupBy("day").agg(F.sum("n").alias("dn"), F.sum("s").alias("ds"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    days = days.select("day", F.coalesce(F.sum("dn").over(upto), F.lit(0)).alias("dn"), F.coalesce(F.sum("ds").over(upto), F.lit(0.0)).alias("ds"))
    inside = Window.partitionBy("day").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefix = axis.withColumn("cn", F.sum("n").over(inside)).withColumn("cs", F.sum("s").over(inside)).join(days, "day") \
        .select("b", (F.col("cn") + F.col("dn")).alias("pn"), (F.col("cs") + F.col("ds")).alias("ps"))
    last = prefix.select(F.col("b").alias("b1"), F.col("pn").alias("n1"), F.col("ps").alias("s1"))
    first = prefix.select(F.col("b").alias("b0"), F.col("pn").alias("n0"), F.col("ps").alias("s0"))
    # the minute of the event itself, and the minute a day before with the event's time as a question
    marks = e.select("b", "us", "v", F.lit(None).cast("string").alias("asks")).unionByName(
        e.select((F.col("b") - DAY).alias("b"), (F.col("us") - DAY * MINUTE * 1_000_000).alias("us"), F.lit(None).cast("double").alias("v"),
                 F.col("key").cast("string").alias("asks")))
    tail = Window.partitionBy("b").orderBy("us").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    edge = marks.withColumn("en", F.count("v").over(tail)).withColumn("es", F.sum("v").over(tail)).where("asks is not null") \
        .select(F.col("asks").alias("k0"), "en", F.coalesce("es", F.lit(0.0)).alias("es"))
    head = Window.partitionBy("b").orderBy("us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("hn", F.count("v").over(head)).withColumn("hs", F.sum("v").over(head))
    j = e.join(last, F.col("b") - 1 == F.col("b1")).join(first, F.col("b") - DAY == F.col("b0")) \
        .join(edge, F.col("key").cast("string") == F.col("k0"))
    n = F.col("hn") + F.col("en") + F.col("n1") - F.col("n0")
    s = F.col("hs") + F.col("es") + F.col("s1") - F.col("s0")
    return j.select(F.col("key").alias(key), F.col("time").alias(time), F.col("v").alias(value), n.alias("n_24h"), (s / n).alias("mean_24h"))
