"""Quote lifecycle as data.

The lifecycle's phases only move forward (none < draft < review < sent <
closed), so the state after any event is fixed by a few per-quote
"first time" marks: the first ``created``, the first override after it,
the first ``sent`` after it, the first outcome after that. Each mark is a
partial aggregate (``min`` of (time, id)) joined back -- three rounds,
exact, and no quote's events are ever gathered into one task (a hot
quote is spread over all tasks of the aggregation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def _key() -> Column:
    return F.struct(F.col("event_time"), F.col("event_id"))


def _first_after(ev: DataFrame, cond: Column, name: str) -> DataFrame:
    return ev.where(cond).groupBy("quote_id").agg(F.min(_key()).alias(name))


def lifecycle(ev: DataFrame) -> DataFrame:
    """Q3: replay per event -> (accepted, code, status_after)."""
    k = _key()
    c = _first_after(ev, F.col("event") == "created", "t_c")
    e1 = ev.join(c, "quote_id", "left")
    after_c = F.col("t_c").isNotNull() & (k > F.col("t_c"))
    s = _first_after(e1, (F.col("event") == "sent") & after_c, "t_s")
    r = _first_after(e1, (F.col("event") == "override") & after_c, "t_r")
    e2 = e1.join(s, "quote_id", "left").join(r, "quote_id", "left")
    o = e2.where((F.col("event") == "outcome") & F.col("t_s").isNotNull() & (k > F.col("t_s"))) \
        .groupBy("quote_id").agg(F.min(F.struct(F.col("event_time"), F.col("event_id"), F.col("outcome"))).alias("t_o"))
    e3 = e2.join(o, "quote_id", "left")
    t_o = F.struct(F.col("t_o.event_time"), F.col("t_o.event_id"))
    exists = F.col("t_c").isNotNull() & (k >= F.col("t_c"))
    sent = F.col("t_s").isNotNull() & (k >= F.col("t_s"))
    closed = F.col("t_o").isNotNull() & (k >= t_o)
    review = F.col("t_r").isNotNull() & (k >= F.col("t_r"))
    status = (F.when(closed, F.col("t_o.outcome")).when(sent, "sent").when(review, "review")
              .when(exists, "draft").otherwise(F.lit(None)))
    ev_ = F.col("event")
    code = (F.when(ev_ == "created", F.when(k == F.col("t_c"), F.lit(None)).otherwise(F.lit("ALREADY_EXISTS")))
            .when(~exists, F.lit("QUOTE_NOT_FOUND"))
            .when(ev_ == "override", F.lit(None))
            .when(ev_ == "sent", F.when(k == F.col("t_s"), F.lit(None))
                  .when(F.col("t_o").isNotNull() & (k > t_o), F.lit("QUOTE_CLOSED"))
                  .otherwise(F.lit("ALREADY_SENT")))
            .when(ev_ == "outcome", F.when(F.col("t_o").isNotNull() & (k == t_o), F.lit(None))
                  .otherwise(F.lit("INVALID_STATE"))))
    return e3.select("event_id", "quote_id", "event", "outcome", "event_time", "model_price", "human_price",
                     "reason", code.isNull().alias("accepted"), code.alias("code"), status.alias("status_after"))


def overrides(lc: DataFrame) -> DataFrame:
    """Q2: accepted overrides with delta and delta % of the model price."""
    o = lc.where((F.col("event") == "override") & F.col("accepted"))
    d = F.col("human_price") - F.col("model_price")
    return o.select("event_id", "quote_id", "event_time", "model_price", "human_price", "reason",
                    d.alias("delta"), (d / F.col("model_price") * 100).alias("delta_pct"))


def quote_list(lc: DataFrame) -> DataFrame:
    """Q4 + Q5 + J10 + W3 + T3: one row per created quote: final status,
    final price = latest accepted override (by time, then id) else the
    model price; newest first."""
    acc = lc.where(F.col("accepted"))
    created = acc.where(F.col("event") == "created").select("quote_id", F.col("event_time").alias("created_at"),
                                                            "model_price")
    last = acc.groupBy("quote_id").agg(
        F.max_by("status_after", F.struct("event_time", "event_id")).alias("status"),
        F.max_by(F.when(F.col("event") == "override", F.col("human_price")),
                 F.when(F.col("event") == "override", F.struct("event_time", "event_id"))).alias("last_override"),
        F.count(F.when(F.col("event") == "override", 1)).alias("n_overrides"))
    j = created.join(last, "quote_id")
    return j.select("quote_id", "status", "created_at", "model_price",
                    F.coalesce("last_override", "model_price").alias("final_price"), "n_overrides") \
        .orderBy(F.col("created_at").desc(), "quote_id")


def quote_timeline(lc: DataFrame) -> DataFrame:
    """Q6: lifecycle marks per quote as a timeline text (Created /
    Overridden / Sent / Won|Lost) with times."""
    acc = lc.where(F.col("accepted"))
    g = acc.groupBy("quote_id").agg(
        F.min(F.when(F.col("event") == "created", F.col("event_time"))).alias("created_at"),
        F.max(F.when(F.col("event") == "override", F.col("event_time"))).alias("overridden_at"),
        F.min(F.when(F.col("event") == "sent", F.col("event_time"))).alias("sent_at"),
        F.min(F.when(F.col("event") == "outcome", F.col("event_time"))).alias("outcome_at"),
        F.max(F.when(F.col("event") == "outcome", F.col("outcome"))).alias("outcome"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    parts = F.array(
        F.concat(F.lit("Created@"), F.date_format("created_at", fmt)),
        F.when(F.col("overridden_at").isNotNull(), F.concat(F.lit("Overridden@"), F.date_format("overridden_at", fmt))),
        F.when(F.col("sent_at").isNotNull(), F.concat(F.lit("Sent@"), F.date_format("sent_at", fmt))),
        F.when(F.col("outcome_at").isNotNull(), F.concat(F.initcap("outcome"), F.lit("@"), F.date_format("outcome_at", fmt))))
    return g.where(F.col("created_at").isNotNull()).select(
        "quote_id", F.array_join(F.filter(parts, lambda x: x.isNotNull()), " | ").alias("timeline"))


def status_counts(quotes: DataFrame) -> DataFrame:
    """Q7: quotes per final status."""
    return quotes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def retention(quotes: DataFrame, days: int = 90, later_days: int = 0) -> DataFrame:
    """Quotes created within ``days`` of a moment ``later_days`` after
    the newest quote."""
    newest = quotes.agg((F.max("created_at") + F.expr(f"INTERVAL {later_days} DAYS")).alias("_as_of"))
    return quotes.crossJoin(F.broadcast(newest)) \
        .where(F.col("created_at") >= F.col("_as_of") - F.expr(f"INTERVAL {days} DAYS")).drop("_as_of")


def daily_drift(ov: DataFrame, lc: DataFrame) -> DataFrame:
    """Per day, overrides per created quote and mean |delta %|."""
    day = F.to_date("event_time")
    created = lc.where((F.col("event") == "created") & F.col("accepted")).groupBy(day.alias("day")) \
        .agg(F.count(F.lit(1)).alias("n_created"))
    o = ov.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n_overrides"),
                                         F.avg(F.abs("delta_pct")).alias("mean_abs_delta_pct"))
    return created.join(o, "day", "full").select(
        "day", F.coalesce("n_created", F.lit(0)).alias("n_created"), F.coalesce("n_overrides", F.lit(0)).alias("n_overrides"),
        "mean_abs_delta_pct")


def reason_outcomes(lc: DataFrame) -> DataFrame:
    """Override reason shares and the win rate of quotes whose
    latest override had that reason."""
    ov = lc.where((F.col("event") == "override") & F.col("accepted"))
    last = ov.groupBy("quote_id").agg(F.max_by("reason", F.struct("event_time", "event_id")).alias("reason"))
    fin = lc.where((F.col("event") == "outcome") & F.col("accepted")).select("quote_id", "outcome")
    share = ov.groupBy("reason").agg(F.count(F.lit(1)).alias("n_overrides"))
    tot = ov.agg(F.count(F.lit(1)).alias("_t"))
    wins = last.join(fin, "quote_id", "left").groupBy("reason").agg(
        F.count("outcome").alias("n_closed"), F.count(F.when(F.col("outcome") == "won", 1)).alias("n_won"))
    return share.crossJoin(tot).join(wins, "reason", "left").select(
        "reason", "n_overrides", (F.col("n_overrides") / F.col("_t") * 100).alias("share_pct"),
        F.coalesce("n_closed", F.lit(0)).alias("n_closed"), F.coalesce("n_won", F.lit(0)).alias("n_won"))


MOST_PRICE, MOST_TEXT, MOST_PO = 10_000_000, 1000, 100


def _failed(rules: list[tuple[Column, str]]) -> tuple[Column, Column]:
    """The messages of the rules that fail, in order, and whether none does."""
    found = F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]), lambda x: x.isNotNull())
    return F.array_join(found, "; "), F.size(found) == 0


def _unknown(col: str, domain: list[str]) -> Column:
    return F.col(col).isNotNull() & ~F.col(col).isin(*domain)


def override_request_errors(requests: DataFrame) -> DataFrame:
    """Price in range, known reason and estimator, text not too long."""
    p = F.col("human_price")
    errors, ok = _failed([
        (p.isNull() | (p <= 0) | (p > MOST_PRICE), f"human_price: must be > 0 and <= {MOST_PRICE}"),
        (_unknown("reason", S.OVERRIDE_REASONS), "reason_category: unknown reason"),
        (F.length("reason_text") > MOST_TEXT, f"reason_text: more than {MOST_TEXT} characters"),
        (_unknown("estimator_id", S.VALID_ESTIMATORS), "estimator_id: unknown estimator")])
    return requests.select("event_id", errors.alias("errors"), ok.alias("is_valid"))


def outcome_request_errors(requests: DataFrame) -> DataFrame:
    """Closing outcome, known loss reason, texts not too long, a final
    price above zero if there is one."""
    errors, ok = _failed([
        (F.col("outcome").isNull() | _unknown("outcome", S.CLOSING_OUTCOMES), "outcome: must be won, lost or expired"),
        (_unknown("reason", S.LOSS_REASONS), "reason: unknown reason"),
        (F.length("reason_text") > MOST_TEXT, f"reason_text: more than {MOST_TEXT} characters"),
        (F.col("final_price") <= 0, "final_negotiated_price: must be > 0"),
        (F.length("po_number") > MOST_PO, f"po_number: more than {MOST_PO} characters")])
    return requests.select("event_id", errors.alias("errors"), ok.alias("is_valid"))
