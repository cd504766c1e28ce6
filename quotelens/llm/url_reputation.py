"""URL filtering by rules and by empirical-Bayes host reputation, with
DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

LEVELS = ("suffix", "domain", "host")
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Second-level names under which country domains are registered.
DOMAIN = r"([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]+))$"
DEFAULT_STRENGTH = 20.0


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty
    where the url is null or has no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(url, PARTS, 2)


def domain_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; a single name is both."""
    found = F.regexp_extract(host, DOMAIN, 1)
    domain = F.when(found == "", host).otherwise(found)
    return domain, F.regexp_replace(domain, r"^[^.]*\.", "")


def first_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """``(rule, its verdict)`` of the longest rule that fits, null if none
    does. ``rules`` are (verdict, host and path); equal lengths: block first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _strength() -> Column:
    """Prior strength (alpha + beta) of groups(n, bad) as a beta-binomial, by
    moments: (1 - rho) / rho of the intraclass correlation, within 1 and 1000; ``DEFAULT_STRENGTH`` where it isn't defined."""
    total, k = F.sum("n"), F.count("*")
    between = (F.sum(F.col("bad") * F.col("bad") / F.col("n")) - F.sum("bad") * F.sum("bad") / total) / (k - 1)
    within = (F.sum("bad") - F.sum(F.col("bad") * F.col("bad") / F.col("n"))) / (total - k)
    size = (total - F.sum(F.col("n") * F.col("n")) / total) / (k - 1)
    rho = (between - within) / (between + (size - 1) * within)
    bounded = F.greatest(F.lit(1 / 1001), F.least(F.lit(0.5), rho))
    return F.when((k > 1) & (total > k) & rho.isNotNull() & ~F.isnan(rho), (1 - bounded) / bounded) \
        .otherwise(F.lit(DEFAULT_STRENGTH))


def reputation(outcomes: DataFrame) -> DataFrame:
    """``host, domain, suffix, n, bad, prior, strength`` of each host of
    ``outcomes(host, bad 0/1)``: the outcomes counted, and the beta prior
    (mean and strength) that its registered domain gives it. The domain's mean
    is in turn shrunk towards its suffix, the suffix's towards all pages."""
    domain, suffix = domain_suffix(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")) \
        .withColumn("domain", domain).withColumn("suffix", suffix)
    hosts = stage(hosts, "hosts")
    counts = {level: hosts.groupBy(level).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")) for level in LEVELS}
    tops = [counts[level].where("n > 0").agg(_strength().alias(f"m_{level}")) for level in LEVELS]
    world = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 10)).alias("rate"))
    one = world
    for t in tops:  # four tables of one row
        one = one.crossJoin(t)
    first = one.first()
    mean = F.lit(first["rate"])
    out = hosts
    for level in LEVELS[:-1]:
        m = F.lit(first[f"m_{level}"])
        c = counts[level].select(level, F.col("n").alias(f"n_{level}"), F.col("bad").alias(f"b_{level}"))
        out = out.join(c, level)
        mean = (F.col(f"b_{level}") + m * mean) / (F.col(f"n_{level}") + m)
    return out.select("host", "domain", "suffix", "n", "bad", mean.alias("prior"),
                      F.lit(first["m_host"]).alias("strength"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], max_bad: float = 0.25, z: float = 1.645,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_bound`` per page.

    ``outcomes(id, bad)`` labels some pages (``bad`` 0 or 1). A page that a
    rule fits has the rule's verdict. Others are blocked if the lower bound
    (``z`` standard deviations below the mean) of their host's posterior bad
    rate is above ``max_bad``. A host without labelled pages has its prior as
    posterior. ``bad_bound`` is that bound. Null urls have an empty host and
    path; null outcomes count for nothing, several outcomes of one id count
    as one, bad if any is; repeated and null page ids are rows like others;
    an empty table gives an empty result; other columns are not read."""
    host, path = host_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = stage(rows, "pages")
    known = outcomes.where("bad is not null").groupBy("id").agg(F.max("bad").cast("long").alias("bad"))
    seen = rows.join(known, rows["page_id"] == known["id"], "left").select("host", "bad")
    rep = reputation(seen)
    mass = F.col("n") + F.col("strength")
    mean = (F.col("bad") + F.col("strength") * F.col("prior")) / mass
    bound = mean - z * F.sqrt(mean * (1 - mean) / (mass + 1))
    rep = rep.select("host", bound.alias("bad_bound"))
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    by_rate = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return rows.join(rep, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_rate).alias("verdict"), "bad_bound")
