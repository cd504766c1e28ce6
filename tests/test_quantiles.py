"""Exact grouped quantiles against numpy's linear interpolation, with heavy
ties, a hot key, null keys and weights."""

import numpy as np
from pyspark.sql import functions as F

from quotelens.operators.quantiles import grouped_stats, weighted_quantiles

PROBS = [("p10", "v", 0.1), ("med", "v", 0.5), ("p95", "v", 0.95)]


def test_matches_numpy(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g, n in [("hot", 5000), ("a", 17), ("b", 1), ("c", 2), (None, 30)]:
        rows += [(g, float(v)) for v in rng.lognormal(3, 1, n)]
    rows += [("ties", float(v)) for v in rng.integers(0, 3, 900)] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: r for r in grouped_stats(df, ["g"], [F.count("v").alias("n")], PROBS).collect()}
    for g in ("hot", "a", "b", "c", None, "ties"):
        vals = np.array([v for k, v in rows if k == g and v is not None])
        for name, _, p in PROBS:
            want = np.percentile(vals, p * 100)
            assert abs(got[g][name] - want) < 1e-9 * max(1, abs(want))
        assert got[g]["n"] == len(vals)
    assert got["none"]["med"] is None and got["none"]["n"] == 0


def test_global_and_weighted(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    r = grouped_stats(df, [], [], [("m", "v", 0.5), ("q", "v", 0.25)]).first()
    assert r["m"] == 500.5 and abs(r["q"] - 250.75) < 1e-12
    w = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 2)], "v double, n int")
    r = weighted_quantiles(w, [], "v", [("m", 0.5), ("h", 0.9)], "n").first()
    assert r["m"] == np.percentile([1, 1, 1, 2, 9, 9], 50) and abs(r["h"] - 9.0) < 1e-12
