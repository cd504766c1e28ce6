"""Exact top-k inner products by norm buckets.

Vectors are dealt by length into buckets. A query first meets the bucket of
the longest vectors, which gives it a threshold; against every other bucket
that threshold becomes a local cosine threshold: the least cosine with which
the bucket's longest vector could still enter the result. Above 1 the bucket is
passed over; where it is high, the query's largest coordinates bound those of
a candidate, and only candidates within the bounds are multiplied out; where
it is low, the candidates are cut by length alone. What remains is verified by
exact integer products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

FOCUS = 3


def floor_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, v array<long>, norm2 long``: components as floor(scale * x), rows
    with a null id or vector, or null or non-finite components left out."""
    raw = F.col(f"`{vector_col}`").cast("array<double>")
    ok = raw.isNotNull() & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("raw", lambda x: F.floor(x * scale))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), raw.alias("raw")).where(ok & F.col("id").isNotNull()) \
        .select("id", v.alias("v")) \
        .withColumn("norm2", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))


class Bucket:
    """Vectors of one length range with their coordinate order."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        order = np.lexsort((ids, -norm))
        self.ids, self.v, self.norm = ids[order], v[order].astype(np.float64), norm[order]
        self.unit = self.v / np.maximum(self.norm, 1e-300)[:, None]
        self.longest = float(self.norm[0]) if len(ids) else 0.0

    def candidates(self, q: np.ndarray, length: float, theta: float) -> np.ndarray | slice:
        """Which vectors can reach a product of ``theta`` with the query."""
        if theta <= 0 or not length:
            return slice(None)
        cosine = theta / (length * self.longest) if self.longest else np.inf
        if cosine > 1 + 1e-9:
            return slice(0, 0)
        cut = int(np.searchsorted(-self.norm, -(theta / length) * (1 - 1e-12), side="right"))
        if cosine < 0.5 or cut < 64:  # bounds on coordinates would hold nearly all
            return slice(0, cut)
        # a unit vector with that cosine to the query has each coordinate within t*q -+ sqrt((1-t^2)(1-q^2))
        u = q / length
        ok = np.ones(cut, bool)
        for f in np.argsort(-np.abs(u))[:FOCUS]:
            middle, reach = cosine * u[f], np.sqrt(max(0.0, (1 - cosine ** 2) * (1 - u[f] ** 2))) + 1e-9
            low = middle - reach if u[f] > -cosine else -1.0
            high = middle + reach if u[f] < cosine else 1.0
            x = self.unit[:cut, f]
            ok &= (x >= low) & (x <= high)
        return np.flatnonzero(ok)

    def best(self, qid: int, q: np.ndarray, k: int, theta: float) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, products)`` of the k best that reach ``theta``, ties to the
        smaller id."""
        at = self.candidates(q, float(np.sqrt(q @ q)), theta)
        ids, s = self.ids[at], self.v[at] @ q
        ok = (ids != qid) & (s >= theta)
        ids, s = ids[ok], s[ok]
        if len(ids) > k:  # all that tie with the k-th stay in the sort
            least = -np.partition(-s, k - 1)[k - 1]
            ids, s = ids[s >= least], s[s >= least]
        order = np.lexsort((ids, -s))[:k]
        return ids[order], s[order]


def top_k(df: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64,
          is_query=None, bucket_rows: int = 4096, query_rows: int = 4096) -> DataFrame:
    """``query_id long, rank int, vec_id long, score long``: for each query
    vector the ``k`` others of largest inner product (all if there are fewer),
    ranked from 1, ties to the smaller id.

    Components become floor(scale * x). Queries are the rows whose id
    ``is_query`` (Column to Column; default: all) selects; candidates are all rows but those
    of the query's own id. The vectors are sorted by length into buckets of
    about ``bucket_rows``, the queries dealt into blocks of about
    ``query_rows``; each pair of a block and a bucket is a bounded task group
    that returns at most ``k`` rows a query. Null ids and vectors, and vectors
    with null or non-finite components take no part; vectors of different
    lengths are compared with their own length only. Repeated rows of a
    candidate id count once for each copy; a repeated query id with different
    vectors is ranked by its largest products. An empty table gives an empty
    result; other columns are not read."""
    rows = stage(floor_vectors(df, id_col, vector_col, scale).withColumn("dim", F.size("v")), "vectors")
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    # sorted by length in parts of whatever size; as many neighbouring parts as hold bucket_rows rows are a bucket
    dealt = rows.repartitionByRange(buckets, F.desc("norm2"), F.col("id")).withColumn("part", F.spark_partition_id())
    dealt = stage(dealt, "dealt")
    parts = dealt.groupBy("dim", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("dim").orderBy("part")) - F.col("n")
    parts = parts.select("dim", "part", F.floor(before / bucket_rows).cast("int").alias("bucket"))
    dealt = stage(dealt.join(parts, ["dim", "part"]).drop("part"), "dealt")
    queries = rows.where(is_query(F.col("id")) if is_query else F.lit(True)).select(
        F.col("id").alias("qid"), F.col("v").alias("qv"), "dim", F.xxhash64("id", "v").alias("twin")).dropDuplicates(["qid", "twin"])
    blocks = max(1, -(-queries.count() // query_rows))
    queries = stage(queries.withColumn("block", F.pmod(F.xxhash64("twin"), F.lit(blocks)).cast("int")), "queries")
    names = "query_id long, twin long, vec_id long, score long"

    def search(use_theta: bool):
        def run(table: pa.Table) -> pa.Table:
            side = table.column("side").to_numpy()
            ids, theta = table.column("id").to_numpy(), table.column("theta").to_numpy()
            twin = table.column("twin").to_numpy()
            v = np.array(table.column("v").combine_chunks().flatten()).reshape(len(ids), -1) if len(ids) else np.empty((0, 1))
            c, q = side == 0, np.flatnonzero(side == 1)
            out = []
            if c.any():
                bucket = Bucket(ids[c], v[c])
                for i in q:
                    got, s = bucket.best(ids[i], v[i].astype(np.float64), k, float(theta[i]) if use_theta else -np.inf)
                    out.append((np.full(len(got), ids[i]), np.full(len(got), twin[i]), got, s))
            cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0)] * 4
            return pa.table([pa.array(x.astype(np.int64)) for x in cols], ["query_id", "twin", "vec_id", "score"])
        return run

    none = F.lit(None).cast("double")

    def meet(candidates: DataFrame, asked: DataFrame, use_theta: bool) -> DataFrame:
        """The best of each query in each bucket of ``candidates``."""
        parts = candidates.select("dim", "bucket").distinct()
        lists = asked.select("dim", "block").distinct().join(parts, "dim")
        c = candidates.join(lists, ["dim", "bucket"]).select(
            "dim", "bucket", "block", F.lit(0).alias("side"), "id", F.lit(0).cast("long").alias("twin"), "v", none.alias("theta"))
        q = asked.join(lists, ["dim", "block"]).select(
            "dim", "bucket", "block", F.lit(1).alias("side"), F.col("qid").alias("id"), "twin", F.col("qv").alias("v"), "theta")
        return c.unionByName(q).groupBy("dim", "bucket", "block").applyInArrow(search(use_theta), names)

    best = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    front = dealt.groupBy("dim").agg(F.min("bucket").alias("bucket"))
    head = dealt.join(front, ["dim", "bucket"], "left_semi")
    first = stage(meet(head, queries.withColumn("theta", none), False), "first")
    theta = first.groupBy("query_id", "twin").agg(F.count("*").alias("n"), F.min("score").alias("least")) \
        .select(F.col("query_id").alias("qid"), "twin", F.when(F.col("n") >= k, F.col("least")).cast("double").alias("theta"))
    asked = queries.join(theta, ["qid", "twin"], "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))
    rest = dealt.join(front, ["dim", "bucket"], "left_anti")
    merged = first.union(meet(rest, asked, True)).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
