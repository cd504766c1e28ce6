"""Hard-negative mining with a GNAT-style multiway hyperplane tree.

A node of the tree has several split points; a vector belongs to the nearest
one, so that the space is cut by the hyperplanes between them. For every
split point and every sibling subtree the node stores the range of distances
from the one to the other's vectors, taken over all rows. The rows that an
anchor asks for, those whose product lies in a window, lie in an annulus
around it; a sibling goes where some split point's stored range does not meet
the range that the annulus allows. In the leaves that remain the products are
taken exactly.

The split points come from a bounded sample; every row is dealt to a leaf.
Leaves are cut into parts of bounded size, so that copies of one vector, which
no hyperplane separates, fill parts and not one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Shared
from .common import stage

SLACK = 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` from those of ``b``."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


class Tree:
    """Split points in ``levels`` levels of at most ``ways`` each; a leaf is
    the path of the split points that a vector is nearest to."""

    def __init__(self, sample: np.ndarray, ways: int, levels: int):
        self.ways, self.levels = ways, levels
        self.points: dict[int, np.ndarray] = {}  # by the path of their node
        self._grow(0, np.unique(sample, axis=0), levels)
        # by node and split point: least and largest distance to each sibling's rows, and the norms there
        self.ranges: dict[int, np.ndarray] = {}

    def _grow(self, node: int, rows: np.ndarray, levels: int) -> None:
        if not levels or len(rows) <= self.ways:
            return
        picked = [int(np.argmax((rows * rows).sum(1)))]  # each split point is far from those before
        far = _distances(rows, rows[picked])[:, 0]
        while len(picked) < self.ways and far.max() > 0:
            picked.append(int(np.argmax(far)))
            far = np.minimum(far, _distances(rows, rows[picked[-1:]])[:, 0])
        self.points[node] = rows[picked]
        near = np.argmin(_distances(rows, rows[picked]), 1)
        for k in range(len(picked)):
            self._grow(self.child(node, k), rows[near == k], levels - 1)

    def child(self, node: int, k: int) -> int:
        return node * (self.ways + 1) + k + 1

    def deal(self, v: np.ndarray, see=None) -> np.ndarray:
        """The leaf of each vector; ``see(node, distances, near)`` is told of
        each node that vectors pass."""
        at = np.zeros(len(v), np.int64)
        for _ in range(self.levels):
            moved = at.copy()
            for node in np.unique(at).tolist():
                points = self.points.get(node)
                if points is None:
                    continue
                here = np.flatnonzero(at == node)
                d = _distances(v[here], points)
                near = np.argmin(d, 1)
                if see:
                    see(node, v[here], d, near)
                moved[here] = self.child(node, 0) + near
            at = moved
        return at

    def leaves(self, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row of a, leaf)`` for the leaves that can hold a vector whose
        product with the row lies within ``low`` and ``high``."""
        got: list = []

        def visit(node: int, rows: np.ndarray):
            points = self.points.get(node)
            if points is None:
                got.append((rows, np.full(len(rows), node, np.int64)))
                return
            d = _distances(a[rows], points)
            norm2 = (a[rows] ** 2).sum(1)
            for k in range(len(points)):
                least, most, short, long = self.ranges[node][:, k].T  # from every split point to this subtree
                if not np.isfinite(least[0]):
                    continue  # no row is there
                # squared distance from the anchor: |a|^2 + |x|^2 - 2 a.x
                inner = np.sqrt(np.maximum(norm2 + short[0] - 2 * high[rows], 0.0)) * (1 - SLACK) - SLACK
                outer2 = norm2 + long[0] - 2 * low[rows]
                outer = np.sqrt(np.maximum(outer2, 0.0)) * (1 + SLACK) + SLACK
                # by Cauchy and Schwarz no product is beyond these
                reach = np.sqrt(norm2 * long[0]) * (1 + SLACK) + SLACK
                ok = (outer2 >= -SLACK * (norm2 + long[0])) & (low[rows] <= reach) & (high[rows] >= -reach) & (low[rows] <= high[rows])
                nearest = np.maximum(d - outer[:, None], inner[:, None] - d)
                ok &= (nearest <= most + SLACK * (1 + most)).all(1) & (d + outer[:, None] >= least - SLACK * (1 + least)).all(1)
                if ok.any():
                    visit(self.child(node, k), rows[ok])

        visit(0, np.arange(len(a)))
        if not got:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def _matrix(column) -> np.ndarray:
    n = len(column)
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten())
    return flat.reshape(n, -1).astype(np.float64) if n else np.empty((0, 1))


def _slices(batches, rows: int = 2048):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _vectors(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """``row, id, label, v``: whole components of the rows that take part,
    numbered, all as long as the longest (zeros fill them up)."""
    raw = F.col("x")
    ok = raw.isNotNull() & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    table = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"),
                      F.col(f"`{vector_col}`").cast("array<double>").alias("x")) \
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & ok) \
        .select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))
    table = stage(table, "vectors")  # the numbers stay as they were written
    low, high = table.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high or high == 0:
        fill = F.array_repeat(F.lit(0).cast("long"), F.lit(max(high or 1, 1)) - F.size("v"))
        table = table.withColumn("v", F.concat("v", fill))
    return table


def _plant(rows: DataFrame, total: int, ways: int, levels: int, sample: int) -> Tree:
    """A tree over a sample of about ``sample`` rows, chosen by the hash of
    their number."""
    part = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(min(1.0, sample / max(total, 1)) * (1 << 30))
    picked = rows.where(part).select("v").limit(2 * sample).collect()
    if not picked:
        picked = rows.select("v").limit(sample).collect()
    return Tree(np.array([r["v"] for r in picked], np.float64), ways, levels)


def _deal(rows: DataFrame, tree: Tree) -> DataFrame:
    share = Shared(rows.sparkSession, tree)
    names = ["row", "id", "label", "v", "leaf"]

    def run(batches):
        for b in _slices(batches):
            leaf = share.get().deal(_matrix(b.column(3)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(leaf)], names)

    return rows.select(*names[:4]).mapInArrow(run, "row long, id long, label string, v array<long>, leaf long")


def _ranges(dealt: DataFrame, tree: Tree) -> None:
    """Fill the tree's ranges from all rows: each task keeps one cell for a
    split point and a sibling, cells meet in a grouped minimum and maximum."""
    share = Shared(dealt.sparkSession, tree)

    def run(batches):
        cells: dict = {}

        def see(node, v, d, near):
            norm2 = (v * v).sum(1)
            m = d.shape[1]
            cell = cells.setdefault(node, np.stack([np.full((m, m), np.inf), np.full((m, m), -np.inf)] * 2, 2))
            for k in np.unique(near):
                here = near == k
                cell[:, k, 0] = np.minimum(cell[:, k, 0], d[here].min(0))
                cell[:, k, 1] = np.maximum(cell[:, k, 1], d[here].max(0))
                cell[:, k, 2] = np.minimum(cell[:, k, 2], norm2[here].min())
                cell[:, k, 3] = np.maximum(cell[:, k, 3], norm2[here].max())

        for b in _slices(batches):
            share.get().deal(_matrix(b.column(0)), see)
        out = [(node, i, k, *map(float, c[i, k])) for node, c in cells.items()
               for i in range(c.shape[0]) for k in range(c.shape[1]) if np.isfinite(c[i, k, 0])]
        cols = list(zip(*out)) or [()] * 7
        kinds = [pa.int64()] * 3 + [pa.float64()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], list("nikabcd"))

    cells = dealt.select("v").mapInArrow(run, "n long, i long, k long, a double, b double, c double, d double") \
        .groupBy("n", "i", "k").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c"), F.max("d").alias("d"))
    for node, points in tree.points.items():
        m = len(points)
        tree.ranges[node] = np.stack([np.full((m, m), np.inf), np.full((m, m), -np.inf)] * 2, 2)
    for r in cells.collect():  # as many cells as the tree has pairs of siblings
        tree.ranges[r["n"]][r["i"], r["k"]] = r["a"], r["b"], r["c"], r["d"]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(score) > k:
        at = np.flatnonzero(score >= -np.partition(-score, k - 1)[k - 1])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _reach(asked: DataFrame, tree: Tree) -> DataFrame:
    """``asked`` once for each leaf, besides its own, that can hold a row of
    any of its windows."""
    share = Shared(asked.sparkSession, tree)
    names = [*asked.columns, "leaf"]
    lo, hi = F.array_min(F.transform("wanted", lambda w: w["low"])), F.array_max(F.transform("wanted", lambda w: w["high"]))
    v, own = asked.columns.index("av"), asked.columns.index("own")

    def run(batches):
        for b in _slices(batches):
            low, high = (b.column(len(names) - 1 + i).to_numpy() for i in (0, 1))
            at, leaf = share.get().leaves(_matrix(b.column(v)), low, high)
            other = leaf != b.column(own).to_numpy()[at]
            part = pa.RecordBatch.from_arrays(b.columns[:len(names) - 1], names[:-1]).take(pa.array(at[other]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf[other])], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema) + ", leaf long"
    return asked.select("*", lo.alias("_low"), hi.alias("_high")).mapInArrow(run, schema)


def _meet(rows: DataFrame, asked: DataFrame, parts: DataFrame, same: bool, k: int) -> DataFrame:
    """Exact products of the anchors in ``asked`` (each names a ``leaf``) with
    that leaf's rows: ``akey, aid, which, id, score`` of the k best of every
    window in every part, among the rows of the anchor's label or (not
    ``same``) of other labels. A group holds the rows of one part and the
    anchors of one block."""
    names = ["akey", "aid", "which", "id", "score"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, label = left["id"].to_numpy(), np.array(left["label"].to_pylist())
        out: list = []
        if left.num_rows and right.num_rows:
            v, a = _matrix(left["v"]), _matrix(right["av"])
            akey, aid, alabel = right["akey"].to_pylist(), right["aid"].to_pylist(), right["alabel"].to_pylist()
            wanted = right["wanted"].to_pylist()
            for at in range(0, len(a), 256):
                scores = a[at:at + 256] @ v.T
                for i in range(at, min(at + 256, len(a))):
                    s = scores[i - at]
                    fit = ((label == alabel[i]) == same) & (ids != aid[i])
                    fit &= (s >= min(w["low"] for w in wanted[i])) & (s <= max(w["high"] for w in wanted[i]))
                    here = np.flatnonzero(fit)
                    for w in wanted[i]:
                        at_w = here[(s[here] >= w["low"]) & (s[here] <= w["high"])]
                        at_w = at_w[_best(s[at_w], ids[at_w], k)]
                        out += [(akey[i], aid[i], w["which"], int(ids[j]), int(s[j])) for j in at_w]
        cols = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    asked = asked.join(F.broadcast(parts), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # rows go only where anchors ask for them
    left = rows.join(asked.select("leaf", "block").distinct(), "leaf").select(
        F.col("leaf").alias("l"), F.col("part").alias("p"), F.col("block").alias("b"), "id", "label", "v")
    right = asked.select("leaf", "part", "block", "akey", "aid", "alabel", "av", "wanted")
    return left.groupBy("l", "p", "b").cogroup(right.groupBy("leaf", "part", "block")) \
        .applyInArrow(work, "akey long, aid long, which int, id long, score long")


def mine(df: DataFrame, is_anchor, scale: int = 256, positives: int = 5, negatives: int = 5, share: int = 80,
         id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         ways: int = 16, levels: int = 3, sample: int = 8192, part_rows: int = 4096, block_rows: int = 2048) -> DataFrame:
    """``anchor_id long, positive_id long, rank int, negative_id long,
    positive_score long, negative_score long``.

    Components become floor(scale * x); a score is the integer product with
    the anchor, larger first, ties to the smaller id. An anchor (a row whose
    id ``is_anchor``, Column to Column, selects) has as positives its first
    ``positives`` other rows of its label; for each, the first ``negatives``
    rows of other labels with share/100 * positive_score <= score <=
    positive_score come out, ranked from 1.

    Rows with a null id, label or vector, or null or non-finite components
    take no part; shorter vectors count as filled up with zeros. Copies of a
    row count once for each copy, but rows of the anchor's own id never; of
    equal anchor rows one asks, and rows of one id that differ ask each for
    themselves. An empty table gives an empty result; other columns are not
    read. ``sample`` bounds the rows that the tree is planted from, and
    ``part_rows`` and ``block_rows`` what one task group holds of either side;
    every row is dealt to a leaf, and no candidate is cut off."""
    rows = _vectors(df, id_col, label_col, vector_col, scale)
    total = rows.count()
    if not total:
        return df.sparkSession.createDataFrame([], OUT)
    depth = 1
    while depth < levels and ways ** depth * part_rows < total:
        depth += 1
    tree = _plant(rows, total, ways, depth, sample)
    dealt = stage(_deal(rows, tree), "dealt")
    _ranges(dealt, tree)
    parts = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))  # a row for each leaf
    dealt = dealt.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int")).drop("parts")
    anchors = dealt.where(is_anchor(F.col("id"))).groupBy("id", "label", "v") \
        .agg(F.min(F.struct("row", "leaf")).alias("r")) \
        .select(F.col("r.row").alias("akey"), F.col("id").alias("aid"), F.col("label").alias("alabel"), F.col("v").alias("av"),
                F.col("r.leaf").alias("own"))
    anchors = stage(anchors, "anchors")
    blocks = max(1, -(-anchors.count() // block_rows))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("akey"), F.lit(blocks)).cast("int"))

    def first(frame: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
        return frame.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # positives: the anchor's own leaf sets a least score, the leaves that can reach it give the rest
    ask = anchors.withColumn("wanted", F.array(F.struct(
        F.lit(0).alias("which"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))))
    near = stage(_meet(dealt, ask.withColumn("leaf", F.col("own")), parts, True, positives), "near")
    best = first(near, ["akey"], positives).groupBy("akey").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    low = F.when(F.col("n") >= positives, F.col("least")).otherwise(F.lit(float("-inf"))).cast("double")
    ask = anchors.join(best, "akey", "left").select(*anchors.columns, F.array(F.struct(
        F.lit(0).alias("which"), low.alias("low"), F.lit(float("inf")).alias("high"))).alias("wanted"))
    far = _meet(dealt, _reach(ask, tree), parts, True, positives)
    found = stage(first(near.unionByName(far), ["akey"], positives).select(
        "akey", F.col("rank").alias("which"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # negatives: a window for each positive, narrowed by what the anchor's own leaf holds
    window = found.where("positive_score >= 0").select("akey", "which", F.col("positive_score").cast("double").alias("high"),
                                                      F.ceil(F.col("positive_score") * share / 100).cast("double").alias("low"))

    def asking(w: DataFrame) -> DataFrame:
        listed = w.groupBy("akey").agg(F.sort_array(F.collect_list(F.struct("which", "low", "high"))).alias("wanted"))
        return anchors.join(listed, "akey").select(*anchors.columns, "wanted")

    near = stage(_meet(dealt, asking(window).withColumn("leaf", F.col("own")), parts, False, negatives), "near")
    best = first(near, ["akey", "which"], negatives).groupBy("akey", "which") \
        .agg(F.count("*").alias("n"), F.min("score").alias("least"))
    narrowed = window.join(best, ["akey", "which"], "left").select(
        "akey", "which", "high", F.when(F.col("n") >= negatives, F.col("least").cast("double")).otherwise(F.col("low")).alias("low"))
    far = _meet(dealt, _reach(asking(narrowed), tree), parts, False, negatives)
    chosen = first(near.unionByName(far), ["akey", "which"], negatives)
    return chosen.join(found, ["akey", "which"]).select(
        F.col("aid").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
