"""Tree models M5-M9 over grouped cells.

Every tree feature is a code of a small domain (quantity step, weeks, rush,
part, material, process, estimator, flags), so quotes with equal features form
a cell: a long key with a row count and target sums. Squared-error splits and
leaf values depend on nothing else, and the number of cells is bounded by the
product of the domains, not by the rows. One aggregate makes the cells; then
each (model, training fold) is one group of one job that grows its trees from
histograms. Spark ML's boosting runs about five jobs a tree and fit; here all
fits of all models are one job.

The result is a node table (model, part, fold, tree, node, feature,
threshold, left, right, value, cover). Scoring, leaf counts and attribution
read that table alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.features import feature_names, label_code
from ..session import Shared

#: The fold number that stands for a fit on all rows.
ALL = S.N_FOLDS
FEATURES = feature_names("label", True)
QUANTITY_STEP = float(np.log(2) / 8)
#: The boosted models' shares of cells and of features a tree, parameters of the models as in the reference.
SUBSAMPLE = COLSAMPLE = 0.8

#: model: family, trees, depth, learning rate, least rows a leaf, L2, log target, dropped features, one fit an estimator
SPECS = {
    "M5": ("forest", 200, 6, 1.0, 5, 0.0, False, (), False),
    "M6": ("boost", 200, 4, 0.05, 5, 1.0, False, (), False),
    "M6b": ("boost", 200, 4, 0.05, 5, 1.0, False, ("lead_time_weeks",), False),
    "M7": ("boost", 200, 4, 0.05, 5, 1.0, True, (), False),
    "M7b": ("boost", 200, 4, 0.05, 10, 0.0, False, (), False),
    "M7c": ("boost", 200, 4, 0.05, 10, 0.0, True, (), False),
    "M8": ("boost", 200, 4, 0.05, 5, 1.0, False, ("estimator",), True),
    "M9": ("boost", 200, 4, 0.05, 5, 1.0, False, ("estimator",), False),
}
MODELS = list(SPECS)
CODES = S.LABEL_CATEGORIES
NODE_SCHEMA = ("model string, part int, fold int, tree int, node int, feature string, threshold double, left int, right int, "
               "value double, cover double")


# --------------------------------------------------------------- cells ----
def _width(name: str) -> int:
    return {"quantity": 6, "lead": 6, "rush": 1, "complexity": 6}.get(name, 5 if name in CODES else 1)


FIELDS = ["quantity", "lead", "rush", *CODES, *S.COMPLEXITY_FLAGS, "complexity"]
#: Bits of a key below the estimator's.
ESTIMATOR_BITS = sum(_width(f) for f in FIELDS[FIELDS.index("estimator") + 1:])


def cell_key() -> Column:
    """The features of a quote as one long. Quantities are coded by steps of
    an eighth of their binary logarithm, weeks and quantities beyond 63 steps
    by the last one; unseen or missing levels have a code of their own."""
    codes = {"quantity": F.round(8 * F.log2(F.greatest(F.col("quantity").cast("double"), F.lit(1.0)))),
             "lead": F.col("lead_time_weeks"), "rush": F.col("rush_job"), "complexity": F.col("complexity_score")}
    codes |= {c: label_code(c, CODES[c]) + 1 for c in CODES}
    key = F.lit(0).cast("long")
    for f in FIELDS:
        c = F.coalesce((codes[f] if f in codes else F.col(f)).cast("long"), F.lit(0))
        key = F.shiftleft(key, _width(f)) + F.greatest(F.lit(0), F.least(c, F.lit((1 << _width(f)) - 1)))
    return key


def unpack(keys: np.ndarray) -> np.ndarray:
    """The label-encoded feature matrix of cell keys, columns as FEATURES."""
    rest, got = keys.astype(np.int64), {}
    for f in reversed(FIELDS):
        got[f] = (rest & ((1 << _width(f)) - 1)).astype(np.float32)
        rest = rest >> _width(f)
    tiers = {}
    for c, tier in (("material", S.MATERIAL_COST_TIER), ("process", S.PROCESS_PRECISION_TIER)):
        by_code = np.array([S.DEFAULT_TIER, *[float(tier.get(x, S.DEFAULT_TIER)) for x in CODES[c]]] + [S.DEFAULT_TIER] * 32, np.float32)
        tiers[c] = by_code[got[c].astype(int)]
    cols = {"log_quantity": got["quantity"] * np.float32(QUANTITY_STEP), "rush_job": got["rush"], "lead_time_weeks": got["lead"],
            "missing_material": (got["material"] == 0).astype(np.float32), "missing_process": (got["process"] == 0).astype(np.float32),
            "material_cost_tier": tiers["material"], "process_precision_tier": tiers["process"],
            "complexity_score": got["complexity"]}
    cols |= {f: got[f] for f in S.COMPLEXITY_FLAGS} | {c: got[c] - 1 for c in CODES}
    return np.stack([cols[f] for f in FEATURES], 1) if len(keys) else np.empty((0, len(FEATURES)), np.float32)


def cells(q: DataFrame) -> DataFrame:
    """``fold, estimator_code, key, n, y, ly, ly2`` of each distinct feature
    combination and fold: map-side sums."""
    price = F.col("total_price_usd")
    estimator = F.shiftright("key", ESTIMATOR_BITS).bitwiseAND(F.lit((1 << _width("estimator")) - 1)).cast("int") - 1
    return q.where(price > 0).groupBy("fold", cell_key().alias("key")) \
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(price).alias("y"), F.sum(F.log(price)).alias("ly"),
             F.sum(F.log(price) ** 2).alias("ly2")).select("fold", estimator.alias("estimator_code"), "key", "n", "y", "ly", "ly2")


# ------------------------------------------------------------ training ----
#: The lowest bit of each 16-bit word, 0 for none.
FIRST_BIT = np.zeros(1 << 16, np.uint8)
for _b in range(15, -1, -1):
    FIRST_BIT[1 << _b::2 << _b] = _b
#: Patterns of features that one table of leaf masks holds.
PATTERNS = 4096


def patterns(codes: list[np.ndarray], sizes: list[int]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """Columns of small codes put together: groups ``(columns, representative
    rows, each row's place among them)`` whose combinations are few."""
    groups, members = [], []

    def close():
        first = np.zeros(many, np.int64)
        first[at] = np.arange(len(at))
        groups.append((members, first, at))

    for i, (c, size) in enumerate(zip(codes, sizes)):
        if members:
            both = at * size + c
            there = np.bincount(both, minlength=many * size) > 0
            if int(there.sum()) <= PATTERNS:
                at, many = (np.cumsum(there) - 1)[both], int(there.sum())
                members.append(i)
                continue
            close()
        members, at, many = [i], c.astype(np.int64), size
    if members:
        close()
    return groups


def terminal(feature: np.ndarray, depth: int) -> np.ndarray:
    """The node in which each of the ``2 ** depth`` places below a tree in heap
    order ends; ``feature`` may hold a row a tree."""
    at = np.zeros((*feature.shape[:-1], 1 << depth), np.int64)
    for d in range(depth):
        inner = np.take_along_axis(feature, at, -1) >= 0
        right = np.arange(1 << depth) >> (depth - 1 - d) & 1
        at = np.where(inner, 2 * at + 1 + right, at)
    return at


def left_places(node: np.ndarray, depth: int) -> np.ndarray:
    """The places below each node's left child, as bits."""
    d = np.floor(np.log2(node + 1)).astype(np.int64)
    span = np.left_shift(np.int64(1), np.maximum(depth - d - 1, 0)).astype(np.uint64)
    start = ((node + 1 - (np.int64(1) << d)).astype(np.uint64)) * span * np.uint64(2)
    return ((np.uint64(1) << span) - np.uint64(1)) << start


class Grower:
    """Histogram trees over cells: rows of codes with weights and target sums.
    Features are put together into groups of few patterns; a level of a tree
    sums up its cells by pattern and node, and what lies on the left of each
    cut follows from the patterns. A tree sees all its cells; its cost grows
    with their number, and beyond them it holds a few tables of patterns."""

    def __init__(self, x: np.ndarray, dropped: tuple, rng: np.random.Generator):
        columns = np.ascontiguousarray(x.T)
        self.used = [i for i, f in enumerate(FEATURES) if f not in dropped and len(x) and (columns[i] != columns[i, 0]).any()]
        self.cuts, codes = [], []
        for i in self.used:
            values = np.sort(pd.unique(columns[i]))
            self.cuts.append((values[1:] + values[:-1]) / 2)
            codes.append(np.searchsorted(values, columns[i]).astype(np.uint8))
        self.rows = len(x)
        self.codes = np.stack(codes) if codes else np.zeros((0, self.rows), np.uint8)
        self.first = np.cumsum([0] + [len(c) + 1 for c in self.cuts])
        self.rng = rng
        self.groups = patterns(list(self.codes), [len(c) + 1 for c in self.cuts])
        #: Feature and place of every cut, and for each group which patterns lie on the left of its features' cuts.
        self.cut_feature = np.repeat(np.arange(len(self.cuts)), [len(c) for c in self.cuts])
        self.cut_place = np.concatenate([np.arange(len(c)) for c in self.cuts]) if self.cuts else np.zeros(0, np.int64)
        self.below = [np.concatenate([self.codes[k][first][None] <= np.arange(len(self.cuts[k]))[:, None] for k in members]).astype(np.float64)
                      for members, first, _ in self.groups]

    def marks(self, part: slice) -> np.ndarray:
        """The codes of some cells as columns of 0 and 1."""
        hot = np.empty((len(range(*part.indices(self.rows))), int(self.first[-1])), np.float32)
        for members, first, at in self.groups:
            low, high = self.first[members[0]], self.first[members[-1] + 1]
            table = np.zeros((len(first), high - low), np.float32)
            for k in members:
                table[np.arange(len(first)), self.first[k] - low + self.codes[k][first]] = 1.0
            hot[:, low:high] = table[at[part]]
        return hot

    def tree(self, r: np.ndarray, w: np.ndarray, depth: int, least: float, l2: float, columns: np.ndarray, part: slice):
        """One tree on the cells of ``part`` for target sums ``r`` of weight
        ``w``: ``(feature, cut, value, cover)`` by heap place."""
        n_nodes = (1 << depth + 1) - 1
        feature, cut = np.full(n_nodes, -1, np.int32), np.zeros(n_nodes, np.int32)
        g_all, n_all = np.zeros(n_nodes), np.zeros(n_nodes)
        r, w = r[part], w[part]
        g_all[0], n_all[0] = r.sum(), w.sum()
        patterns_of = [at[part] for _, _, at in self.groups]
        barred = ~np.isin(self.cut_feature, columns)
        live = np.ones(1, bool)
        node = np.zeros(len(r), np.int64)  # of a level; below a leaf all cells go on to the left
        for d in range(depth if len(self.codes) and len(r) else 0):
            low, many = (1 << d) - 1, 1 << d
            left = np.empty((len(self.cut_feature), 2 * many))
            a = 0
            for at, below in zip(patterns_of, self.below):
                size = below.shape[1]
                where = at * many + node if d else at
                sums = np.concatenate([np.bincount(where, v, size * many).reshape(size, many) for v in (r, w)], 1)
                left[a:a + len(below)] = below @ sums
                a += len(below)
            g, n = g_all[low:low + many], n_all[low:low + many]
            gl, nl = left[:, :many], left[:, many:]
            gr, nr = g - gl, n - nl
            gain = gl * gl / np.maximum(nl + l2, 1e-12) + gr * gr / np.maximum(nr + l2, 1e-12) - g * g / np.maximum(n + l2, 1e-12)
            gain[(nl < least) | (nr < least)] = -np.inf
            gain[barred] = -np.inf
            best = gain.argmax(0)
            nodes = np.arange(many)
            live = live & (gain[best, nodes] > 1e-9 * (1.0 + float((g * g / np.maximum(n + l2, 1e-12))[live].sum())))
            if not live.any():
                break
            split = np.flatnonzero(live)
            feature[low + split], cut[low + split] = self.cut_feature[best[split]], self.cut_place[best[split]]
            down = 2 * low + 1
            g_all[down + 2 * split], n_all[down + 2 * split] = gl[best[split], split], nl[best[split], split]
            g_all[down + 2 * split + 1], n_all[down + 2 * split + 1] = gr[best[split], split], nr[best[split], split]
            right = None  # as bits: the nodes of which a cell would go to the right
            for (members, first, _), at in zip(self.groups, patterns_of):
                table = np.zeros(len(first), np.int64)
                for j in split:
                    if feature[low + j] in members:
                        table |= (self.codes[feature[low + j]][first] > cut[low + j]).astype(np.int64) << j
                if table.any():
                    right = table[at] if right is None else right | table[at]
            node = 2 * node + (right >> node & 1)
            live = np.repeat(live, 2)
        value = g_all / np.maximum(n_all + l2, 1e-12)
        return feature, cut, value, n_all

    def apply(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
        """The tree's value of every cell. A node that sends a cell to the
        right strikes out the places on its left; the first place left is the
        cell's leaf. What a group of features strikes out is tabulated."""
        if depth > 4:
            return self.walk(feature, cut, value, depth)
        inner = np.flatnonzero(feature[:(1 << depth) - 1] >= 0)
        gone = (~left_places(inner, depth)).astype(np.uint16)
        left = None
        for members, first, at in self.groups:
            table = np.full(len(first), 0xFFFF, np.uint16)
            for k in members:
                here = np.flatnonzero(feature[inner] == k)
                if len(here):
                    code = self.codes[k][first]
                    for j in here:
                        table[code > cut[inner[j]]] &= gone[j]
            if (table != 0xFFFF).any():
                got = table[at]
                left = got if left is None else left & got
        leaf = value[terminal(feature, depth)]
        if left is None:
            return np.full(self.rows, leaf[0])
        return leaf[np.minimum(FIRST_BIT, (1 << depth) - 1)][left]

    def walk(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
        at, ar = np.zeros(self.rows, np.int64), np.arange(self.rows)
        flat = self.codes.reshape(-1)
        for _ in range(depth):
            f = feature[at]
            leaf = f < 0
            if leaf.all():
                break
            go = flat[np.maximum(f, 0) * self.rows + ar] > cut[at]
            at = np.where(leaf, at, 2 * at + 1 + go)
        return value[at]

    def columns(self, share: float) -> np.ndarray:
        p = len(self.used)
        return np.sort(self.rng.permutation(p)[:max(1, round(share * p))]) if p and share < 1 else np.arange(p)


def grow(keys: np.ndarray, n: np.ndarray, s: np.ndarray, s2: np.ndarray, spec: tuple, seed: int):
    """Fit one model on all cells: ``(base, residual variance of a logarithm,
    trees, grower)``. Chance enters by the models' own parameters alone: a
    forest draws as many rows as there are with replacement, a boosted tree
    leaves out each cell with a chance of ``1 - SUBSAMPLE``."""
    family, trees, depth, eta, least, l2, log, dropped, _per = spec
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(keys)) if family == "forest" else slice(None)  # in which the cells' rows are drawn
    g = Grower(unpack(keys), dropped, rng)
    total, in_order, w = n.sum(), n[order], np.empty(len(keys))
    base = float(s.sum() / total) if family == "boost" else 0.0
    pred, out, every = np.full(len(keys), base), [], slice(0, len(keys))
    for _ in range(trees):
        if family == "forest":  # rows drawn with replacement: Poisson counts
            w[order] = rng.poisson(in_order)
            f, c, v, cover = g.tree(s * w / n, w, depth, least, l2, g.columns(1.0), every)
            v = v / trees
        else:
            drawn = rng.random(len(keys)) < SUBSAMPLE
            f, c, v, cover = g.tree((s - n * pred) * drawn, n * drawn, depth, least, l2, g.columns(COLSAMPLE), every)
            v = v * eta
        if family == "boost" or log:  # a forest's trees know nothing of each other; its error counts for the logarithm alone
            pred = pred + g.apply(f, c, v, depth)
        out.append((f, c, v, cover))
    var = float(max(0.0, (s2 - 2 * pred * s + n * pred * pred).sum() / total)) if log else 0.0
    return base, var, out, g


def _rows(model: str, part: int, fold: int, keys, n, s, s2) -> dict:
    spec = SPECS[model]
    s2 = s2 if spec[6] else np.zeros(len(s))
    seed = 42 + 1000 * MODELS.index(model) + 10 * part + fold
    base, var, trees, g = grow(keys, n, s, s2, spec, seed)
    cols: dict = {k: [] for k in ("tree", "node", "feature", "threshold", "left", "right", "value", "cover")}

    def add(*x):
        for c, v in zip(cols.values(), x):
            c.append(v)

    add(-1, 0, "__base__", var if spec[6] else 0.0, -1, -1, base, float(n.sum()))
    for t, (f, c, v, cover) in enumerate(trees):
        todo = [0]
        while todo:
            i = todo.pop()
            if f[i] >= 0:
                add(t, i, FEATURES[g.used[f[i]]], float(g.cuts[f[i]][c[i]]), 2 * i + 1, 2 * i + 2, float(v[i]), float(cover[i]))
                todo += [2 * i + 1, 2 * i + 2]
            else:
                add(t, i, None, None, -1, -1, float(v[i]), float(cover[i]))
    m = len(cols["tree"])
    return {"model": [model] * m, "part": [part] * m, "fold": [fold] * m} | cols


def fit_trees(q: DataFrame, models=None, folds=None, made: DataFrame | None = None) -> DataFrame:
    """The node table of the models for each training fold (rows whose fold
    is another) and, as fold ``ALL``, for all rows. A group holds one fit's
    cells, whose number the feature domains bound. ``made`` gives the quotes'
    ``cells`` if they are made already."""
    models = MODELS if models is None else list(models)
    folds = list(range(ALL + 1) if folds is None else folds)
    wanted = [(m, p, k) for m in sorted(models, key=lambda m: -SPECS[m][2]) for k in folds  # the longest come first
              for p in (range(len(CODES["estimator"])) if SPECS[m][8] else [-1])]
    which = q.sparkSession.createDataFrame([(i, m, p, k, SPECS[m][6]) for i, (m, p, k) in enumerate(wanted)],
                                           "slot int, model string, part int, fit int, log boolean")
    fits = _blocks(q, sorted({(p, k, SPECS[m][6]) for m, p, k in wanted}), made).join(F.broadcast(which), ["part", "fit", "log"])

    def train(table: pa.Table) -> pa.Table:
        key, n, s, s2 = (np.asarray(table.column(c).combine_chunks().flatten()) for c in ("key", "n", "s", "s2"))
        order = np.argsort(key)  # a key stands in one block
        model, part, fold = (table.column(x)[0].as_py() for x in ("model", "part", "fit"))
        return pa.table(_rows(model, part, fold, key[order], n[order], s[order], s2[order] if len(s2) else s2), schema=_ARROW)

    # as many tasks as fits, each with one: the shuffle's partition is the fit's number
    fits = fits.repartitionById(len(wanted), "slot")
    return fits.groupBy("slot").applyInArrow(train, NODE_SCHEMA)


#: Blocks of cells by their key: the bound of what is summed up at a time.
BLOCKS = 64


def _blocks(q: DataFrame, wanted: list[tuple[int, int, bool]], made: DataFrame | None = None) -> DataFrame:
    """The cells that the fits ``(estimator or -1, fold, whether of the
    logarithm)`` learn from, as lists: each fit's sums over the other folds are
    made once, whatever the number of models that share them."""
    schema = "part int, fit int, log boolean, key array<long>, n array<double>, s array<double>, s2 array<double>"
    types = pa.schema([("part", pa.int32()), ("fit", pa.int32()), ("log", pa.bool_()), ("key", pa.list_(pa.int64())),
                       *[(c, pa.list_(pa.float64())) for c in ("n", "s", "s2")]])

    def pack(table: pa.Table) -> pa.Table:
        fold, key, n, y, ly, ly2 = (table.column(c).to_numpy() for c in ("fold", "key", "n", "y", "ly", "ly2"))
        keys, at = np.unique(key, return_inverse=True)  # one cell can stand in several folds
        estimator = (keys >> ESTIMATOR_BITS & (1 << _width("estimator")) - 1) - 1
        out: dict = {c: [] for c in types.names}
        for part, fit, log in wanted:
            m = fold != fit
            total, *sums = (np.bincount(at[m], v[m], len(keys)) for v in (n, *((ly, ly2) if log else (y,))))
            here = (total > 0) & ((part < 0) | (estimator == part))
            if here.any():
                s, s2 = sums if log else (sums[0], None)
                for c, v in zip(out, (part, fit, log, keys[here], total[here], s[here], s2[here] if log else [])):
                    out[c].append(v)
        return pa.table(out, schema=types)

    return (cells(q) if made is None else made).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(BLOCKS))).groupBy("block").applyInArrow(pack, schema)


_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in NODE_SCHEMA.split(", ")])


# ------------------------------------------------------------- scoring ----
class Rows:
    """Rows by FEATURES with the patterns of their values, made once for all
    fits that score them."""

    def __init__(self, x: np.ndarray):
        self.x = x
        codes, sizes = [], []
        for c in np.ascontiguousarray(x.T):
            values = np.sort(pd.unique(c))
            codes.append(np.searchsorted(values, c))
            sizes.append(max(1, len(values)))
        self.groups = patterns(codes, sizes) if len(x) else []


class Forests:
    """The fits of a node table as arrays; picklable, for broadcasts."""

    def __init__(self, nodes: pd.DataFrame):
        self.fits: dict = {}
        index = {f: i for i, f in enumerate(FEATURES)}
        for (model, part, fold), rows in nodes.groupby(["model", "part", "fold"], sort=False):
            base = rows[rows["tree"] < 0].iloc[0]
            t = rows[rows["tree"] >= 0]
            many, wide = int(t["tree"].max()) + 1, int(t["node"].max()) + 1
            feature = np.full((many, wide), -1, np.int16)
            cut, value, cover = (np.zeros((many, wide), np.float32) for _ in range(3))
            i, j = t["tree"].to_numpy(), t["node"].to_numpy()
            feature[i, j] = t["feature"].map(index).fillna(-1).astype(int).to_numpy()
            cut[i, j] = t["threshold"].fillna(0.0).to_numpy()
            value[i, j], cover[i, j] = t["value"].to_numpy(), t["cover"].to_numpy()
            self.fits[(model, int(part), int(fold))] = (float(base["value"]), float(base["threshold"]), feature, cut,
                                                        value.astype(np.float64), cover.astype(np.float64))
        self.models = [m for m in MODELS if any(k[0] == m for k in self.fits)]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "struck"}

    def strikes(self, fit: tuple) -> tuple:
        """A fit's trees by what their nodes strike out (``Grower.apply``): each
        feature's cuts, and what the cuts below a value strike out of each tree."""
        known = self.__dict__.setdefault("struck", {})
        if fit not in known:
            _, _, feature, cut, value, _ = self.fits[fit]
            many, wide = feature.shape
            depth = wide.bit_length() - 1
            word = np.uint16 if depth <= 4 else np.uint64
            tree, node = np.nonzero(feature >= 0)
            gone = (~left_places(node, depth)).astype(word)
            split, at = feature[tree, node], cut[tree, node]
            by_feature = {}
            for f in np.unique(split):
                mine = np.flatnonzero(split == f)
                cuts, place = np.unique(at[mine], return_inverse=True)
                table = np.full((len(cuts) + 1, many), np.iinfo(word).max, word)
                np.bitwise_and.at(table, (place + 1, tree[mine]), gone[mine])
                by_feature[int(f)] = cuts, np.bitwise_and.accumulate(table, 0)
            padded = np.full((many, (1 << depth + 1) - 1), -1, feature.dtype)
            padded[:, :wide] = feature
            leaf = np.take_along_axis(value, terminal(padded, depth), 1)
            known[fit] = by_feature, leaf.ravel(), (np.arange(many) << depth)[None], depth
        return known[fit]

    def raw(self, fit: tuple, x: "np.ndarray | Rows") -> np.ndarray:
        """Base plus the trees' values, on the model's own scale."""
        rows = x if isinstance(x, Rows) else Rows(x)
        base, _, feature, *_ = self.fits[fit]
        out = np.full(len(rows.x), base)
        if feature.shape[1] > 127:  # deeper than a word has bits
            return self.walk(fit, rows.x)
        by_feature, leaf, tree, depth = self.strikes(fit)
        tables = []
        for members, first, at in rows.groups:
            table = None
            for f in members:
                if f in by_feature:
                    cuts, struck = by_feature[f]
                    one = struck[np.searchsorted(cuts, rows.x[first, f])]
                    table = one if table is None else table & one
            if table is not None:
                tables.append((table, at))
        for a in range(0, len(rows.x), 2048):
            left = None
            for table, at in tables:
                got = table[at[a:a + 2048]]
                left = got if left is None else np.bitwise_and(left, got, out=left)
            if left is None:
                out[a:a + 2048] += leaf[tree].sum(1)
                continue
            if depth <= 4:
                place = FIRST_BIT[left]
            else:  # the lowest bit alone is a power of two, which a double names exactly
                place = np.log2((left & (~left + np.uint64(1))).astype(np.float64)).astype(np.int64)
            out[a:a + 2048] += leaf[tree + place].sum(1)
        return out

    def walk(self, fit: tuple, x: np.ndarray) -> np.ndarray:
        """The same for trees of any depth, node by node."""
        base, _, feature, cut, value, _ = self.fits[fit]
        many, wide = feature.shape
        out = np.full(len(x), base)
        tree = (np.arange(many) * wide)[None]
        flat_f, flat_c, flat_v = feature.ravel(), cut.ravel(), value.ravel()
        for a in range(0, len(x), 2048):
            xs = x[a:a + 2048]
            row = (np.arange(len(xs)) * xs.shape[1])[:, None]
            flat_x, at = xs.ravel(), np.zeros((len(xs), many), np.int32)
            while True:
                f = flat_f[tree + at]
                live = f >= 0
                if not live.any():
                    break
                go = flat_x[row + np.maximum(f, 0)] > flat_c[tree + at]
                at = np.where(live, 2 * at + 1 + go, at)
            out[a:a + 2048] += flat_v[tree + at].sum(1)
        return out

    def predict(self, model: str, fold: int, x: "np.ndarray | Rows") -> np.ndarray:
        """Prices: clamped at 0, or back from the logarithm with half the
        residual variance."""
        spec = SPECS[model]
        x = x if isinstance(x, Rows) else Rows(x)

        def one(part):
            raw = self.raw((model, part, fold), x)
            return np.exp(raw + 0.5 * self.fits[(model, part, fold)][1]) if spec[6] else np.maximum(raw, 0.0)

        if not spec[8]:
            return one(-1)
        parts = sorted(p for m, p, k in self.fits if m == model and k == fold)
        each = {p: one(p) for p in parts}
        known = x.x[:, FEATURES.index("estimator")].astype(int)
        out = np.mean(list(each.values()), 0)  # an estimator that no fit knows gets the mean of all
        for p in parts:
            out = np.where(known == p, each[p], out)
        return out


def load_forests(nodes: DataFrame) -> Forests:
    """The node table on the driver: its size is set by the models' settings
    (fits x trees x nodes), not by the data."""
    return Forests(nodes.toArrow().to_pandas())


def tree_predictions(spark, forests: Forests, models: list[str]) -> "callable":
    """A column function ``(key, fold) -> struct of one price a model``;
    equal cells of a batch are scored once."""
    share = Shared(spark, forests)
    schema = ", ".join(f"`{m}` double" for m in models)

    @F.pandas_udf(schema)
    def predict(key: pd.Series, fold: pd.Series) -> pd.DataFrame:
        known = share.get()
        k, f = key.to_numpy(np.int64), fold.to_numpy(np.int64)
        out = np.zeros((len(k), len(models)))
        for one in np.unique(f):
            rows = np.flatnonzero(f == one)
            cell, at = np.unique(k[rows], return_inverse=True)
            x = Rows(unpack(cell))
            for j, m in enumerate(models):
                out[rows, j] = known.predict(m, int(one), x)[at]
        return pd.DataFrame(out, columns=models)

    return predict


def leaf_counts(nodes: DataFrame) -> DataFrame:
    """M19 for trees: leaves of each model and fold."""
    return nodes.where((F.col("tree") >= 0) & (F.col("left") < 0)).groupBy("model", "fold") \
        .agg(F.count(F.lit(1)).alias("effective_params"))
