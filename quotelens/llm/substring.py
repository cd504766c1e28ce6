"""Repeated passages across documents by collinear chaining.

Documents are cut into words; of every window of consecutive k-mers the one
with the smallest hash is a seed, so any run of ``WINDOW + K - 1`` words that
two documents share holds a common seed. A seed's occurrences are joined with
its first one (the hub), never with each other. The matches of a document with
each hub are chained: matches in the same order on both sides add up, gaps
cost, and a tree of maxima finds each match's best predecessor within reach. Chains are
aligned word by word and cut to their best passages."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHasher, drop_stage, mix64, partitions, small_batches, stage, window_hashes
from .near_dedup import words_of

K, WINDOW = 5, 9
CIRCLE = 50
ALIKE = 3  # of the four words before and the four behind, for a chain of a single match
NEW = 16  # words in a row without an explanation, from which a stretch is compared again
BITMAP = 1 << 24  # bits
GAP_COST = 0.1
MAX_GAP = 48
PAD = 96
MASK = (1 << 32) - 1
SHIFT = 32  # a place is the number of the id's text and, in the low bits, the word
SHORT = 8  # words: a longer difference weighs in full
RESYNC = sorted(((i, j) for i in range(SHORT + 1) for j in range(SHORT + 1) if i or j), key=lambda g: (max(g), abs(g[0] - g[1])))
RESYNC += [(i, i) for i in range(SHORT + 1, 2 * SHORT + 1)]


def seeds_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(positions, hashes)`` of the seeds of a word sequence. The n-th of
    the occurrences of a k-mer that follow each other in less than ``CIRCLE``
    words is hashed with n, so that a text that goes round in circles has no
    ties and matches turn by turn; one that comes back later starts anew, so
    that each copy of a passage has the hashes of the first."""
    h = window_hashes(ids, K)
    if not len(h):
        return np.empty(0, np.int64), h
    ordered = np.sort(h)
    if (ordered[1:] == ordered[:-1]).any():
        order = np.argsort(h, kind="stable")
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (np.diff(order) >= CIRCLE)]
        if not new.all():
            turn = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            h[order] = np.where(turn > 0, mix64(h[order] + turn.astype(np.uint64)), h[order])
    w = min(WINDOW, len(h))
    least = _sliding(h, w, np.minimum)  # of each window; a seed is the least of one of those that hold it
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(h == _sliding(np.r_[pad, least, pad], w, np.maximum))
    return at, h[at]


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """Minimum or maximum of every window of ``w``, by windows of powers of
    two."""
    k = 1
    while 2 * k <= w:
        x = pick(x[:-k], x[k:])
        k *= 2
    return pick(x[:len(x) - (w - k)], x[w - k:]) if w > k else x


def chains(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Collinear chains of matches ``(x, y)``, best first, each a list of
    match numbers; a match is in one chain at most.

    A chain's value is K words a match less ``GAP_COST`` a word stepped over
    on either side. As that cost is linear, the best predecessor of a match is
    the one to its lower left, ``MAX_GAP`` away at most on either side, with
    the largest value + cost * (x + y): a maximum over a range of y in a tree
    from which the matches go that x has left behind."""
    xs, ys = x.tolist(), y.tolist()
    order = np.lexsort((-y, x)).tolist()
    by_y = np.lexsort((x, y)).tolist()
    leaf_y, size = [ys[m] for m in by_y], len(by_y)
    leaf = [0] * size
    for i, m in enumerate(by_y):
        leaf[m] = i
    none = (-1e18, -1)
    tree: list[tuple] = [none] * (2 * size)

    def put(m: int, entry: tuple) -> None:
        at = leaf[m] + size
        tree[at] = entry
        while at > 1:
            at >>= 1
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    value, before, gone = [0.0] * size, [-1] * size, 0
    for m in order:
        while xs[m] - xs[order[gone]] > MAX_GAP:
            put(order[gone], none)
            gone += 1
        best, lo, hi = none, bisect_left(leaf_y, ys[m] - MAX_GAP) + size, bisect_left(leaf_y, ys[m]) + size
        while lo < hi:
            if lo & 1:
                best = max(best, tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = max(best, tree[hi])
            lo, hi = lo >> 1, hi >> 1
        gain, p = best[0] - GAP_COST * (xs[m] + ys[m]), best[1]
        if p >= 0 and gain > 0 and xs[p] < xs[m]:
            value[m], before[m] = K + gain, p
        else:
            value[m] = K
        put(m, (value[m] + GAP_COST * (xs[m] + ys[m]), m))
    used, found = [False] * len(xs), []
    for m in sorted(range(len(xs)), key=lambda m: (-value[m], xs[m], ys[m])):
        chain = []
        while m >= 0 and not used[m]:
            used[m] = True
            chain.append(m)
            m = before[m]
        if chain:
            found.append(chain[::-1])
    return found


def _grow(a: list, b: list, i: int, j: int, stops: list) -> list[tuple]:
    """Runs ``(i, j, length)`` of equal words from ``(i, j)`` on: over short
    differences after which three words agree again, and on to the next of
    ``stops`` (matches of the chain) where none does."""
    runs, n, m, k = [], len(a), len(b), 0
    while True:
        run = 0
        while i + run < n and j + run < m and a[i + run] == b[j + run]:
            run += 1
        if run:
            runs.append((i, j, run))
        i, j = i + run, j + run
        for di, dj in RESYNC:
            if a[i + di:i + di + 3] == b[j + dj:j + dj + 3] and i + di + 3 <= n and j + dj + 3 <= m:
                if di == dj:  # words replaced by as many: those between them may agree
                    runs += [(i + d, j + d, 1) for d in range(di) if a[i + d] == b[j + d]]
                i, j = i + di, j + dj
                break
        else:
            while k < len(stops) and (stops[k][0] < i or stops[k][1] < j):
                k += 1
            if k == len(stops):  # single words may still agree at the passage's end
                return runs + [(i + d, j + d, 1) for d in range(1, SHORT + 1) if i + d < n and j + d < m and a[i + d] == b[j + d]]
            i, j = stops[k]


def passages(a: list, b: list, anchors: list[tuple], min_words: int, similarity: float) -> list[tuple]:
    """``(start, length, other start, other length, equal words)`` of the
    chain's passages: stretches of its alignment in which ``similarity`` of
    the words are equal.

    The best stretch is taken first, with short differences at half the price
    at which a stretch at the limit is worth nothing, else at the full price;
    where neither gives a passage, the longest stretch within the limit is."""
    i, j = anchors[0]
    back = _grow(a[:i][::-1], b[:j][::-1], 0, 0, [])
    runs = [(i - p - n, j - q - n, n) for p, q, n in reversed(back)] + _grow(a, b, i, j, anchors[1:])
    gaps = [0] + [max(q[0] - p[0] - p[2], q[1] - p[1] - p[2]) for p, q in zip(runs, runs[1:])]
    price = similarity / (1 - similarity)
    out, todo = [], [(0, len(runs))]
    while todo:
        lo, hi = todo.pop()
        if hi <= lo or runs[hi - 1][0] + runs[hi - 1][2] - runs[lo][0] < min_words:
            continue
        for find in (lambda: _best(runs, gaps, lo, hi, price / 2, price), lambda: _best(runs, gaps, lo, hi, price, price),
                     lambda: _longest(runs, gaps, lo, hi, similarity)):
            s, e = find()
            first, last = runs[s], runs[e]
            na, nb = last[0] + last[2] - first[0], last[1] + last[2] - first[1]
            equal = sum(r[2] for r in runs[s:e + 1])
            if na >= min_words and equal >= similarity * max(na, nb) - 1e-9:
                out.append((first[0], na, first[1], nb, equal))
                todo += [(lo, s), (e + 1, hi)]
                break
    return out


def _best(runs: list, gaps: list, lo: int, hi: int, short: float, long: float) -> tuple[int, int]:
    """The first and last of the runs with the largest sum of equal words less
    the price of the words between."""
    best, total, start, span = 0.0, 0.0, lo, (lo, lo)
    for r in range(lo, hi):
        if r > lo:
            total -= gaps[r] * (short if gaps[r] <= SHORT else long)
        if total <= 0:
            total, start = 0.0, r
        total += runs[r][2]
        if total > best:
            best, span = total, (start, r)
    return span


def _longest(runs: list, gaps: list, lo: int, hi: int, similarity: float) -> tuple[int, int]:
    """The first and last of the longest stretch of runs with a share of
    ``similarity`` of equal words: what lies between two prefix sums of which
    the second isn't smaller."""
    starts, ends, total = [], [], 0.0
    for r in range(lo, hi):
        total -= gaps[r] * similarity if r > lo else 0
        starts.append(total)
        total += runs[r][2] * (1 - similarity)
        ends.append(total)
    lows: list[int] = []
    for k, v in enumerate(starts):
        if not lows or v < starts[lows[-1]]:
            lows.append(k)
    best, span = 0, (lo, lo)
    for e in range(len(ends) - 1, -1, -1):
        while lows and ends[e] >= starts[lows[-1]] - 1e-9:
            k = lows.pop()
            if k <= e and runs[lo + e][0] + runs[lo + e][2] - runs[lo + k][0] > best:
                best, span = runs[lo + e][0] + runs[lo + e][2] - runs[lo + k][0], (lo + k, lo + e)
    return span


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, v, text``: the rows with an id and a text; ``v`` numbers the
    different texts of one id (0 where there is one), by the place of their
    hash among those of the id."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")) \
        .where("doc is not null and text is not null")
    keyed = docs.select("doc", F.xxhash64("text").alias("t"))
    several = keyed.groupBy("doc").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("doc")
    several = stage(several, "several")
    if several.isEmpty():
        return docs.withColumn("v", F.lit(0))
    # a number each, by a window over the different texts of one id
    place = F.row_number().over(Window.partitionBy("doc").orderBy("t")) - 1
    numbers = stage(keyed.join(several, "doc").distinct().withColumn("v", place), "numbers")
    j = docs.withColumn("t", F.xxhash64("text")).join(numbers, ["doc", "t"], "left")
    return j.select("doc", "text", F.coalesce("v", F.lit(0)).cast("int").alias("v"))


def context(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Four bits, from 1 to 15, of each of the four words before the seeds at
    ``at`` and the four behind them, packed; 0 where a text ends."""
    low = np.r_[np.zeros(4, np.uint32), (ids >> np.uint64(24)).astype(np.uint32) % np.uint32(15) + np.uint32(1), np.zeros(K + 4, np.uint32)]
    out = np.zeros(len(at), np.uint32)
    for k, step in enumerate([0, 1, 2, 3, 4 + K, 5 + K, 6 + K, 7 + K]):
        out |= low[at + step] << np.uint32(4 * k)
    return out.view(np.int32)


def _seeds(texts: DataFrame) -> DataFrame:
    """``h, doc, at, ctx`` of every seed, and for each text a row without
    ``h`` whose place is the number of its words."""
    def run(batches):
        hasher = WordHasher()
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                doc, v = part.column(0).to_numpy(), part.column(1).to_numpy()
                hs, docs, ats, ctx, ends = [], [], [], [], []
                for i, t in enumerate(part.column(2).to_pylist()):
                    ids = hasher.ids(words_of(t))
                    at, h = seeds_of(ids)
                    hs.append(h)
                    docs.append(np.full(len(at), doc[i]))
                    ats.append(at + (int(v[i]) << SHIFT))
                    ctx.append(context(ids, at))
                    ends.append(len(ids) + (int(v[i]) << SHIFT))
                n = len(ends)
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array(np.concatenate(hs).view(np.int64)), none]), pa.array(np.concatenate([*docs, doc])),
                     pa.array(np.concatenate([*ats, ends]).astype(np.int64)), pa.array(np.concatenate([*ctx, np.zeros(n, np.int32)]))],
                    ["h", "doc", "at", "ctx"])
    return texts.select("doc", "v", "text").mapInArrow(run, "h long, doc long, at long, ctx int")


def _copies(texts: DataFrame) -> DataFrame:
    """``doc, v, rep, rv, n``: the documents whose text a smaller one has as
    well, with the smallest such and the number of words."""
    keyed = texts.select("doc", "v", F.md5("text").alias("t"))
    first = keyed.groupBy("t").agg(F.min(F.struct("doc", "v")).alias("first"), F.max("doc").alias("top")).where("top > first.doc")
    return keyed.distinct().join(first, "t").where(F.col("doc") > F.col("first.doc")) \
        .select("doc", "v", F.col("first.doc").alias("rep"), F.col("first.v").alias("rv"))


def _groups(batches, columns: int, keys: int):
    """The sorted rows of a partition, one run of equal keys at a time, as
    lists of numpy columns."""
    rest = None
    for b in batches:
        cols = [b.column(i).to_numpy() for i in range(columns)]
        if rest is not None:
            cols = [np.concatenate(p) for p in zip(rest, cols)]
        if not len(cols[0]):
            continue
        new = np.zeros(len(cols[0]), bool)
        new[0] = True
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(new).tolist()
        for s, e in zip(cut, cut[1:]):
            yield [c[s:e] for c in cols]
        rest = [c[cut[-1]:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def _chains(matches: DataFrame) -> DataFrame:
    """``doc, v, hub, hv, xs, ys`` of each chain of matches, from
    ``matches(doc, v, hub, hv, x, y, alike)`` dealt and sorted by document. A
    chain of one match is kept if ``ALIKE`` of the words around it agree as
    well: elsewhere no passage can grow from it but by chance."""
    def run(batches):
        out: list[tuple] = []

        def batch():
            c = list(zip(*out))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 2
            got = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds)], ["doc", "v", "hub", "hv", "xs", "ys"])
            out.clear()
            return got
        for doc, v, hub, hv, x, y, alike in _groups(batches, 7, 4):
            if len(x) == 1 and alike[0] < ALIKE:
                continue
            both = np.unique(np.stack([x, y, alike]), axis=1)
            for c in chains(both[0], both[1]):
                if len(c) == 1 and both[2][c[0]] < ALIKE:
                    continue
                out.append((doc[0], v[0], hub[0], hv[0], both[0][c], both[1][c]))
            if len(out) >= 2000:
                yield batch()
        if out:
            yield batch()
    return matches.mapInArrow(run, "doc long, v long, hub long, hv long, xs array<int>, ys array<int>")


def _slices(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, side, w binary`` for each of ``wanted(doc, v, id, side, low,
    high)``: the hashes of the words from ``low`` to ``high``."""
    def run(batches):
        hasher, last, ids = WordHasher(), None, None
        for b in batches:
            for first in range(0, b.num_rows, 512):
                part = b.slice(first, 512)
                doc, v, num, side, low, high = (part.column(i).to_numpy() for i in range(6))
                got = []
                for i in range(part.num_rows):
                    if (doc[i], v[i]) != last:
                        last, ids = (doc[i], v[i]), hasher.ids(words_of(part.column(6)[i].as_py())).astype(np.uint32)
                    got.append(ids[low[i]:high[i]].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array(got, pa.binary())], ["id", "side", "w"])
    rows = wanted.join(texts.select("doc", "v", "text"), ["doc", "v"]) \
        .select("doc", "v", "id", "side", "low", "high", "text")
    return rows.mapInArrow(run, "id long, side int, w binary")


def repeated_passages(df: DataFrame, min_words: int = 50, similarity: float = 0.8, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``doc_id, start_word, n_words, source_id, source_start, source_words,
    equal_words, similarity`` of each passage that a document repeats from one
    with a smaller id.

    Words are lower-cased (A-Z) and cut at ASCII white space. A passage has
    ``min_words`` words or more in the document, of which (and of the source's)
    a share of ``similarity`` is equal in order. Each document is compared with
    the first document of each of its seeds, so that a passage in n documents
    gives n - 1 rows, not all pairs. Equal runs of ``min_words`` words are found
    wherever an earlier document holds them, if ``NEW`` words in a row of them
    are in no passage yet. A document of the same text as an earlier one is one
    passage.
    What a document says again after ``CIRCLE`` words or more is compared with
    the source each time, quicker repetitions turn by turn. A chain is followed up to ``PAD`` words beyond its outer seeds.

    Null ids and null or short texts take no part. Repeated rows are one; the
    different texts of one id are different documents of that id, which aren't
    compared with each other. Other columns are not read; an empty table gives
    an empty result."""
    return _passages(_texts(small_batches(df), id_col, text_col), min_words, similarity).drop("v").distinct()


def _passages(texts: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """``repeated_passages`` with the number ``v`` of the document's text."""
    copies = stage(_copies(texts), "copies")
    seeds = _seeds(texts).withColumn("v", F.shiftright("at", SHIFT).cast("int"))
    seeds = stage(seeds.join(copies.select("doc", "v"), ["doc", "v"], "left_anti").drop("v"), "seeds")
    whole = stage(_whole(copies, seeds.where("h is null"), min_words), "whole")
    kept = seeds.where("h is not null")
    hubs = kept.groupBy("h").agg(F.min(F.struct("doc", "at", "ctx")).alias("first"), F.max("doc").alias("top")).where("top > first.doc") \
        .select("h", F.col("first.doc").alias("hub"), F.col("first.at").alias("hub_at"), F.col("first.ctx").alias("hub_ctx"))
    shared = kept.join(hubs, "h").select("doc", "at", "hub", "hub_at", _agreeing("ctx", "hub_ctx").alias("alike"))
    shared = stage(shared, "shared")
    drop_stage(seeds)
    found = _aligned(shared, texts, min_words, similarity)
    stretches = stage(_stretches(shared, found, min_words), "stretches")
    drop_stage(shared)
    return found.unionByName(whole).unionByName(_exact(stretches, texts, min_words))


def _whole(copies: DataFrame, ends: DataFrame, min_words: int) -> DataFrame:
    """A passage for each document whose text an earlier one has as well;
    ``ends(doc, at)`` has the number of words of that."""
    n = F.col("at").bitwiseAND(MASK).cast("int")
    first = ends.select(F.col("doc").alias("rep"), F.shiftright("at", SHIFT).cast("int").alias("rv"), n.alias("n")).where(F.col("n") >= min_words)
    zero = F.lit(0)
    return copies.join(first.distinct(), ["rep", "rv"]).select(
        F.col("doc").alias("doc_id"), zero.alias("start_word"), F.col("n").alias("n_words"), F.col("rep").alias("source_id"),
        zero.alias("source_start"), F.col("n").alias("source_words"), F.col("n").alias("equal_words"), F.lit(1.0).alias("similarity"),
        F.col("v").cast("long").alias("v"))


PASSAGE = ["doc_id", "start_word", "n_words", "source_id", "source_start", "source_words", "equal_words", "similarity", "v"]
PASSAGE_TYPES = ("doc_id long, start_word int, n_words int, source_id long, source_start int, source_words int, "
                 "equal_words int, similarity double, v long")


def _stretches(shared: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """``doc, v, low, high, open``: the stretches of ``min_words`` words or
    more of which every seed is shared, and those parts of them (with what an
    equal run around may need) that hold ``NEW`` words in a row in no passage
    (``open``)."""
    def parts(batches):
        for doc, at, end, kind in _groups(_wide(batches), 4, 1):
            out = []
            where, spans = at[kind == 1], np.stack([at[kind == 0], end[kind == 0]], 1)
            if not len(where):
                continue
            cut = np.flatnonzero(np.diff(where) > WINDOW)
            lows, highs = where[np.r_[0, cut + 1]] - WINDOW + 1, where[np.r_[cut, len(where) - 1]] + K + WINDOW - 1
            long = highs - lows >= min_words
            for lo, hi in zip(lows[long].tolist(), highs[long].tolist()):
                v = (lo + WINDOW - 1) >> SHIFT
                lo = max(lo, v << SHIFT)
                if hi - lo < min_words:
                    continue
                out.append((lo, hi, False))
                at_word = lo
                inside = spans[(spans[:, 1] > lo) & (spans[:, 0] < hi)].tolist()
                for s, e in [*inside, [hi, hi]]:
                    if s - at_word >= NEW:
                        out.append((max(lo, at_word - min_words + NEW), min(hi, s + min_words - NEW), True))
                    at_word = max(at_word, e)
            if out:
                low, high, is_open = (np.array(c) for c in zip(*out))
                yield np.full(len(out), doc[0]), low >> SHIFT, low & MASK, high - (low >> SHIFT << SHIFT), is_open

    def run(batches):
        yield from _batched(parts(batches), ["doc", "v", "low", "high", "open"])
    start = F.shiftleft(F.col("v"), SHIFT) + F.col("start_word")
    spans = found.select(F.col("doc_id").alias("doc"), start.alias("at"), (start + F.col("n_words")).alias("end"), F.lit(0).alias("kind"))
    rows = shared.select("doc", "at", F.lit(0).cast("long").alias("end"), F.lit(1).alias("kind")).distinct().union(spans)
    dealt = rows.repartition(partitions(shared.sparkSession), "doc").sortWithinPartitions("doc", "at", "kind")
    return dealt.mapInArrow(run, "doc long, v long, low long, high long, open boolean")


def _run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` ids, from those of runs half as long."""
    if len(ids) < n:
        return ids[:0]
    h, k, out, used = ids, 1, None, 0
    while used < n:
        if n & k:  # runs of the powers of two that add up to n, one behind the other
            out = h if out is None else mix64(out[:len(ids) - used - k + 1] * np.uint64(0x9E3779B97F4A7C15) + h[used:])
            used += k
        h = mix64(h[:-k] * np.uint64(0xC2B2AE3D27D4EB4F) + h[k:]) if len(h) > k else h[:0]
        k *= 2
    return out[:max(len(ids) - n + 1, 0)]


def _circling(ids: np.ndarray, n: int) -> np.ndarray:
    """Whether the run of ``n`` words from each place on goes round in a
    circle of n / 2 words at most: each of its k-mers comes back after as
    many words."""
    h = window_hashes(ids, K)
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():
        return np.zeros(max(len(ids) - n + 1, 0), bool)
    back = np.zeros(len(h), np.int64)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    back[order[:-1][same]] = np.diff(order)[same]
    ends = np.r_[np.flatnonzero(np.diff(back) != 0) + 1, len(back)] if len(back) else np.empty(0, np.int64)
    left = ends[np.searchsorted(ends, np.arange(len(back)), side="right")] - np.arange(len(back)) if len(back) else back
    round_ = (back > 0) & (2 * back <= n) & (left >= n - K + 1 - back)
    return round_[:max(len(ids) - n + 1, 0)]


def _run_rows(stretches: DataFrame, texts: DataFrame, min_words: int, bits=None) -> DataFrame:
    """``h, doc, v, at`` of the runs of ``min_words`` words in the stretches,
    with ``bits`` those alone whose hash hits the bitmap. What goes round in
    circles is left to the chains."""
    spans = stretches.groupBy("doc", "v").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))  # of one text

    def parts(batches):
        hasher = WordHasher()
        for b in batches:
            for i in range(b.num_rows):
                ids = hasher.ids(words_of(b.column(3)[i].as_py()))
                h, past, circling = _run_hashes(ids, min_words), 0, _circling(ids, min_words)
                doc, v = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for s in b.column(2)[i].as_py():
                    at = np.arange(max(s["low"], past), min(s["high"] - min_words + 1, len(h)))
                    if not len(at):
                        continue
                    past = int(at[-1]) + 1
                    at = at[~circling[at]]
                    g = h[at]
                    if bits is not None:
                        bit = g % np.uint64(BITMAP)
                        ok = (bits.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        at, g = at[ok], g[ok]
                    yield g.view(np.int64), np.full(len(at), doc), np.full(len(at), v), at

    def run(batches):
        yield from _batched(parts(batches), ["h", "doc", "v", "at"])
    rows = spans.join(texts.withColumn("v", F.col("v").cast("long")), ["doc", "v"]).select("doc", "v", "spans", "text")
    return rows.mapInArrow(run, "h long, doc long, v long, at long")


def _exact(stretches: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """Equal runs of ``min_words`` words or more: those of the open stretches
    go into a bitmap of fixed size, all stretches are held against it, and
    each run is joined with the first document that holds it. Neighbouring
    runs with the same source are one passage."""
    spark = stretches.sparkSession
    if stretches.where("open").isEmpty():
        return spark.createDataFrame([], PASSAGE_TYPES)

    def fill(batches):
        bits = np.zeros(BITMAP // 8, np.uint8)
        for b in batches:
            bit = b.column(0).to_numpy().view(np.uint64) % np.uint64(BITMAP)
            np.bitwise_or.at(bits, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    def merge(batches):
        bits = np.zeros(BITMAP // 8, np.uint8)
        for b in batches:
            for x in b.column(0):
                bits |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    some = _run_rows(stretches.where("open"), texts, min_words).mapInArrow(fill, "bits binary")
    some = some.repartition(8).mapInArrow(merge, "bits binary")  # eight bitmaps reach the driver
    bits = np.zeros(BITMAP // 8, np.uint8)
    for r in some.collect():
        bits |= np.frombuffer(r["bits"], np.uint8)
    runs = stage(_run_rows(stretches.where("not open"), texts, min_words, spark.sparkContext.broadcast(bits)), "runs")
    first = runs.groupBy("h").agg(F.min(F.struct("doc", "v", "at")).alias("f"), F.max("doc").alias("top")).where("top > f.doc")
    rows = runs.join(first, "h").where("doc > f.doc").select("doc", "v", F.col("f.doc").alias("hub"), F.col("f.v").alias("hv"),
                                                             (F.col("at") - F.col("f.at")).alias("shift"), "at")

    def parts(batches):
        for doc, v, hub, _hv, shift, at in _groups(_wide(batches), 6, 5):
            at = np.unique(at)  # repeated rows
            cut = np.flatnonzero(np.diff(at) != 1)
            lo, hi = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + min_words
            n = (hi - lo).astype(np.int32)
            yield (np.full(len(n), doc[0]), lo.astype(np.int32), n, np.full(len(n), hub[0]), (lo - shift[0]).astype(np.int32), n, n,
                   np.ones(len(n)), np.full(len(n), v[0]))

    def join(batches):
        yield from _batched(parts(batches), PASSAGE)
    dealt = rows.repartition(partitions(spark), "doc", "v", "hub", "hv", "shift") \
        .sortWithinPartitions("doc", "v", "hub", "hv", "shift", "at")
    return dealt.mapInArrow(join, PASSAGE_TYPES)


def _batched(parts, names: list[str], rows: int = 1 << 14):
    """``parts``, each a list of numpy columns, put together to record batches
    of about ``rows`` rows."""
    held, n = [], 0
    for p in parts:
        if len(p[0]):
            held.append(p)
            n += len(p[0])
        if n >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)


def _wide(batches, rows: int = 1 << 14):
    """``batches`` put together to about ``rows`` rows."""
    held: list = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _agreeing(a: str, b: str) -> Column:
    """How many of the eight parts of two contexts agree; a zero, where there
    is no word, agrees with nothing."""
    return sum((F.when((F.shiftrightunsigned(F.col(a).bitwiseXOR(F.col(b)), 4 * k).bitwiseAND(15) == 0)
                       & (F.shiftrightunsigned(F.col(a), 4 * k).bitwiseAND(15) != 0), 1).otherwise(0) for k in range(8)), F.lit(0)).cast("int")


def _aligned(pairs: DataFrame, texts: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """The passages between the documents and hubs of ``pairs(doc, at, hub,
    hub_at)``, with the number ``v`` of the document's text."""
    low = MASK
    matches = pairs.where("doc > hub").select(
        "doc", F.shiftright("at", SHIFT).alias("v"), "hub", F.shiftright("hub_at", SHIFT).alias("hv"),
        F.col("at").bitwiseAND(low).alias("x"), F.col("hub_at").bitwiseAND(low).alias("y"), F.col("alike").cast("long").alias("alike"))
    dealt = matches.repartition(partitions(pairs.sparkSession), "doc", "v").sortWithinPartitions("doc", "v", "hub", "hv", "x", "y")
    found = stage(_chains(dealt).withColumn("id", F.monotonically_increasing_id()), "chains")
    ends = found.select("*", F.greatest(F.element_at("xs", 1) - PAD, F.lit(0)).alias("xl"), (F.element_at("xs", -1) + K + PAD).alias("xh"),
                        F.greatest(F.element_at("ys", 1) - PAD, F.lit(0)).alias("yl"), (F.element_at("ys", -1) + K + PAD).alias("yh"))
    wanted = ends.select("doc", "v", "id", F.lit(0).alias("side"), F.col("xl").alias("low"), F.col("xh").alias("high")).union(
        ends.select("hub", "hv", "id", F.lit(1), "yl", "yh"))
    cut = _slices(texts, wanted)
    sides = cut.groupBy("id").agg(F.max(F.when(F.col("side") == 0, F.col("w"))).alias("a"),
                                  F.max(F.when(F.col("side") == 1, F.col("w"))).alias("b"))
    rows = ends.join(sides, "id").select("doc", "hub", "xs", "ys", "xl", "yl", "a", "b", "v")

    def align(batches):
        for b in batches:
            out = []
            doc, hub, xl, yl, v = (b.column(i).to_numpy() for i in (0, 1, 4, 5, 8))
            for i in range(b.num_rows):
                x, y = b.column(2)[i].values.to_numpy() - xl[i], b.column(3)[i].values.to_numpy() - yl[i]
                a, o = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint32).tolist() for c in (6, 7))
                for s, n, t, m, equal in passages(a, o, list(zip(x.tolist(), y.tolist())), min_words, similarity):
                    out.append((doc[i], int(xl[i]) + s, n, hub[i], int(yl[i]) + t, m, equal, equal / max(n, m), v[i]))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    names = PASSAGE
    aligned = stage(rows.mapInArrow(align, PASSAGE_TYPES), "passages")
    drop_stage(found)
    return aligned


WORD = re.compile(r"[^ \t-\r]+")


def cut_spans(text: str, spans: list[tuple]) -> str:
    """``text`` without the words of ``spans`` (first word, words); what is
    left keeps its own white space."""
    at = [m.span() for m in WORD.finditer(text)]
    gone = np.zeros(len(at) + 1, bool)
    for s, n in spans:
        gone[s:min(s + n, len(at))] = True
    out, last = [], 0
    edge = np.flatnonzero(np.diff(np.r_[False, gone[:-1], False].astype(np.int8))).tolist()
    for s, e in zip(edge[::2], edge[1::2]):
        out.append(text[last:at[s][0]])
        last = at[e][0] if e < len(at) else len(text)
    out.append(text[last:])
    return "".join(out).strip(" \t\n\v\f\r")


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
                 min_words: int = 50, similarity: float = 0.8) -> DataFrame:
    """``df`` without the repeated passages: each stays in the document with
    the smallest id only. A text that is cut is trimmed and, if
    ``length_col`` is a column, has its length set there; a row of which
    nothing is left is dropped. Other rows and columns are unchanged, whatever
    the columns' names: rows with a null id or text stay, of several texts of
    one id each is cut by its own passages, repeated rows are cut alike, and
    an empty table stays empty."""
    texts = _texts(small_batches(df), id_col, text_col)
    found = stage(_passages(texts, min_words, similarity), "passages")
    name = {c: f"{c}_{uuid.uuid4().hex[:8]}" for c in ("id", "t", "spans")}  # no column of the table
    keys = texts.select("doc", F.col("v").cast("long").alias("v"), F.xxhash64("text").alias(name["t"])).distinct()
    spans = found.join(keys, (found["doc_id"] == keys["doc"]) & (found["v"] == keys["v"])) \
        .groupBy(F.col("doc").alias(name["id"]), name["t"]).agg(F.collect_set(F.struct("start_word", "n_words")).alias(name["spans"]))
    spans = stage(spans, "spans")  # the passages of one text
    cell = {c: F.col(f"`{c}`") for c in df.columns}
    joined = df.join(spans, (cell[id_col].cast("long") == F.col(name["id"])) & (
        F.xxhash64(cell[text_col].cast("string")) == F.col(name["t"])), "left")
    cut = F.udf(lambda t, s: None if t is None else cut_spans(t, [(r[0], r[1]) for r in s]), "string", useArrow=True)
    hit = F.col(name["spans"])
    same = joined.where(hit.isNull()).select(*cell.values())
    new = joined.where(hit.isNotNull()).select(*[cut(x.cast("string"), hit).alias(c) if c == text_col else x for c, x in cell.items()])
    new = new.where(F.length(cell[text_col]) > 0)
    if length_col in cell:
        kind = dict(df.dtypes)[length_col]
        new = new.select(*[F.length(cell[text_col]).cast(kind).alias(c) if c == length_col else x for c, x in cell.items()])
    return same.union(new)
