"""Periodic run detection by online dyadic square catching.

Words are appended in order. On every level B = 1, 2, 4, ... each completed
block of B words becomes a catcher of the periods from 2B up to 4B: a word
that is appended ends one window of B words on each level, and that window is
compared with the only two catchers that stand at such a distance before it.
A square of period p holds a whole block within its first half, so it meets
its catcher; comparisons of blocks that follow each other at one distance are
one stretch, whose two ends are then settled by halving steps over the window
hashes that the levels hold already. Stretches of two periods or more are the
runs. A word costs O(log n) comparisons; the comparisons are made for all the
words that are appended at once, as array operations."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, mix64, small_batches

ODD = np.uint64(0x9E3779B97F4A7C15)
BATCH_WORDS = 60_000


class Grown:
    """An array that is appended to; its room doubles."""

    def __init__(self):
        self.room, self.n = np.empty(64, np.uint64), 0

    def add(self, x: np.ndarray) -> None:
        n = self.n + len(x)
        if n > len(self.room):
            room = np.empty(max(n, 2 * len(self.room)), np.uint64)
            room[:self.n] = self.room[:self.n]
            self.room = room
        self.room[self.n:n] = x
        self.n = n

    @property
    def view(self) -> np.ndarray:
        return self.room[:self.n]


class SquareCatcher:
    """Catchers over the words (64-bit hashes) that were appended so far, for
    runs of at most ``longest`` words; any way of cutting the words into
    appended pieces gives the same runs."""

    def __init__(self, longest: int | None = None):
        self.longest = longest
        self.windows = [Grown()]  # of 1, 2, 4, ... words, by their first word
        self.pairs: list[int] = []  # words equal to the next one
        self.caught: list[list[np.ndarray]] = []  # by level: period << 32 | block
        self.compared = 0  # words that were compared on the first level

    def append(self, ids: np.ndarray) -> int:
        """Advance all comparisons by these words; how many blocks were met
        again."""
        words = self.windows[0]
        old = words.n
        words.add(ids)
        n, new = words.n, 0
        at = np.arange(max(old - 1, 0), n - 1)
        same = at[words.view[at] == words.view[at + 1]]
        self.pairs.append(same)
        level, most = 0, min(n, self.longest or n)
        while 4 << level <= most:
            b = 1 << level
            if level == len(self.windows):
                self.windows.append(Grown())
            if level == len(self.caught):
                self.caught.append([])
            w = self.windows[level]
            first = w.n if level else self.compared
            if not level:
                self.compared = n
            else:
                half = self.windows[level - 1].view
                w.add(mix64(half[first:n - b + 1] * ODD + half[first + b // 2:n - b // 2 + 1]))
            h = w.view
            x = np.arange(max(first, 2 * b), n - b + 1)
            block = x >> level
            for back in (2, 3):
                met = np.flatnonzero((h[x] == h[np.maximum(block - back, 0) << level]) & (block >= back))
                if len(met):
                    j = block[met] - back
                    self.caught[level].append((x[met] - (j << level)) << 32 | j)
                    new += len(met)
            level += 1
        return new + len(same)

    def _stretches(self):
        """``(period, first, last)`` of the longest stretches of words that
        equal the word one period on, by level."""
        at = np.concatenate(self.pairs) if self.pairs else np.empty(0, np.int64)
        if len(at):
            cut = np.flatnonzero(np.diff(at) != 1)
            yield np.ones(len(cut) + 1, np.int64), at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + 1
        n = self.windows[0].n
        for level, caught in enumerate(self.caught):
            if not caught:
                continue
            key = np.sort(np.concatenate(caught))
            cut = np.flatnonzero(np.diff(key) != 1)
            head, tail = key[np.r_[0, cut + 1]], key[np.r_[cut, len(key) - 1]]
            p = head >> 32
            lo, hi = (head & 0xFFFFFFFF) << level, ((tail & 0xFFFFFFFF) + 1) << level
            for s in range(level - 1, -1, -1):  # each end reaches less than a block further
                step, h = 1 << s, self.windows[s].view
                a = np.maximum(lo - step, 0)
                lo = np.where((lo >= step) & (h[a] == h[a + p]), lo - step, lo)
                a = np.minimum(hi, n - p - step)
                hi = np.where((a == hi) & (h[a] == h[a + p]), hi + step, hi)
            yield p, lo, hi

    def runs(self, least: int = 12) -> np.ndarray:
        """Rows ``start, length, period`` of the runs of ``least`` words or
        more in what was appended, by start, then period."""
        found = [np.stack([lo, hi + p - lo, p], 1)[hi + p - lo >= np.maximum(least, 2 * p)] for p, lo, hi in self._stretches()]
        runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        # of two periods over the same words the larger is a multiple of the smaller
        fresh = np.ones(len(runs), bool)
        fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
        runs = runs[fresh]
        return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def holds(words: list, runs) -> bool:
    """Whether each run's words are those of one period before."""
    return all(words[s:s + n - p] == words[s + p:s + n] for s, n, p in runs)


def runs_of(texts: list[list], hasher: WordHasher, least: int = 12) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words. The lists are appended one after
    another with a word between them that occurs nowhere else; hashes are
    held against the words themselves at the end."""
    out: list = [[] for _ in texts]
    todo = [i for i, w in enumerate(texts) if len(w) >= least]
    todo.sort(key=lambda i: len(texts[i]))
    while todo:
        group, total = [], 0
        while todo and (not group or total + len(texts[todo[0]]) <= BATCH_WORDS):
            group.append(todo.pop(0))
            total += len(texts[group[-1]]) + 1
        starts, parts, at = [], [], 0
        for k, i in enumerate(group):
            starts.append(at)
            parts += [hasher.ids(texts[i]), mix64(np.array([(k + 1) << 40], np.uint64))]
            at += len(texts[i]) + 1
        catcher = SquareCatcher(longest=len(texts[group[-1]]))
        catcher.append(np.concatenate(parts))
        runs = catcher.runs(least)
        of = np.searchsorted(starts, runs[:, 0], side="right") - 1
        runs[:, 0] -= np.asarray(starts, np.int64)[of]
        for k, run in zip(of.tolist(), runs.tolist()):
            out[group[k]].append(tuple(run))
        for i in group:
            for salt in count(1):
                if holds(texts[i], out[i]):
                    break
                # two words or windows had one hash: once more with numbered words and other hashes
                number: dict = {}
                ids = np.array([number.setdefault(w, len(number)) for w in texts[i]], np.uint64)
                catcher = SquareCatcher()
                catcher.append(mix64(ids + np.uint64(salt << 32)))
                out[i] = [tuple(r) for r in catcher.runs(least).tolist()]
    return out


def collapse(words: list, runs) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        change[s + p] += 1
        change[s + n] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return [words[i] for i in kept.tolist()]


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """``doc_id, n_words long, runs array<struct<start, length, period>>,
    collapsed string`` for each row.

    Words are the maximal stretches without ASCII white space, numbered from
    0. A run is a stretch of words with smallest period ``period`` and a
    length of at least ``least`` words and two periods that cannot be
    extended; runs come by start, then period. ``collapsed`` has the words,
    joined by one space, without those that any run holds after its first
    period. A null or empty text, or one of white space, has no word, no run and an empty
    ``collapsed``. Null ids and repeated rows are rows like any other; other
    columns are not read; an empty table gives an empty result. Nothing is
    shuffled; a row's text is held by one worker."""
    kind = dict(df.dtypes)[id_col]
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches):
        hasher = WordHasher()
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            at = 0
            while at < len(texts):  # some rows at once, by the size of their texts
                end, size = at, 0
                while end < len(texts) and (end == at or size < 8_000_000):
                    size += len(texts[end].as_py() or b"")
                    end += 1
                words = [(t or b"").split() for t in texts.slice(at, end - at).to_pylist()]
                runs = runs_of(words, hasher, least)
                sizes = np.cumsum([0] + [len(r) for r in runs])
                flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
                items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, end - at), pa.array([len(w) for w in words], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items).cast(run_type),
                     pa.array([b" ".join(collapse(w, r)) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])
                at = end

    return small_batches(df).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")) \
        .mapInArrow(work, schema)


def digests(found: DataFrame) -> DataFrame:
    """Of ``find_runs``: how many runs, the longest one (ties: smallest start,
    then period; null without runs) and SHA-256 of all runs and of the
    collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    said = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))
