import hashlib
import random
import zlib

import numpy as np
from conftest import SF001
from pyspark.sql import functions as F

from quotelens.llm import queries, runs
from quotelens.llm.common import WordHasher


def brute(words, least=12):
    """Every period is tried over the whole list."""
    number = {}
    a = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n, found = len(a), {}
    for p in range(1, n // 2 + 1):
        same = np.r_[False, a[p:] == a[:-p], False]
        edge = np.flatnonzero(np.diff(same.astype(int)))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if hi - lo + p >= max(least, 2 * p):
                found.setdefault((lo, hi - lo + p), p)  # the smallest period comes first
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    kind = rng.randrange(4)
    n = rng.randrange(0, 140)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:  # repeated pieces, with errors
        piece = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))]
        w = (piece * 10)[:n]
        for _ in range(rng.randrange(3)):
            if w:
                w[rng.randrange(len(w))] = "x"
        return w
    if kind == 2:  # squares of squares
        w = ["a"]
        while len(w) < n:
            w = w + w if rng.random() < 0.7 else w + [rng.choice("ab")]
        return w
    return [rng.choice(["the", "of", "cat", "dog"]) for _ in range(n)] * rng.randrange(1, 4)


def test_runs_equal_brute_force_in_groups():
    rng = random.Random(5)
    texts = [[w.encode() for w in some_words(rng)] for _ in range(700)]
    assert runs.runs_of(texts, WordHasher()) == [brute(t) for t in texts]


def test_any_cut_of_the_words_gives_the_same_runs():
    rng = random.Random(6)
    for _ in range(40):
        words = [w.encode() for w in some_words(rng)]
        ids = WordHasher().ids(words)
        one = runs.SquareCatcher()
        at = 0
        while at < len(ids):
            step = rng.choice([1, 1, 2, 7, 40])
            one.append(ids[at:at + step])
            at += step
        assert [tuple(r) for r in one.runs().tolist()] == brute(words)


def test_colliding_hashes_are_found_out():
    class Same(WordHasher):
        def ids(self, words):
            return np.zeros(len(words), np.uint64)

    texts = [[b"a", b"b", b"c", b"d"] * 6, [str(i).encode() for i in range(30)]]
    assert runs.runs_of(texts, Same()) == [[(0, 24, 4)], []]


def test_one_repeated_word_and_long_periods():
    texts = [[b"w"] * 30_000, [str(i % 9000).encode() for i in range(27_001)]]
    assert runs.runs_of(texts, WordHasher()) == [[(0, 30_000, 1)], [(0, 27_001, 9000)]]


def expected(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    drop = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    tail = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    said = "".join(f"{s},{m},{p}\n" for s, m, p in found).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *tail, hashlib.sha256(said).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark):
    got = [tuple(r) for r in queries.op13_square_catchers(spark, SF001).collect()]
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    want = [expected(*r) for r in docs]
    assert sorted(got) == sorted(want) and any(r[1] for r in got)


def test_edge_rows(spark, small, empty):
    got = sorted(map(tuple, runs.digests(runs.find_runs(queries.periodised(small.select("doc_id", "text", "n", "key")))).collect()), key=str)
    want = sorted((expected(r["doc_id"], r["text"]) for r in small.collect()), key=str)
    assert got == want
    assert runs.digests(runs.find_runs(empty)).count() == 0


def test_output_has_spans_and_text(spark):
    df = spark.createDataFrame([(1, "x " + "a b c\td " * 4 + "y")], "doc_id int, text string")
    row = runs.find_runs(df).select("doc_id", "n_words", F.col("runs")[0].alias("r"), "collapsed").first()
    assert (row["doc_id"], row["n_words"], tuple(row["r"]), row["collapsed"]) == (1, 14, (1, 12, 3), "x a b c d y")
