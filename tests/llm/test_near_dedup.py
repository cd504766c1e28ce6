import random

import numpy as np

from quotelens.llm import near_dedup
from quotelens.llm.common import WordHasher, components


def brute(rows, k, percent):
    """id -> (set size, smallest id reachable)."""
    sets = {}
    for i, t in rows:
        w = near_dedup.words_of(t)
        sets.setdefault(i, []).append(frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k
                                      else frozenset([tuple(w)]) if w else frozenset())
    flat = [(i, s) for i, ss in sets.items() for s in ss if i is not None and s]
    top = {i: i for i, _ in flat}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in range(len(flat)):
        for b in range(a):
            (i, s), (j, t) = flat[a], flat[b]
            if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                n = len(s & t)
                if 100 * n >= percent * (len(s) + len(t) - n):
                    x, y = find(i), find(j)
                    top[max(x, y)] = min(x, y)
    return {i: (len(ss[0]), find(i) if i in top else i) for i, ss in sets.items()}


def group(r, base, edits, vocabulary):
    w = list(base)
    for _ in range(edits):
        w[r.randrange(len(w))] = r.choice(vocabulary)
    return w


def test_equals_brute_force_on_planted_groups(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for size in (1, 2, 3, 5, 8, 12, 20, 40, 80, 200, 500):
        base = r.choices(vocabulary, k=size)
        docs += [group(r, base, r.randint(0, max(1, size // 25)), vocabulary) for _ in range(12)]
        docs += [base + r.choices(vocabulary, k=max(1, size // 8)) for _ in range(6)]
    common = r.choices(vocabulary, k=30)
    docs += [common + r.choices(vocabulary, k=r.randint(5, 60)) for _ in range(80)]  # one passage that many share
    docs += [docs[0]] * 20
    r.shuffle(docs)
    rows = [(i, r.choice([" ", "\n"]).join(w).replace("w1", r.choice(["w1", "W1"]))) for i, w in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 85), (5, 80)):
        want = brute(rows, k, percent)
        got = near_dedup.near_duplicates(df, k, percent / 100).collect()
        assert len(got) == len(rows)
        for x in got:
            assert (x["n_shingles"], x["component_id"]) == want[x["doc_id"]], x
            assert x["kept"] == (x["doc_id"] == x["component_id"])


def test_edge_cases(spark, small, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(small).collect()}
    assert got == {(1, 6, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 1, None, True), (4, 0, 4, True), (5, 1, 5, True),
                   (6, 1, 6, True), (7, 6, 1, False)}
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.drop_near_duplicates(small)
    assert kept.columns == small.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_a_similar_pair_always_shares_a_band_up_to_the_exact_size():
    r, hasher = np.random.default_rng(5), WordHasher()
    for _ in range(300):
        n = int(r.integers(2, 120))
        pool = [b"%d" % i for i in r.integers(0, 10**9, 2 * n)]
        a = np.unique(hasher.ids(pool[:n]))
        d = near_dedup.differences(len(a), 0.85)
        b = np.unique(np.r_[a[d // 2:], hasher.ids(pool[n:n + d // 2])])
        if len(np.intersect1d(a, b)) < 0.85 * len(np.union1d(a, b)):
            continue
        keys = [near_dedup.node_keys(near_dedup.registers(s), len(s), 0.85) for s in (a, b)]
        assert len(np.intersect1d(*keys))


def test_long_texts_at_the_pipelines_threshold_share_a_band():
    r, apart = np.random.default_rng(15), 0
    for i in range(9000):
        n = 2700 if i % 2 else 900  # sets of n that differ in n / 9 on each side are similar by 0.8
        pool = r.integers(0, 2**63, n + n // 9, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 9:])
        keys = [near_dedup.node_keys(near_dedup.registers(s), len(s), 0.8) for s in (a, b)]
        apart += not len(np.intersect1d(*keys))
    assert apart == 0


def test_estimate_is_close():
    r = np.random.default_rng(6)
    a = r.integers(0, 2**63, 4000, dtype=np.uint64)
    b = np.r_[a[:3000], r.integers(0, 2**63, 1000, dtype=np.uint64)]
    ra, rb = (near_dedup.registers(np.unique(near_dedup.mix64(x))) for x in (a, b))
    similar, _ = near_dedup.estimate(ra[None], rb[None])
    assert abs(similar[0] - 0.6) < 0.12


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (2, 1)] + [(i, i + 1) for i in range(100, 140)]
    got = {(r["node"], r["component"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)} | {(i, 100) for i in range(100, 141)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
