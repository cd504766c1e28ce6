import numpy as np

from quotelens.llm import hard_negatives


def brute(rows, scale=256):
    good = [(i, lab, np.floor(scale * np.array(v, float)).astype(int)) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, v in good:
        if i % 100:
            continue
        scored = sorted((-int(v @ w), j, other == lab) for j, other, w in good if j != i)
        for s, j, _ in [x for x in scored if x[2]][:5]:
            fit = [(-t, k) for t, k, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, r + 1, k, -s, t) for r, (t, k) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, leaf string")
    return sorted(tuple(r) for r in hard_negatives.mine(df, is_anchor=lambda i: i % 100 == 0, **more).collect())


def test_equals_brute_force_over_many_leaves_and_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 10)) * 2
    rows = [(i, int(rng.integers(4)), (centres[i % 12] + rng.normal(size=10) * 0.2).tolist()) for i in range(1500)]
    rows += [(1500 + i, int(rng.integers(3)), rows[i % 5][2]) for i in range(600)]  # ties, a third of the rows
    got = mined(spark, rows, scale=16, ways=4, levels=3, sample=300, part_rows=60, block_rows=4)
    assert got == brute(rows, 16) and len(got) > 400


def test_vectors_of_very_different_length_and_negative_products(spark):
    rng = np.random.default_rng(5)
    rows = [(i * 10, int(rng.integers(3)), (rng.normal(size=6) * rng.gamma(1, 2)).tolist()) for i in range(400)]
    got = mined(spark, rows, scale=64, ways=3, levels=2, sample=100, part_rows=40)
    assert got == brute(rows, 64) and len(got) > 50


def test_siblings_are_eliminated():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(16, 8)) * 100
    v = np.concatenate([c + rng.normal(size=(200, 8)) for c in centres])
    tree = hard_negatives.Tree(v[::7], 16, 1)
    cells = {}
    near = tree.deal(v, lambda node, x, d, k: cells.update({node: (x, d, k)}))
    x, d, k = cells[0]
    n2 = (x * x).sum(1)
    tree.ranges[0] = np.stack([np.array([[f(m[k == b, a]) for b in range(16)] for a in range(16)]) for f, m in
                               [(np.min, d), (np.max, d), (np.min, np.tile(n2[:, None], 16)), (np.max, np.tile(n2[:, None], 16))]], 2)
    s = v @ v.T
    fifth = np.sort(s, 1)[:, -5]
    rows, leaves = tree.leaves(v, fifth, np.full(len(v), np.inf))
    kept = set(zip(rows.tolist(), leaves.tolist()))
    assert all((i, near[j]) in kept for i in range(0, len(v), 50) for j in np.flatnonzero(s[i] >= fifth[i]))
    assert len(kept) < 0.5 * 16 * len(v)


def test_edge_cases(spark):
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [2.0, 1.0]), (2, 1, None), (None, 1, [1.0, 1.0]), (3, 2, [float("nan"), 1.0]), (4, 2, [None, 1.0]),
            (5, 2, [1.0, 1.0]), (6, None, [1.0, 1.0]), (7, 2, [0.0, 0.0]), (100, 2, [0.0, 0.0]), (8, 2, [float("inf"), 0.0]),
            (200, 3, [-1.0, -1.0]), (9, 3, [1.0, 0.0]), (10, 2, [2.0, 0.9])]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, rows[:0] + [(3, None, None)]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0, 5.0]), (2, 2, [1.0, 9.0]), (3, 2, [])]) == \
        brute([(0, 1, [1.0, 0.0]), (1, 1, [1.0, 5.0]), (2, 2, [1.0, 9.0]), (3, 2, [0.0, 0.0])]) != []


def test_repeated_rows_count_for_each_copy(spark):
    rows = [(0, 1, [1.0, 1.0])] * 2 + [(1, 1, [1.0, 1.0])] + [(2, 2, [1.0, 0.9])] * 2
    got = mined(spark, rows)
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(0, 1, 1, 2), (0, 1, 2, 2)]
