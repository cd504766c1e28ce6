"""Fits learn from all their rows: trees from every cell, however many there are."""

import numpy as np

from quotelens.operators import trees as TR


def many_cells(n=90_000):
    rng = np.random.default_rng(11)
    key = np.zeros(3 * n, np.int64)
    for f, levels in zip(TR.FIELDS, [40, 40, 2, 11, 6, 6, 4] + [2] * (len(TR.FIELDS) - 7)):
        key = (key << TR._width(f)) + rng.integers(0, min(levels, 1 << TR._width(f)), len(key))
    key = np.unique(key)[:n]
    assert len(key) == n
    return key, rng.integers(1, 5, n).astype(float), rng.normal(100.0, 10.0, n)


def small(model, trees):
    return (TR.SPECS[model][0], trees, *TR.SPECS[model][2:])


def test_every_tree_draws_from_all_cells():
    key, n, y = many_cells()
    *_, forest, _ = TR.grow(key, n, n * y, n * y * y, small("M5", 3), 1)
    for *_, cover in forest:  # as many rows as there are, drawn with replacement
        assert abs(cover[0] / n.sum() - 1) < 0.02
    *_, boosted, _ = TR.grow(key, n, n * y, n * y * y, small("M6", 3), 1)
    for *_, cover in boosted:
        assert abs(cover[0] / n.sum() - TR.SUBSAMPLE) < 0.02


def test_no_cell_is_left_out_for_its_place(monkeypatch):
    key, n, y = (a[:400] for a in many_cells())
    drawn = []
    monkeypatch.setattr(TR.Grower, "tree", lambda self, r, w, depth, *rest: (drawn.append(w > 0), np.full(31, -1), np.zeros(31), np.zeros(31), np.zeros(31))[1:])
    TR.grow(key, n, n * y, n * y * y, small("M6", 200), 1)
    share = np.mean(drawn, 0)  # about 0.8 with a deviation of 0.03
    assert share.min() > 0.65 and share.max() < 0.95


def test_covers_and_values_are_the_sums_of_the_cells_below():
    key, n, y = many_cells(20_000)
    g = TR.Grower(TR.unpack(key), (), np.random.default_rng(0))
    r = n * (y - 100)
    feature, cut, value, cover = g.tree(r, n, 5, 5, 1.0, np.arange(len(g.used)), slice(0, len(key)))
    below = {0: np.ones(len(key), bool)}
    for i in range(31):
        if i in below and feature[i] >= 0:
            right = g.codes[feature[i]] > cut[i]
            below[2 * i + 1], below[2 * i + 2] = below[i] & ~right, below[i] & right
    assert len(below) > 20
    for i, m in below.items():
        assert cover[i] == n[m].sum() and np.isclose(value[i], r[m].sum() / (n[m].sum() + 1.0), atol=1e-8)
        assert i == 0 or cover[i] >= 5
