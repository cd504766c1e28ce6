import random

import numpy as np
from pyspark.sql import functions as F

from quotelens.llm import substring


def words(r, n):
    return ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(n)]


def test_planted_passages_are_found_and_clean_text_is_not(spark):
    r = random.Random(7)
    passages = [words(r, n) for n in (51, 60, 120, 400)]
    short = words(r, 30)
    rows, planted = [], {}
    for i in range(120):
        w = words(r, r.randint(20, 200))
        if i % 4 == 0:
            p = list(passages[i // 4 % 4])
            if i % 3 == 1 and len(p) > 100:
                for _ in range(len(p) // 20):
                    p[r.randrange(len(p))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = p
            planted[i] = (i // 4 % 4, at, len(p))
        elif i % 4 == 1:
            w[5:5] = short
        rows.append((i, " ".join(w)))
    rows.append((500, rows[3][1]))  # a whole copy
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = {}
    for i, (p, _, _) in sorted(planted.items()):
        first.setdefault(p, i)
    found = {}
    for g in got:
        assert g["similarity"] >= 0.8 and g["n_words"] >= 50 and g["source_id"] < g["doc_id"]
        found.setdefault(g["doc_id"], set()).update(range(g["start_word"], g["start_word"] + g["n_words"]))
    assert set(found) - {500} == {i for i, (p, _, _) in planted.items() if first[p] != i}
    assert (500 in found) == (len(rows[3][1].split()) >= 50)
    for i in set(found) - {500}:
        _, at, n = planted[i]
        inside = found[i] & set(range(at, at + n))
        assert len(inside) >= 0.9 * n and len(found[i] - inside) <= 8


def test_a_text_that_goes_round_in_circles(spark):
    rows = [(1, "round and " * 300), (2, "round and " * 200), (3, "x " * 100), (4, "x " * 100)]
    got = {g["doc_id"]: g for g in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["n_words"] >= 350 and got[4]["n_words"] >= 90 and set(got) == {2, 4}


def test_chain_by_fenwick_tree_equals_quadratic_search():
    r = np.random.default_rng(8)
    for _ in range(60):
        n = int(r.integers(2, 40))
        m = np.unique(r.integers(0, 60, (2, n)), axis=1)
        x, y = m
        order, best = np.lexsort((-y, x)), {}
        for j in order:
            best[j] = substring.K
            tops = [(best[i] - substring.GAP_COST * (x[j] - x[i] + y[j] - y[i]), i) for i in best if x[i] < x[j] and y[i] < y[j]]
            if tops:
                gain, i = max(tops, key=lambda t: t[0])
                if gain > 0 and x[j] - x[i] <= substring.MAX_GAP and y[j] - y[i] <= substring.MAX_GAP:
                    best[j] = substring.K + gain
        top = max(best.values())
        found = substring.chains(x, y)
        if top > substring.K:
            c = found[0]
            value = substring.K * len(c) - substring.GAP_COST * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]])
            assert abs(value - top) < 1e-9
        assert all((np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all() for c in found)


def test_second_passage_behind_a_long_gap(spark):
    r = random.Random(11)
    one, two = words(r, 200), words(r, 60)
    rows = [(i, " ".join(one + words(r, 60) + two)) for i in (1, 2)]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = set().union(*(range(g["start_word"], g["start_word"] + g["n_words"]) for g in got))
    assert found == set(range(200)) | set(range(260, 320))


def test_a_document_that_says_an_earlier_passage_twice(spark):
    r = random.Random(12)
    p = words(r, 70)
    rows = [(1, " ".join(words(r, 50) + p + words(r, 50))), (2, " ".join(p + words(r, 80) + p))]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((g["start_word"], g["n_words"], g["source_start"]) for g in got) == [(0, 70, 50), (150, 70, 50)]


def test_changed_passages_of_fifty_words(spark):
    r = random.Random(13)
    rows = []
    for i in range(60):
        p = words(r, 50)
        q = list(p)
        for at in r.sample(range(1, 49), 5):
            q[at] = "changed"
        rows += [(i, " ".join(words(r, 60) + p + words(r, 60))), (100 + i, " ".join(words(r, 60) + q + words(r, 60)))]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(g["doc_id"] == g["source_id"] + 100 and g["similarity"] >= 0.8 for g in got)
    assert len({g["doc_id"] for g in got}) >= 57


def test_stretches_below_the_best_price_are_passages():
    a = list(range(50))
    b = [-i if i % 5 == 2 else i for i in a]
    assert substring.passages(a, b, [(0, 0)], 50, 0.8) == [(0, 50, 0, 50, 40)]


def test_passage_whose_pieces_stand_in_earlier_documents(spark):
    r = random.Random(14)
    rows, want = [], {}
    for size in (20, 30):
        for _ in range(20):
            p, n = words(r, 60), len(rows)
            rows += [(n + i, " ".join(words(r, 40) + p[s:s + size] + words(r, 40))) for i, s in enumerate(range(0, 60, size))]
            n = len(rows)
            rows += [(n + i, " ".join(words(r, 40) + p + words(r, 40))) for i in (0, 1)]
            want[n + 1] = n
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {g["doc_id"]: g["source_id"] for g in got if g["n_words"] >= 60} == want


def test_cutting_words():
    assert substring.cut_spans("a b  c\nd e", [(1, 2)]) == "a d e"
    assert substring.cut_spans("a b c", [(0, 2), (1, 2)]) == ""
    assert substring.cut_spans("a b c", [(2, 9)]) == "a b"


def test_edge_cases(spark, small, empty):
    got = substring.repeated_passages(small).collect()
    assert got == []
    assert substring.repeated_passages(empty).count() == 0
    r = random.Random(9)
    p, q = " ".join(words(r, 70)), " ".join(words(r, 80))
    rows = [(1, p, "c", 9), (1, p, "c", 9), (1, q, "c", 9), (2, "see " + q + " end", "c", 9), (None, p, "c", 9), (3, p, "c", 9), (4, None, "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hub string, n_chars long")
    assert {(g["doc_id"], g["source_id"]) for g in substring.repeated_passages(df).collect()} == {(2, 1), (3, 1)}
    kept = substring.drop_repeats(df)
    assert kept.columns == df.columns
    assert sorted((x["doc_id"] or 0, x["text"] or "", x["n_chars"]) for x in kept.collect()) == sorted(
        [(0, p, 9), (1, p, 9), (1, p, 9), (1, q, 9), (2, "see end", 7), (4, "", 1)])


def test_a_passage_whose_overlapping_pieces_stand_in_earlier_documents(spark):
    for seed in range(6):
        r = random.Random(20 + seed)
        p = words(r, 60)
        rows = [(i, " ".join(words(r, 40) + p[s:s + 36] + words(r, 40))) for i, s in ((1, 0), (2, 12), (3, 24))]
        rows += [(i, " ".join(words(r, 40) + p + words(r, 40))) for i in (9, 10)]
        got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert [(g["doc_id"], g["source_id"], g["n_words"]) for g in got] == [(10, 9, 60)]


def test_every_equal_run_of_fifty_words_is_found(spark):
    """Brute force over documents that share pieces of a few passages."""
    r = random.Random(31)
    pool = [words(r, 150) for _ in range(6)]
    docs = []
    for _ in range(90):
        w = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(pool)
            s = r.randrange(110)
            w += words(r, r.randint(5, 40)) + p[s:s + r.choice([20, 35, 50, 51, 70])]
        docs.append(w + words(r, 10))
    got = substring.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    found = {}
    for g in got:
        found.setdefault(g["doc_id"], set()).update(range(g["start_word"], g["start_word"] + g["n_words"]))
    seen = set()
    for i, w in enumerate(docs):
        runs = [tuple(w[s:s + 50]) for s in range(len(w) - 49)]
        for s, run in enumerate(runs):
            if run in seen:  # explained but for less than NEW words in a row
                missing = [k for k in range(s, s + 50) if k not in found.get(i, set())]
                assert not any(b - a == substring.NEW - 1 for a, b in zip(missing, missing[substring.NEW - 1:])), (i, s)
        seen |= set(runs)


def test_recall_of_changed_passages(spark):
    """60 words, a share of them replaced; recall through the whole operator."""
    r = random.Random(41)
    rows, n = [], 80
    for k, share in enumerate((0.1, 0.15)):
        for i in range(n):
            p = words(r, 60)
            q = list(p)
            for at in r.sample(range(1, 59), round(60 * share)):
                q[at] = "changed"
            rows += [(k * 1000 + i, " ".join(words(r, 50) + p + words(r, 50))), (k * 1000 + 500 + i, " ".join(words(r, 50) + q + words(r, 50)))]
    got = {g["doc_id"] for g in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(500 <= g < 1000 for g in got) >= 0.97 * n and sum(g >= 1500 for g in got) >= 0.9 * n


def test_two_texts_of_one_id_and_clashing_names(spark):
    r = random.Random(51)
    p, q = " ".join(words(r, 70)), " ".join(words(r, 120))
    rows = [(1, p, 1), (2, p, 2), (2, q, 3), (None, p, 4), (3, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    for c in ("_key", "_id", "_bad", "_copies", "_spans", "a.b", "doc", "v", "t", "spans"):
        df = df.withColumn(c, F.lit("clash"))
    kept = substring.drop_repeats(df)
    assert kept.columns == df.columns
    assert sorted(((x["doc_id"] or 0), x["text"] or "", x["n_chars"], x["a.b"]) for x in kept.collect()) == sorted(
        [(1, p, 1, "clash"), (2, q, 3, "clash"), (0, p, 4, "clash"), (3, "", 5, "clash")])


def test_shared_texts_just_short_of_a_passage(spark):
    r = random.Random(61)
    rows = []
    for n in range(36, 50):
        p = words(r, n)
        rows += [(100 * n + 1, " ".join(p + words(r, 1))), (100 * n + 2, " ".join(words(r, 1) + p))]
    assert substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
