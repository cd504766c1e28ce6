import numpy as np

from quotelens.llm import topk


def brute(rows, k, scale=64):
    good = [(i, np.floor(scale * np.array(v, float)).astype(int)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in good:
        if q % 20 == 0:
            best = sorted(((-int(v @ w), j) for j, w in good if j != q and len(w) == len(v)))[:k]
            out |= {(q, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_equals_brute_force_over_many_buckets(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 12)) * rng.gamma(2, 1, size=(600, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(600 + i, rows[i % 7][1]) for i in range(300)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = rows_of(topk.top_k(df, 20, is_query=lambda i: i % 20 == 0, bucket_rows=50, query_rows=16))
    assert len(got) == len(set(got)) and set(got) == brute(rows, 20)


def test_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (None, [1.0, 1.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]),
            (20, [-1.0, 0.0]), (5, [0.0, 0.0]), (40, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = rows_of(topk.top_k(df, 20, is_query=lambda i: i % 20 == 0))
    assert set(got) == brute(rows, 20) and len(got) == 6
    assert topk.top_k(df.limit(0)).count() == 0
