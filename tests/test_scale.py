"""What was rewritten to scale against the plain form it stands for: trees by
struck-out places, cells as lists, fits made alone, descriptions parsed on parts."""

import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quotelens.operators import enrich as EN
from quotelens.operators import linear as LN
from quotelens.operators import models as M
from quotelens.operators import trees as TR
from quotelens.sources.quotes import quotes_from_tables


def made(spark, n=400):
    day = datetime.datetime(2024, 1, 1)
    li = [(i // 3, (i * 7) % 41, i % 5, i % 3 + 1, float(i % 50 + 1), 10.0 + i, (i % 7) / 100, day + datetime.timedelta(days=i % 60)) for i in range(n)]
    li += [li[0], (1, None, 2, 1, 3.0, 4.0, 0.01, day), (2, 3, None, 1, None, None, None, None)]  # a row twice, null keys and values
    orders = [(k, day - datetime.timedelta(days=k % 9), ["1-URGENT", "5-LOW", None][k % 3]) for k in range(n // 3)] + [(5, day, "1-URGENT"), (None, day, None)]
    part = [(k, f"Brand#{10 + k % 20}", ["SMALL", "ECONOMY", "PROMO", None][k % 4], k % 13) for k in range(40)] + [(7, "Brand#25", "LARGE", 9), (8, None, None, None)]
    return (spark.createDataFrame(li, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                      "l_extendedprice double, l_discount double, l_shipdate timestamp"),
            spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp, o_orderpriority string"),
            spark.createDataFrame(part, "p_partkey long, p_brand string, p_type string, p_size int"))


def test_descriptions_parsed_on_parts_give_the_same_quotes(spark):
    tables = made(spark)
    got, want = EN.enriched_from_tables(*tables), EN.enriched_quotes(quotes_from_tables(*tables))
    assert got.columns == want.columns and got.count() == want.count() > 400
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice#") and sum("l_orderkey" in x and "Relation" in x or "LogicalRDD [l_orderkey" in x for x in plan.splitlines()) == 1


def keys(n=3000):
    rng = np.random.default_rng(3)
    k = np.zeros(n, np.int64)
    for f in TR.FIELDS:
        k = (k << TR._width(f)) + rng.integers(0, min(6, 1 << TR._width(f)), n)
    return np.unique(k)


def test_struck_out_places_lead_to_the_leaves_of_a_walk():
    k = keys()
    rng = np.random.default_rng(5)
    n, s = rng.integers(1, 9, len(k)).astype(float), rng.normal(size=len(k))
    g = TR.Grower(TR.unpack(k), (), rng)
    for depth in (1, 3, 4):
        f, c, v, _ = g.tree(s, n, depth, 5, 1.0, np.arange(len(g.used)), slice(0, len(k)))
        assert np.array_equal(g.apply(f, c, v, depth), g.walk(f, c, v, depth))
    f[:] = -1
    assert np.array_equal(g.apply(f, c, v, 4), np.full(len(k), v[0]))
    part = slice(40, 900)
    assert np.array_equal(g.marks(part), g.marks(slice(0, len(k)))[part]) and (g.marks(part).sum(1) == len(g.used)).all()


def test_scores_equal_walks_exactly():
    import pandas as pd
    k = keys()
    y = np.random.default_rng(7).lognormal(size=len(k))
    n = np.ones(len(k))
    old = dict(TR.SPECS)
    try:
        for m in ("M5", "M7"):
            TR.SPECS[m] = (old[m][0], 12, *old[m][2:])
        nodes = pd.concat([pd.DataFrame(TR._rows("M5", -1, 0, k[:2000], n[:2000], y[:2000], y[:0])),
                           pd.DataFrame(TR._rows("M7", -1, 0, k[:2000], n[:2000], np.log(y[:2000]), np.log(y[:2000]) ** 2))])
    finally:
        TR.SPECS.update(old)
    forests = TR.Forests(nodes)
    x = TR.unpack(k)
    for fit in forests.fits:
        assert np.array_equal(forests.raw(fit, x), forests.walk(fit, x))
        assert len(forests.raw(fit, x[:0])) == 0


def test_lists_of_cells_are_the_sums_over_the_other_folds(spark):
    q = EN.enriched_from_tables(*made(spark))
    pdf = TR.cells(q).toPandas()
    got = TR._blocks(q, [(-1, 2, True), (-1, TR.ALL, False), (1, 2, False)]).toPandas()
    for (part, fit, log), rows in got.groupby(["part", "fit", "log"]):
        want = pdf[(pdf.fold != fit) & ((part < 0) | (pdf.estimator_code == part))].groupby("key")[["n", "y", "ly", "ly2"]].sum()
        k = np.concatenate(rows.key.to_list())
        assert sorted(k) == list(want.index)
        want = want.loc[k]
        assert np.allclose(np.concatenate(rows.n.to_list()), want.n) and np.allclose(np.concatenate(rows.s.to_list()), want.ly if log else want.y)
        assert np.allclose(np.concatenate(rows.s2.to_list()), want.ly2) if log else not np.concatenate(rows.s2.to_list()).size


def test_models_scored_alone_need_no_other_tables(spark):
    q = EN.enriched_from_tables(*made(spark)).dropna()
    wide = M.score_wide(q, {"linear": M.linear_table(q)}, models=M.LINEAR)
    assert M.scored_models(wide) == M.LINEAR and wide.count() == q.count()


def test_arrow_matrix_keeps_nulls_as_nan():
    batch = pa.RecordBatch.from_arrays([pa.array([1.0, None]), pa.array([2.0, 3.0])], ["a", "b"])
    assert np.array_equal(LN.matrix(batch, ["b", "a"]), [[1, 2, 1], [1, 3, np.nan]], equal_nan=True)
