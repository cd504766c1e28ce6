from conftest import SF01
from quotelens.llm import quality, queries


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op9_random_indexing"](spark, SF01).join(
        spark.read.parquet(f"{SF01}/labels.parquet").select("doc_id", "quality"), "doc_id").toPandas()
    out = got[got.held_out]
    assert len(out) > 60 and (out.predicted == out.quality).mean() > 0.95
    low, high = out[out.quality == 0].score.values, out[out.quality == 1].score.values
    assert (high[:, None] > low[None, :]).mean() > 0.97
    assert (got.predicted == (got.score >= 0.7)).all()


def test_edge_cases(spark, small, empty):
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (3, 0), (None, 1), (5, 1), (7, 0)], "doc_id long, quality int")
    model = quality.fit(small, labels)
    got = quality.score(small, model).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert quality.fit(empty, labels) is None and quality.fit(small, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(small, None).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_shapes():
    assert quality.shape("Hello,") == "<Aa,>" and quality.shape("WORD!!") == "<A!>" and quality.shape("x%%%") == "<a%>"
    assert quality.shape("12") == "<0>"
