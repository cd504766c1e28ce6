import re

import corpus_pipeline
import __spark_entry__ as entry
from conftest import SF001
from quotelens.llm import near_dedup
from .test_near_dedup import brute


def test_stages_do_their_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    extra = spark.createDataFrame([(90_001, "12 34 !!", None, "s", 8), (90_002, None, None, "s", None)], docs.schema)
    docs = docs.union(extra)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF001).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen.append((name, before, docs))
    by = {name: (before, after) for name, before, after in seen}
    assert [n for n, *_ in seen] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    for name, (before, after) in by.items():
        assert name == "bpe" or after.columns == before.columns
    ids = {n: {r["doc_id"] for r in after.select("doc_id").collect()} for n, (_, after) in by.items()}
    lettered = {r["doc_id"] for r in by["language_id"][0].collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])}
    assert ids["language_id"] == lettered
    rows = [(r["doc_id"], r["text"]) for r in by["near_dedup"][0].collect()]
    want = brute(rows, 5, 80)
    assert ids["near_dedup"] == {i for i, (_, c) in want.items() if c == i}
    assert ids["decontamination"] <= ids["substring_dedup"] <= ids["near_dedup"]
    first = {}
    for r in sorted(by["substring_dedup"][1].collect()):  # no run of 60 words is left twice
        w = near_dedup.words_of(r["text"])
        assert r["n_chars"] == len(r["text"])
        for j in range(len(w) - 59):
            assert first.setdefault(tuple(w[j:j + 60]), r["doc_id"]) == r["doc_id"]
    assert ids["bpe"] == ids["decontamination"]


def test_registered_once_each():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert corpus_pipeline.ORACLE_SQL is None and callable(corpus_pipeline.run)


def test_stages_take_any_column_names(spark):
    from pyspark.sql import functions as F

    from quotelens.llm import decontam, near_dedup
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, words), (2, words), (2, words), (3, words + " x"), (None, words), (4, None), (4, None), (5, ""), (6, "quite another text, all alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_key", "_id", "_bad", "_copies", "_ck", "_spans", "a.b", "key", "node"):
        df = df.withColumn(c, F.lit("clash"))
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.where("_key != 'clash' or `a.b` != 'clash'").count() == 0
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 6]
    items = spark.createDataFrame([(7, "quite another text, all alone here")], "item_id long, text string")
    clean = decontam.decontaminate(df, items)
    assert clean.columns == df.columns and clean.count() == len(rows) - 1
    assert decontam.decontaminate(df.limit(0), items).count() == 0 and near_dedup.drop_near_duplicates(df.limit(0)).count() == 0
