import random

import pyspark.sql.functions as F

from conftest import SF01
from quotelens.llm import language_id, queries


def test_phrases_are_longest_matches():
    r = random.Random(1)
    words = ["".join(r.choices("abc", k=r.randint(1, 8))) for _ in range(50)]
    a = language_id.SuffixAutomaton()
    for w in words:
        a.add(w)
    known = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    for _ in range(3000):
        w = "".join(r.choices("abcd", k=r.randint(1, 12)))
        n = i = 0
        while i < len(w):
            j = i
            while j < len(w) and w[i:j + 1] in known:
                j += 1
            i, n = max(j, i + 1), n + 1
        assert a.phrases(w) == n


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op1_cross_parsing"](spark, SF01).join(
        spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert len(out) > 150 and (out.lang == out.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_edge_cases(spark, small, empty):
    words = {"en": ["hello", "there", "word"], "fr": ["bonjour"]}
    rows = language_id.identify(small, words).collect()
    assert len(rows) == 9
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und == {2, 3, 4, 6} and all(r["score"] == 0 for r in rows if r["doc_id"] in und)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 5)} == {"en"}
    assert language_id.identify(empty, words).count() == 0
    assert language_id.fit(empty) == {}
    assert {r["lang_pred"] for r in language_id.identify(small, {}).collect()} == {"und"}
    kept = language_id.drop_undetermined(small, words)
    assert kept.columns == small.columns and kept.count() == 5
    learned = language_id.fit(small)
    assert set(learned) <= {"en", "fr"}
    assert language_id.fit(small.withColumn("lang", F.lit(None).cast("string"))) == {}
