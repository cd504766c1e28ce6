import gc
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from conftest import SF001
from quotelens.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_lexicon_holds_words_and_nothing_else():
    words = {w.encode(): tuple(ids) for w, ids in {"the": [1], "then": [2, 3], "there": [1, 4], "bare": [9, 4], "": []}.items() if w}
    data = bpe.compile_lexicon(words)
    lex = bpe.Lexicon(data)
    assert all(lex.get(w) == list(ids) for w, ids in words.items())
    assert lex.get(b"th") is None and lex.get(b"theres") is None and lex.get(b"x") is None
    assert bpe.Lexicon(bpe.compile_lexicon({})).get(b"a") is None


def test_lexicon_shares_endings():
    endings = {f"{a}ation".encode(): (i, 7) for i, a in enumerate("bcdfghklm")}
    one = len(bpe.compile_lexicon({b"bation": (0, 7)}))
    assert len(bpe.compile_lexicon(endings)) < one + 40 * len(endings)


def test_codec_equals_the_library(library):
    codec, r = bpe.Codec(bpe.load_spec(PATH)), random.Random(2)
    pool = [chr(c) for c in [*range(1, 0x600), *range(0x1e00, 0x2100), 0x1F600, 0x2B73A, 0xAC00, 0x1100, 0x1161, 0x10D50]] + [
        "<|endoftext|>", "<|startoftext|>", " ", "'s", "'RE", "the", "\n", "Σ"] * 30
    texts = ["".join(r.choices(pool, k=r.randint(0, 50))) for _ in range(4000)] + ["", "abc" * 4000, "x" * 20_000 + " y", "<|endoftext|>"]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = codec.encode(t)
        assert ids == e.ids
        assert codec.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_ascii_runs_are_split_without_normalising(monkeypatch):
    codec, r = bpe.Codec(bpe.load_spec(PATH)), random.Random(4)
    want = {t: list(codec.words(t.lower())) for t in ("".join(r.choices("abzAZ019.,'!-_sS", k=r.randint(1, 9))) for _ in range(5000))}
    monkeypatch.setattr(codec, "normalise", None)
    assert all(list(codec.split(t)) == words for t, words in want.items())


def test_query_equals_the_library(spark, library):
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_bpe_digests"](spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"], add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        said = library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_edge_cases(small, empty, library):
    rows = bpe.encode(small, PATH, lexicon_size=10).collect()
    assert len(rows) == 9
    for r in rows:
        if r["doc_id"] in (2, 3, 4):
            assert r["ids"] == [] and r["n_tokens"] == 0 and r["decoded"] == ""
    long = next(r for r in rows if r["doc_id"] == 5)
    assert long["n_tokens"] == 40_000
    assert bpe.encode(empty, PATH).count() == 0


def test_other_tokenizer_files_are_refused():
    with pytest.raises((ValueError, KeyError)):
        bpe.load_spec(public_tokenizers.path("byte_bpe_50k.json"))


def test_codec_ends_with_its_task(spark, monkeypatch):
    df = spark.createDataFrame([(1, "some plain words"), (2, None)], "doc_id long, text string")
    given = []
    real = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **k: given.append(f) or real(self, f, *a, **k))
    bpe.digests(df, PATH)

    def codecs():
        gc.collect()
        return sum(type(x).__name__ == "Codec" for x in gc.get_objects())

    before = codecs()
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["some plain words", None]})
    rows = [r for b in given[-1]([batch]) for r in b.to_pylist()]
    assert [r["n_tokens"] for r in rows] == [len(bpe.Codec(bpe.load_spec(PATH)).encode("some plain words")), 0]
    assert codecs() == before  # an idle worker holds neither tables nor remembered words
