import random

import public_tokenizers
import pytest
import regex
from conftest import SF001
from tokenizers import Tokenizer

from quotelens.llm import queries, token_counts


PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(token_counts.load_spec(PATH))


def tokens(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


TEXTS = ["", "a", "Hello world, it's 2024!!  We're  here.", "a  b   c\n\n\nd \t e ", "they'll've 'r 're 'x'", "<|endoftext|>",
         "end!  <|endoftext|><|endoftext|> \n<|endoftext|", "!!!<|endoftext|>!!!", "là où ça va  bien x", "日本語 \U0001f600\U0001f600 ½ ١٢",
         "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 70 + "-" * 33 + " " * 40 + "x" + "\n" * 9 + " y", "\x1c\x1d a\x1f  \x85b"]


def test_every_prefix_is_counted_as_the_library_does(library, counter):
    rng = random.Random(2)
    alphabet = ["a", "b", "e", "th", "ing", " ", "  ", "\n", "\t", "'s", "'re", "'l", "'", "1", "23", ".", "!!", "é", "ß", "中", "\U0001f642",
                " ", " ", "<|endoftext|>", "<|end", "The", " the", "́", "กำ", "\x1d"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    for text in texts:
        counts = counter.counts(text).tolist()
        assert counts == [tokens(library, text[:i]) for i in range(len(text) + 1)], text


def test_every_token_is_one_token(counter):
    assert all(counter.prefix_counts(t)[-1] == 1 for t in counter.vocab)


def test_every_character(library, counter):
    known = regex.compile(r"[\p{L}\p{N}\s]").match  # of the rest, which is all alike, one in sixteen
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 16 == 0 or known(chr(c)))]
    for at in range(0, len(chars), 1024):
        text = "".join(f"a{c}1 {c}" for c in chars[at:at + 1024])
        if counter.counts(text)[-1] != tokens(library, text):
            assert [c for c in chars[at:at + 1024] if counter.counts(f"a{c}1 {c}")[-1] != tokens(library, f"a{c}1 {c}")] == []


def test_query_equals_the_library(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_prefix_counts(spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        n, r = tokens(library, text or ""), got[doc_id]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), n, n > 512)
        if n > 512:
            assert tokens(library, text[:r["fit_chars"]]) <= 512 < tokens(library, text[:r["fit_chars"] + 1])
        else:
            assert r["fit_chars"] == len(text or "")


def test_stored_counts_answer_budgets_and_cuts(spark, library, counter):
    texts = [(1, "It's a tale.  Told by an idiot. " * 400), (2, None), (3, "short"), (1, "other text of one id"), (None, "no id")]
    table = token_counts.prefix_table(spark.createDataFrame(texts, "doc_id long, text string"), PATH).cache()
    assert table.where("size(counts) > 4096").count() == 0
    fit = {(r["doc_id"], r["fit_chars"]) for r in token_counts.longest_within(table, 1500).collect()}
    long = counter.counts(texts[0][1])
    most = max(i for i, c in enumerate(long) if c <= 1500)
    assert fit == {(1, most), (2, 0), (3, 5), (1, 20), (None, 5)}
    cuts = [(1, 0), (1, 7), (1, 4095), (1, 4096), (1, 9000), (1, 10 ** 9), (3, 5), (3, 6), (2, 0), (1, -1), (None, 1)]
    got = {tuple(r) for r in token_counts.counts_at(table, spark.createDataFrame(cuts, "doc_id long, n_chars long"))
           .select("doc_id", "n_chars", "n_tokens").collect()}
    want = {(i, n, tokens(library, t[:n])) for i, n in cuts for j, t in texts
            if i == j and i is not None and 0 <= n <= len(t or "") for t in [t or ""]}
    assert got == want


def test_edge_rows(spark, small, empty, library):
    got = sorted([tuple(r) for r in token_counts.count_tokens(small, PATH, 512).collect()], key=str)
    want = []
    for r in small.collect():
        t = r["text"] or ""
        n = tokens(library, t)
        fit = len(t) if n <= 512 else max(i for i in range(3000) if tokens(library, t[:i]) <= 512)
        want.append((r["doc_id"], len(t.encode()), len(t), n, n > 512, fit))
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(empty, PATH, 512).count() == 0
    assert token_counts.prefix_table(empty, PATH).count() == 0


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.load_spec(public_tokenizers.path("word_bpe_49k.json"))
