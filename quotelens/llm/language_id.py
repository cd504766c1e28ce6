"""Language identification by cross-parsing entropy.

A suffix automaton per language holds every substring of that language's
learned words. A text is parsed word by word against each automaton into
the fewest phrases (each phrase the longest match from where the last ended;
a character that the automaton lacks is a phrase of its own). A phrase costs
the logarithm of the learned text's length, so the phrases are normalised by
it; the language with the fewest bits wins."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, held_out, small_batches

UNDETERMINED = "und"


class SuffixAutomaton:
    """All substrings of the words added; ``step[state]`` maps a character to
    the next state, state 0 is the empty string."""

    def __init__(self):
        self.step: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.size = 0

    def _state(self, step: dict, link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def add(self, word: str) -> None:
        """Add one word; matches never run from one word into another."""
        step, link, length = self.step, self.link, self.length
        last = 0
        for c in word:
            self.size += 1
            q = step[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                new, p = self._state({}, 0, length[last] + 1), last
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
            else:
                new, p = None, last
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    target = q
                else:
                    target = self._state(dict(step[q]), link[q], length[p] + 1)
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = target
                        p = link[p]
                    link[q] = target
                if new is None:
                    new = target
                else:
                    link[new] = target
            last = new

    def phrases(self, word: str) -> int:
        """Into how many longest matches ``word`` parses."""
        step, root, at, n = self.step, self.step[0], {}, 0
        for c in word:
            q = at.get(c)
            if q is None:  # the phrase ends before c, and c begins the next
                n += 1
                q = root.get(c)
            at = {} if q is None else step[q]
        return n


class Model:
    """The automata of the learned languages and the memory of parsed words."""

    LETTERS = r"[^\W\d_]+"

    def __init__(self, words: dict[str, list[str]], limit: int = 150_000):
        self.langs = sorted(words)
        self.automata = []
        for lang in self.langs:
            a = SuffixAutomaton()
            for w in words[lang]:
                a.add(f" {w} ")
            self.automata.append(a)
        self.bits = [math.log2(max(2, a.size)) for a in self.automata]
        self.letters = re.compile(self.LETTERS).findall
        self.limit = limit
        self.by_word: dict[str, tuple] = {}
        self.by_chunk: dict[str, tuple] = {}

    def _word(self, w: str) -> tuple:
        got = self.by_word.get(w)
        if got is None:
            s = f" {w} "
            got = (1, *[a.phrases(s) for a in self.automata])
            if len(w) < 64:
                if len(self.by_word) >= self.limit:
                    self.by_word.clear()
                self.by_word[w] = got
        return got

    def _chunk(self, c: str) -> tuple:
        rows = [self._word(w.lower()) for w in self.letters(c)]
        got = rows[0] if len(rows) == 1 else tuple(map(sum, zip(*rows))) if rows else ()
        if len(c) < 64:
            if len(self.by_chunk) >= self.limit:
                self.by_chunk.clear()
            self.by_chunk[c] = got
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        """``(language, score)`` of a whole text."""
        get, make, rows = self.by_chunk.get, self._chunk, []
        for c in (text or "").split():
            r = get(c)
            if r is None:
                r = make(c)
            if r:
                rows.append(r)
        if not rows or not self.langs:
            return UNDETERMINED, 0.0
        n, *phrases = map(sum, zip(*rows))
        cost = [p * b / n for p, b in zip(phrases, self.bits)]
        best = min(range(len(cost)), key=cost.__getitem__)
        return self.langs[best], 1.0 / sum(2.0 ** (cost[best] - c) for c in cost)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        docs_per_language: int = 400, words_per_language: int = 3000) -> dict[str, list[str]]:
    """Learn each language's words from a bounded sample of labelled rows.

    Rows that are held out (crc32 of the id modulo 4 is 2), without label or
    without text teach nothing. The sample is the ``docs_per_language`` rows
    of each language whose id hashes are smallest, as whole texts; of their
    words the ``words_per_language`` most frequent are learned (ties: smaller
    word). Those words are all that reaches the driver; without any labelled
    row there are none."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"),
                     F.col(f"`{lang_col}`").cast("string").alias("l")) \
        .where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("id")))
    keys = rows.select("id", "l", F.xxhash64("id", F.lit(11)).alias("h")).distinct()
    for group in (("l", F.pmod("h", F.lit(64))), ("l",)):
        keys = keys.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("h", "id"))) \
            .where(F.col("r") <= docs_per_language).drop("r")
    picked = rows.join(F.broadcast(keys.drop("h")), [rows["id"].eqNullSafe(keys["id"]), rows["l"] == keys["l"]],
                       "left_semi")
    words = picked.select("l", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")) \
        .groupBy("l", "w").count()
    best = Window.partitionBy("l").orderBy(F.desc("count"), "w")
    top = words.withColumn("r", F.row_number().over(best)).where(F.col("r") <= words_per_language).collect()
    found: dict[str, list[str]] = {}
    for r in sorted(top, key=lambda r: (r["l"], r["r"])):
        found.setdefault(r["l"], []).append(r["w"])
    return found


def identify(df: DataFrame, words: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred string, score double`` per row.

    ``lang_pred`` is a learned language (ties: the smaller name), or ``und``
    with score 0 where the text is null or has no letter, or nothing was
    learned. The score is the winner's share of 2 to the minus bits a word.
    Repeated rows and null ids are rows like others; an empty table gives an
    empty result; other columns are not read."""
    shared = df.sparkSession.sparkContext.broadcast(words)
    docs = small_batches(df).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        model = Model(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got = [model.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                    ["doc_id", "lang_pred", "score"])
    return docs.mapInArrow(giving_back(run), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def drop_undetermined(df: DataFrame, words: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a language, with all their columns.
    A null, empty or letterless text has none, and its row goes; ids are not
    read, repeated rows stay repeated, an empty table stays empty."""
    shared = df.sparkSession.sparkContext.broadcast(words)
    at = df.columns.index(text_col)

    def run(batches):
        model = Model(shared.value)
        for b in batches:
            for first in range(0, b.num_rows, 512):
                part = b.slice(first, 512)
                known = [model.predict(t)[0] != UNDETERMINED for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(known, pa.bool_()))
    return small_batches(df).mapInArrow(giving_back(run), df.schema)
