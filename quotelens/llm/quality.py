"""Quality scores from random-indexing word vectors, pooled per document,
and a two-layer network with temperature-calibrated probabilities.

Every term has a fixed sparse index vector of a few plus and minus ones that
its hash chooses; a term's word vector is the sum of the index vectors of its
neighbours. A document is the mean of its terms' word vectors. Terms are the
frequent words as written; a rare word stands as its shape (case, digits,
marks around it), and a word that repeats the one before as a repeat."""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches

DIM, NONZERO, WINDOW = 96, 6, 2
REPEAT = "<repeat>"


def shape(word: str) -> str:
    """Case, digits and marks of a word: runs of small letters as ``a``, of
    capitals as ``A``, of digits as ``0``, of another mark as that mark."""
    runs = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a",
                  word[:64])
    return "<" + re.sub(r"(.)\1+", r"\1", re.sub(r"\d+", "0", runs))[:8] + ">"


def index_vector(term: str) -> np.ndarray:
    """The term's sparse ternary index vector."""
    rng = np.random.default_rng(zlib.crc32(term.encode("utf-8", "surrogatepass")))
    v = np.zeros(DIM)
    v[rng.choice(DIM, NONZERO, replace=False)] = rng.choice((-1.0, 1.0), NONZERO)
    return v


class Terms(dict):
    """word -> term number, remembered for up to ``limit`` words; shapes that
    were not learned are the last number."""

    def __init__(self, terms: list[str], limit: int = 150_000):
        super().__init__()
        self.number = {t: i for i, t in enumerate(terms)}
        self.other, self.limit = len(terms), limit
        self.repeat = self.number.get(REPEAT, self.other)

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        got = self.number.get(word)
        if got is None:
            got = self.number.get(shape(word), self.other)
        self[word] = got
        return got

    def sequence(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        same = np.fromiter(map(eq, words, words[1:]), bool, max(0, len(words) - 1))
        ids[1:][same] = self.repeat
        return ids


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The mean word vector of a sequence (zeros if it is empty)."""
    if not len(ids):
        return np.zeros(vectors.shape[1])
    at, n = np.unique(ids, return_counts=True)
    return n @ vectors[at] / len(ids)


class Network:
    """Two layers (tanh, logit) with the temperature of its probabilities."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 120, seed: int = 5):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        cut = max(1, len(y) // 5) if len(y) > 4 else 0
        check, fit = order[:cut], order[cut:]
        self.mean, self.sd = x[fit].mean(0), x[fit].std(0) + 1e-6
        z = (x - self.mean) / self.sd
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
                  rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, step = [0.0] * 4, [0.0] * 4, 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                a = np.tanh(z[part] @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-(a @ self.w[2] + self.w[3]))) - y[part]) / len(part)
                back = d[:, None] * self.w[2] * (1 - a * a)
                grads = [z[part].T @ back + 1e-4 * self.w[0], back.sum(0), a.T @ d + 1e-4 * self.w[2], d.sum()[None]]
                step += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 3e-3 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
        self.temperature = 1.0
        if cut:  # the temperature of least log loss on rows that the weights have not seen
            raw, t = self.logit(x[check]), np.geomspace(0.25, 8, 61)
            loss = [np.mean(np.logaddexp(0, raw / k) - y[check] * raw / k) for k in t]
            self.temperature = float(t[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.sd @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = 8000, vocabulary: int = 2000) -> dict | None:
    """Learn terms, word vectors and network from a bounded sample.

    The sample is the ``sample`` labelled ids whose hashes are smallest, among
    those that are not held out (crc32 of the id modulo 4 is not 2); it is read
    as whole texts. The driver receives the ``vocabulary`` most frequent words
    and shapes, their vectors, and the sample's pooled vectors. Null labels
    teach nothing, an id with several labels has the larger one. None if no
    labelled text is found."""
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")) \
        .where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))) \
        .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id", F.lit(9)), "id").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    rows = texts.join(F.broadcast(marks), "id").where("t is not null").coalesce(16).cache()
    try:
        words = rows.select(F.explode(F.split("t", r"\s+")).alias("w")).where("w <> ''").groupBy("w").count()
        top = words.orderBy(F.desc("count"), "w").limit(vocabulary).collect()
        terms = [r["w"] for r in top]

        def shapes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([shape(w) for w in b.column(0).to_pylist()], pa.string()),
                                                  b.column(1)], ["w", "n"])
        forms = words.select("w", "count").mapInArrow(shapes, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
        terms += [r["w"] for r in forms.orderBy(F.desc("n"), "w").limit(vocabulary // 4).collect()]
        terms.append(REPEAT)
        model = {"terms": terms}
        index = np.array([index_vector(t) for t in terms] + [np.zeros(DIM)])

        def contexts(batches):
            number = Terms(terms)
            total = np.zeros(index.shape)
            for b in batches:
                for t in b.column(1).to_pylist():
                    ids = number.sequence(t)
                    for k in range(1, WINDOW + 1):
                        if len(ids) > k:
                            np.add.at(total, ids[k:], index[ids[:-k]])
                            np.add.at(total, ids[:-k], index[ids[k:]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total))], ["term", "v"])

        def add(table: pa.Table) -> pa.Table:
            v = np.sum(np.array(table.column("v").to_pylist()), axis=0)
            return pa.table({"term": table.column("term").slice(0, 1), "v": pa.array([v], pa.list_(pa.float64()))})

        sums = rows.mapInArrow(contexts, "term long, v array<double>").groupBy("term") \
            .applyInArrow(add, "term long, v array<double>").collect()
        vectors = np.zeros(index.shape)
        for r in sums:
            vectors[r["term"]] = r["v"]
        # own index vector besides the context, so that terms with like neighbours stay apart
        vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9) + index / NONZERO ** 0.5
        model["vectors"] = vectors.astype(np.float32)

        def pooled(batches):
            number = Terms(terms)
            for b in batches:
                got = [pool(number.sequence(t), model["vectors"]) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got, pa.list_(pa.float64()))],
                                                 ["id", "y", "v"])
        kind = dict(rows.dtypes)["id"]
        data = rows.mapInArrow(pooled, f"id {kind}, y int, v array<double>").collect()
    finally:
        rows.unpersist()
    if not data:
        return None
    data.sort(key=lambda r: (r["id"], r["v"]))
    model["network"] = vars(Network(np.array([r["v"] for r in data]), np.array([float(r["y"] > 0) for r in data])))
    return model


def score(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.7) -> DataFrame:
    """``doc_id, score double, predicted int`` per row: the probability that
    the label is 1, and 1 where it reaches ``threshold``.

    A null text counts as empty; an empty text has the score of the zero
    vector. Without a model every score is 0.5. Repeated rows and null ids are
    rows like others, other columns are not read, an empty table gives an
    empty result."""
    docs = small_batches(df).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        if m:
            number, net = Terms(m["terms"]), Network.__new__(Network)
            vars(net).update(m["network"])
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                if m:
                    x = np.array([pool(number.sequence(t), m["vectors"]) for t in part.column(1).to_pylist()])
                    p = net.score(x)
                else:
                    p = np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                                 ["doc_id", "score", "predicted"])
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")
