"""BPE encoding and decoding with a memory-mapped word transducer.

Frequent words are compiled, with the ids that the merges give them, into a
minimal acyclic transducer: words share prefixes, and every two states with
the same continuations and the same remaining ids are one state, so common
endings are stored once. The compiled file goes to the shared folder, Spark
hands it to every executor, and each Python worker maps it into memory. A
word that the lexicon does not hold is merged exactly, lowest rank first."""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import unicodedata
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, giving_back, small_batches, stage, write_shared_bytes

# Letters and numbers that newer Unicode tables add and the tokenizers library does not know as such.
UNKNOWN_LETTERS = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 "
    "a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11df1-11df1 "
    "16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 "
    "1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 "
    "1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f")
UNKNOWN_NUMBERS = "11de0-11de9 1246f-1246f 12475-1247f 12550-12686 16ff4-16ff6"
# Capitals that the library lowers and older Unicode tables do not: first, last, lower case of the first.
NEW_CAPITALS = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
                (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
                (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))
LOWER = {0x3A3: 0x3C3} | {c: low + c - a for a, b, low in NEW_CAPITALS for c in range(a, b + 1)}


def _ranges(text: str) -> str:
    return "".join("\\U%08x-\\U%08x" % tuple(int(x, 16) for x in r.split("-")) for r in text.split())


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where it is printable in
    Latin-1, else the next free one from U+0100."""
    plain = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def load_spec(path: str) -> dict:
    """What encoding needs from a tokenizer file with word ends. Raises where
    the file asks for steps that this module does not know."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    steps = [n["type"] for part in ("normalizer", "pre_tokenizer") for n in
             (j[part] or {}).get("normalizers", []) + (j[part] or {}).get("pretokenizers", [])]
    if steps != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or j["decoder"] or j["post_processor"]:
        raise ValueError(f"{path} is not a word-end BPE file of the known kind")
    split = j["pre_tokenizer"]["pretokenizers"][0]
    if split["behavior"] != "Removed" or not split["invert"]:
        raise ValueError(f"{path} splits in an unknown way")
    m = j["model"]
    added = {t["content"]: t["id"] for t in j["added_tokens"]}
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
    return {"vocab": m["vocab"], "ranks": {p: i for i, p in enumerate(pairs)}, "end": m["end_of_word_suffix"],
            "added": added, "pattern": split["pattern"]["Regex"]}


class Lexicon:
    """Reader of a compiled transducer (see ``compile_lexicon``)."""

    HEAD = "<4q"  # states, arcs, outputs, ids

    def __init__(self, buffer):
        n, arcs, outs, ids = struct.unpack_from(self.HEAD, buffer, 0)
        at = struct.calcsize(self.HEAD)
        view = []
        for count in (n + 1, n, arcs, arcs, outs + 1, ids):
            view.append(memoryview(buffer)[at:at + 4 * count].cast("i"))
            at += 4 * count
        self.first, self.final, self.target, self.out, self.start, self.ids = view
        self.buffer, self.labels = buffer, at

    @classmethod
    def open(cls, path: str) -> "Lexicon":
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def _output(self, k: int) -> list[int]:
        return self.ids[self.start[k]:self.start[k + 1]].tolist()

    def get(self, word: bytes) -> list[int] | None:
        """The ids of ``word``, or None if the lexicon does not hold it."""
        state, got, find, base = 0, [], self.buffer.find, self.labels
        first, target, out = self.first, self.target, self.out
        for i in range(len(word)):
            at = find(word[i:i + 1], base + first[state], base + first[state + 1])
            if at < 0:
                return None
            at -= base
            if out[at]:
                got += self._output(out[at])
            state = target[at]
        if self.final[state] < 0:
            return None
        return got + self._output(self.final[state])


def compile_lexicon(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """Compile ``word -> ids`` into a minimal acyclic transducer.

    Every prefix's common ids are pushed towards the start; then states are
    merged from the ends: same final ids, same arcs, same outputs."""
    root: dict = {}
    for w, ids in words.items():
        node = root
        for b in w:
            node = node.setdefault(b, {})
        node[-1] = tuple(ids)
    known: dict = {}
    states: list = []

    def common(a: tuple, b: tuple) -> tuple:
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return a[:n]

    def settle(kids: list, final) -> tuple[tuple, int]:
        """(ids common to all that follow, state) of a node with settled kids."""
        outs = [o for _, o, _ in kids] + ([final] if final is not None else [])
        lead = outs[0] if outs else ()
        for o in outs[1:]:
            lead = common(lead, o)
        n = len(lead)
        sign = (None if final is None else final[n:], tuple((b, o[n:], t) for b, o, t in kids))
        if sign not in known:
            known[sign] = len(states)
            states.append(sign)
        return lead, known[sign]

    # post-order walk without recursion
    stack = [(None, root, iter(sorted(k for k in root if k >= 0)), [])]
    while True:
        label, node, todo, kids = stack[-1]
        b = next(todo, None)
        if b is not None:
            kid = node[b]
            stack.append((b, kid, iter(sorted(k for k in kid if k >= 0)), []))
            continue
        lead, state = settle(kids, node.get(-1))
        stack.pop()
        if not stack:
            break
        stack[-1][3].append((label, lead, state))
    # the root keeps what is common to all words on its arcs
    final, arcs = states[state]
    states.append((None if final is None else lead + final, tuple((b, lead + o, t) for b, o, t in arcs)))
    order = [len(states) - 1, *range(len(states) - 1)]
    place = {s: i for i, s in enumerate(order)}
    outs: dict[tuple, int] = {(): 0}
    first, last, target, out, labels = [0], [], [], [], bytearray()
    for s in order:
        final, arcs = states[s]
        last.append(-1 if final is None else outs.setdefault(final, len(outs)))
        for b, o, t in arcs:
            labels.append(b)
            out.append(outs.setdefault(o, len(outs)))
            target.append(place[t])
        first.append(len(target))
    start = np.cumsum([0] + [len(o) for o in outs], dtype="<i4")
    pool = np.fromiter(chain.from_iterable(outs), "<i4")
    parts = [np.asarray(x, "<i4").tobytes() for x in (first, last, target, out, start, pool)]
    return struct.pack(Lexicon.HEAD, len(order), len(target), len(outs), len(pool)) + b"".join(parts) + bytes(labels)


class Codec:
    """Encoder and decoder of one tokenizer file; ``lexicon`` may be None."""

    LONG = 48  # symbols from which merging keeps a heap

    def __init__(self, spec: dict, lexicon: Lexicon | None = None, limit: int = 200_000):
        self.spec, self.lexicon, self.limit = spec, lexicon, limit
        self.alphabet = byte_alphabet()
        self.added = spec["added"]
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") \
            if self.added else None
        letters, numbers = _ranges(UNKNOWN_LETTERS), _ranges(UNKNOWN_NUMBERS)
        pattern = spec["pattern"].replace(r"[\p{L}]+", f"[\\p{{L}}--[{letters}]]+") \
            .replace(r"[\p{N}]", f"[\\p{{N}}--[{numbers}]]") \
            .replace(r"[^\s\p{L}\p{N}]+", f"[[^\\s\\p{{L}}\\p{{N}}]||[{letters}{numbers}]]+")
        self.words = regex.compile(pattern, regex.V1).findall
        self.space = regex.compile(r"\s+")
        self.odd_space = re.compile("[\x1c-\x1f]")
        # what was met lately; a full memory becomes the old one, from which what is met again returns
        self.by_chunk: dict[str, tuple] = {}
        self.by_word: dict[str, tuple] = {}
        self.old_chunk, self.old_word = self.by_chunk, self.by_word
        size = max([*spec["vocab"].values(), *self.added.values()]) + 1
        self.token: list[str] = [""] * size
        for t, i in chain(spec["vocab"].items(), self.added.items()):
            self.token[i] = t
        self.digits = [str(i) for i in range(size)]
        vocab, end = spec["vocab"], spec["end"]
        # pairs of ids to the rank of their merge and, in the low bits, the id that it makes
        self.joined = {vocab[a] << 20 | vocab[b]: r << 20 | vocab[a + b] for (a, b), r in spec["ranks"].items()}
        self.plain = [vocab[c] for c in self.alphabet]
        self.final = [vocab[c + end] for c in self.alphabet]
        self.same = list(range(size))  # one object for each id, so that remembered ids share them

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if max(text) >= "\u1c89" or "\u03a3" in text:
                text = text.translate(LOWER)
        return text.lower()

    def merge(self, word: str) -> list[int]:
        """The ids of one word by the merges alone."""
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) <= self.LONG:
            ids = [self.plain[b] for b in raw]
            ids[-1] = self.final[raw[-1]]
            get, none = self.joined.get, 1 << 62
            of = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
            while of and (best := min(of)) < none:
                i = of.index(best)
                ids[i:i + 2] = [best & 0xFFFFF]
                del of[i]
                if i < len(of):
                    of[i] = get(ids[i] << 20 | ids[i + 1], none)
                if i:
                    of[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
            return ids
        sym = [self.alphabet[b] for b in raw]
        sym[-1] += self.spec["end"]
        ranks, vocab = self.spec["ranks"], self.spec["vocab"]
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(sym, sym[1:])) if (r := ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if sym[i] is None or j >= len(sym) or (sym[i], sym[j]) != p:
                continue
            sym[i], sym[j] = sym[i] + sym[j], None
            after[i] = k = after[j]
            if k < len(sym):
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < len(sym) and (r := ranks.get((sym[a], sym[b]))) is not None:
                    heapq.heappush(heap, (r, a, (sym[a], sym[b])))
        return [vocab[s] for s in sym if s is not None]

    def word(self, word: str) -> tuple:
        got = self.by_word.get(word)
        if got is None:
            got = self.old_word.get(word)
            if got is None:
                if self.lexicon is not None:
                    got = self.lexicon.get(word.encode("utf-8", "surrogatepass"))
                got = tuple(map(self.same.__getitem__, self.merge(word) if got is None else got))
            if len(word) < 64:
                self.by_word[word] = got
        return got

    def split(self, part: str) -> list[str] | tuple:
        """The words of a run without white space and added tokens, normalised."""
        if part.isascii():
            part = part.lower()
            if part.isalpha():
                return (part,)
            word = part.rstrip(",.")
            if len(word) == len(part) - 1 and word.isalpha():
                return word, part[-1]
            return self.words(part)
        part = self.normalise(part)
        if part.isalpha():
            return (part,) if max(part) < "\u0558" else self.words(part)
        if part[-1] in ",." and part[:-1].isalpha() and max(part) < "\u0558":
            return part[:-1], part[-1]
        return self.words(part)

    def chunk(self, chunk: str) -> tuple:
        """The ids of a run without white space; a run is remembered once its
        words are, so that what occurs once is held once."""
        got, met = self.old_chunk.get(chunk), len(self.by_word)
        if got is None:
            got = ()
            for part in self.cut.split(chunk) if self.cut and "<" in chunk else (chunk,):
                if part in self.added:
                    got += (self.added[part],)
                elif part:
                    for w in self.split(part):
                        got += self.word(w)
        if len(chunk) < 64 and met == len(self.by_word):
            self.by_chunk[chunk] = got
        return got

    def chunks(self, text: str) -> list[str]:
        return self.space.split(text) if self.odd_space.search(text) else text.split()

    def encode(self, text: str | None) -> list[int]:
        if len(self.by_chunk) >= self.limit:
            self.by_chunk, self.old_chunk = {}, self.by_chunk
        if len(self.by_word) >= self.limit:
            self.by_word, self.old_word = {}, self.by_word
        got, get, make = [], self.by_chunk.get, self.chunk
        for c in self.chunks(text or ""):
            ids = get(c)
            got += make(c) if ids is None else ids
        return got

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.token.__getitem__, ids))


def word_counts(df: DataFrame, spec: dict, text_col: str) -> DataFrame:
    """``word, n``: how often each word of the texts occurs, over all rows."""
    share = df.sparkSession.sparkContext.broadcast(spec)

    def count(batches):
        codec, seen = Codec(share.value), Counter()

        def flush():
            got: Counter = Counter()
            for c, n in seen.items():
                if c.isascii() and c.isalpha():
                    if len(c) < 64:
                        got[c.lower()] += n
                    continue
                for part in codec.cut.split(c) if codec.cut and "<" in c else (c,):
                    if part not in codec.added:
                        for w in codec.split(part) if part else ():
                            if len(w) < 64:
                                got[w] += n
            seen.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(list(got), pa.string()),
                                               "n": pa.array(list(got.values()), pa.int64())})
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(codec.chunks(t))
                    if len(seen) > 300_000:
                        yield flush()
        yield flush()

    return df.select(F.col(f"`{text_col}`").cast("string").alias("text")) \
        .mapInArrow(giving_back(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, spec: dict, text_col: str = "text", size: int = 50_000) -> bytes:
    """The compiled lexicon of the words that are most frequent over all rows.

    Counts are sorted into narrow steps of their logarithm; the lexicon holds
    the most frequent steps that fit whole into ``size`` words. The driver
    receives the steps' sizes (about a thousand) and those words."""
    counts = stage(word_counts(df, spec, text_col), "words")
    step = F.floor(F.log2("n") * 16)
    taken, low = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        taken += r["words"]
        if taken > size:
            break
        low = r["step"]
    top = counts.where(step >= low).select("word").collect() if low is not None else []
    drop_stage(counts)
    codec = Codec(spec)
    return compile_lexicon({r["word"].encode(): tuple(codec.merge(r["word"])) for r in top})


def _mapped(df: DataFrame, tokenizer: str, id_col: str, text_col: str, size: int, row, schema: str) -> DataFrame:
    spark = df.sparkSession
    spec = load_spec(tokenizer)
    docs = small_batches(df).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    uri = write_shared_bytes(spark, build_lexicon(docs, spec, "text", size), "words.lexicon")
    spark.sparkContext.addFile(uri)
    name = uri.rsplit("/", 1)[1]
    share = spark.sparkContext.broadcast(spec)

    def run(batches):
        codec = Codec(share.value, Lexicon.open(SparkFiles.get(name)))  # what it remembers ends with the task
        for b in batches:
            ids = b.column(0).to_pylist()
            for at in range(0, len(ids), 512):
                rows = [row(codec, t) for t in b.column(1).slice(at, 512).to_pylist()]
                cols = [b.column(0).slice(at, 512)] + [pa.array(c) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = [c.split()[0] for c in schema.split(", ")]
    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(giving_back(run), schema.replace("doc_id any", f"doc_id {kind}"))


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           lexicon_size: int = 50_000) -> DataFrame:
    """``doc_id, ids array<int>, n_tokens long, decoded string`` per row.

    Ids are those of the tokenizers library without special tokens added
    (their strings inside a text are recognised, as there); ``decoded`` is
    its ``decode(ids, skip_special_tokens=False)``. A null text counts as
    empty and gives no ids and an empty string. Null ids, repeated rows and
    other columns of the input (which are not read) do no harm; an empty
    table gives an empty result. A row's text is held by one worker."""
    def row(codec, text):
        ids = codec.encode(text)
        return np.asarray(ids, np.int32), len(ids), codec.decode(ids)
    return _mapped(df, tokenizer, id_col, text_col, lexicon_size, row,
                   "doc_id any, ids array<int>, n_tokens long, decoded string")


def digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
            lexicon_size: int = 50_000) -> DataFrame:
    """As ``encode``, but ids and decoded text as lower-case hex SHA-256:
    ``doc_id, n_tokens long, ids_sha256 string, decoded_sha256 string``. The
    digest of the ids is that of their decimal forms joined by one space."""
    def row(codec, text):
        ids = codec.encode(text)
        said = " ".join(map(codec.digits.__getitem__, ids))
        return (len(ids), hashlib.sha256(said.encode()).hexdigest(),
                hashlib.sha256(codec.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
    return _mapped(df, tokenizer, id_col, text_col, lexicon_size, row,
                   "doc_id any, n_tokens long, ids_sha256 string, decoded_sha256 string")
