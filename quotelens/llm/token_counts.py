"""Exact token counts of every prefix of a text, by dynamic programming.

A byte-level BPE file cuts a text into pieces and merges each piece by rank.
The ids of a prefix of a piece are those of some shorter prefix and one last
token more, and there is exactly one token for which that holds: the one that
its forerunner does not merge with. So a table over the prefixes holds each
one's count and last token, and one step fills an entry from an earlier one.
Laid end to end, the tables of a text's pieces (remembered, as most pieces
are met again) give the count of every prefix of the text. How long a prefix
fits a budget, or what any cut costs, is then looked up."""

from __future__ import annotations

import json
import re
from array import array
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import UNKNOWN_LETTERS, UNKNOWN_NUMBERS, _ranges, byte_alphabet
from .common import small_batches

NEVER = 1 << 40
#: The endings that the byte-level pattern of the file's kind takes as pieces of their own.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def load_spec(path: str) -> dict:
    """``vocab`` (bytes to id), ``merges`` (pairs of bytes by rank) and
    ``special`` strings of a byte-level BPE file. Raises where the file asks
    for steps that this module does not know."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    m, cut = j["model"], j["pre_tokenizer"] or {}
    if (j["normalizer"] or j["post_processor"] or m["type"] != "BPE" or cut.get("type") != "ByteLevel"
            or cut.get("add_prefix_space") or not cut.get("use_regex", True) or m.get("end_of_word_suffix")
            or m.get("continuing_subword_prefix") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in j["added_tokens"])):
        raise ValueError(f"{path} is not a byte-level BPE file of the known kind")
    back = {c: b for b, c in enumerate(byte_alphabet())}
    special = [t["content"] for t in j["added_tokens"]]
    raw = lambda s: bytes(back[c] for c in s)
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
    return {"vocab": {raw(t): i for t, i in m["vocab"].items() if t not in special},
            "merges": [(raw(a), raw(b)) for a, b in pairs], "special": special}


class PrefixCounter:
    """Tables of prefix counts for one tokenizer file."""

    def __init__(self, spec: dict, limit: int = 400_000):
        self.limit, self.special = limit, sorted(spec["special"], key=len, reverse=True)
        self.vocab: dict[bytes, int] = spec["vocab"]
        self.rank = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in enumerate(spec["merges"])}
        made = {self.vocab[a + b]: (self.vocab[a], self.vocab[b], r) for r, (a, b) in enumerate(spec["merges"])}
        self.made = made
        finder = ahocorasick.Automaton()  # the tokens that end at each place, the longest first
        for t, i in self.vocab.items():
            finder.add_word(t.decode("latin-1"), i << 16 | len(t))
        finder.make_automaton()
        self.find = finder.iter
        self.left: dict[int, list] = {}
        self.right: dict[int, list] = {}
        self.fits: dict[int, bool] = {}
        self.tables: dict[str, bytes] = {}
        self.old_tables = self.tables
        letters, numbers = _ranges(UNKNOWN_LETTERS), _ranges(UNKNOWN_NUMBERS)
        ends = "|".join(ENDINGS)
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.pieces = regex.compile(
            rf"{ends}| ?[\p{{L}}--[{letters}]]+| ?[\p{{N}}--[{numbers}]]+"
            rf"| ?[[^\s\p{{L}}\p{{N}}]||[{letters}{numbers}]]+|\s+(?!\S)|\s+", regex.V1).findall
        self.ascii_pieces = re.compile(rf"{ends}| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII).findall
        self.two_spaces = regex.compile(r"\s\s", regex.V1).search
        self.is_space = regex.compile(r"\s", regex.V1).match

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """``(token, made, used)`` of the tokens that stand at one edge of
        ``token`` while it is merged: from which rank on, and the rank of the
        merge that uses each up."""
        known = self.right if side else self.left
        got = known.get(token)
        if got is None:
            got, used = [], NEVER
            while True:
                rule = self.made.get(token)
                got.append((token, rule[2] if rule else -1, used))
                if not rule:
                    break
                token, used = rule[side], rule[2]
            known[got[0][0]] = got
        return got

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and then ``b`` as they are: no merge
        across the border comes while both of its tokens stand there. A rule
        that could take either of two places takes the left one first."""
        for x, made_x, used_x in self._edge(a, 1):
            for y, made_y, used_y in self._edge(b, 0):
                r = self.rank.get((x, y), -1)
                if made_x < r > made_y and r < used_x and r <= used_y:
                    return False
        return True

    def prefix_counts(self, piece: bytes) -> list[int]:
        """The number of tokens of every prefix of a piece, by bytes: of the
        tokens that end there, the one that its forerunner is apart from."""
        n, done = len(piece), 0
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        fits = self.fits
        for end, found in self.find(piece.decode("latin-1")):
            if end < done:
                continue  # settled by a longer token
            j, token = end + 1 - (found & 0xFFFF), found >> 16
            if j:
                pair = last[j] << 24 | token
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) >= 1_000_000:
                        fits.clear()
                    ok = fits[pair] = self.apart(last[j], token)
                if not ok:
                    continue
            done = end + 1
            counts[done], last[done] = counts[j] + 1, token
        return counts

    def count(self, piece: str) -> int:
        return self.prefix_counts(piece.encode("utf-8", "surrogatepass"))[-1]

    def _table(self, piece: str) -> bytes:
        """Steps of the count from character to character, as int16."""
        got = self.old_tables.get(piece)
        if got is None:
            raw = piece.encode("utf-8", "surrogatepass")
            at = self.prefix_counts(raw)
            if len(raw) != len(piece):  # characters begin where no continuation byte stands
                at = [c for c, b in zip(at, raw) if b & 0xC0 != 0x80] + at[-1:]
            if len(piece) == 3 and piece in ENDINGS:  # cut after two characters it is no ending, but two pieces
                at[2] = self.count(piece[0]) + self.count(piece[1])
            got = array("h", map(sub, at[1:], at)).tobytes()
        if len(piece) < 64:
            self.tables[piece] = got
        return got

    def split(self, text: str) -> list[str]:
        return self.ascii_pieces(text) if text.isascii() else self.pieces(text)

    def counts(self, text: str) -> np.ndarray:
        """The number of tokens of ``text[:i]`` for each i from 0 to its
        length."""
        if len(self.tables) >= self.limit:
            self.tables, self.old_tables = {}, self.tables
        if self.cut and (found := list(self.cut.finditer(text))):
            out, at = [np.zeros(1, np.int64)], 0
            for m in found:
                part = text[at:m.start()]
                out.append(self._counts(part)[1:] + out[-1][-1])
                # a special string that is cut short is text, and goes on what stands before it
                tail = self.split(part)[-1] if part else ""
                base = out[-1][-1 - len(tail)] if len(out[-1]) > len(tail) else out[-2][-1]
                special, short = m[0], []
                for i in range(1, len(special)):
                    short.append(base + sum(map(self.count, self.split(tail + special[:i]))))
                here = (out[-1] if len(out[-1]) else out[-2])[-1]
                out.append(np.array(short + [here + 1], np.int64))
                at = m.end()
            out.append(self._counts(text[at:])[1:] + out[-1][-1])
            return np.concatenate(out)
        return self._counts(text)

    def _counts(self, text: str) -> np.ndarray:
        pieces, get, make = self.split(text), self.tables.get, self._table
        steps = b"".join([get(p) or make(p) for p in pieces])
        counts = np.zeros(len(text) + 1, np.int64)
        np.cumsum(np.frombuffer(steps, np.int16), out=counts[1:], dtype=np.int64)
        if self.two_spaces(text):
            # white space that nothing follows is one piece; before a word its last character is one of its own
            fixes, at = [], 0
            for i, p in enumerate(pieces):
                if i and self.is_space(p[0]) and self.is_space(pieces[i - 1][-1]):
                    run = pieces[i - 1]
                    fixes.append((at + 1, counts[at - len(run)] + self.count(run + p[0])))
                at += len(p)
            for i, c in fixes:
                counts[i] = c
        return counts


def _mapped(df: DataFrame, tokenizer: str, id_col: str, text_col: str, schema: str, rows) -> DataFrame:
    """``rows(counter, ids, texts)`` gives the columns of one slice."""
    share = df.sparkSession.sparkContext.broadcast({"spec": load_spec(tokenizer)})
    kind = dict(df.dtypes)[id_col]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        held = share.value  # lives as long as the worker, and so does what the counter remembers
        counter = held.get("counter")
        if counter is None:
            counter = held["counter"] = PrefixCounter(held["spec"])
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield from rows(counter, part.column(0), part.column(1).to_pylist(), names)

    return small_batches(df).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")) \
        .mapInArrow(run, schema.replace("doc_id any", f"doc_id {kind}"))


def count_tokens(df: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes long, n_chars long, n_tokens long, over_limit boolean,
    fit_chars long`` for each row.

    ``n_tokens`` is what the tokenizers library gives for the whole text
    without added special tokens (their strings inside a text are
    recognised), ``fit_chars`` the length in code points of the longest prefix that has
    at most ``limit`` tokens. A null text counts as empty: no bytes, no
    tokens. Null ids and repeated rows are rows like any other; other columns
    are not read; an empty table gives an empty result. Nothing is shuffled;
    a row's text is held by one worker."""
    def rows(counter, ids, texts, names):
        got = []
        for t in texts:
            counts = counter.counts(t or "")
            n = int(counts[-1])
            fit = len(counts) - 1 if n <= limit else int(np.flatnonzero(counts <= limit)[-1])
            got.append((len((t or "").encode("utf-8", "surrogatepass")), len(counts) - 1, n, n > limit, fit))
        cols = list(zip(*got)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([ids] + [pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return _mapped(df, tokenizer, id_col, text_col,
                   "doc_id any, n_bytes long, n_chars long, n_tokens long, over_limit boolean, fit_chars long", rows)


BLOCK = 4096


def prefix_table(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of every prefix, to be stored: ``doc_id, text_key, block int,
    least int, counts array<int>``.

    Block k of a text holds the counts of its prefixes of 4096k to 4096k +
    4095 code points (the empty prefix is in block 0, so each text has a
    row), ``least`` their smallest; ``text_key`` is the MD5 of the text, so
    that different texts of one id stay apart. A null text counts as empty;
    repeated rows give repeated blocks; null ids are kept."""
    from hashlib import md5

    def rows(counter, ids, texts, names):
        for k, t in enumerate(texts):
            counts = counter.counts(t or "").astype(np.int32)
            parts = [counts[i:i + BLOCK] for i in range(0, len(counts), BLOCK)]
            n = len(parts)
            key = md5((t or "").encode("utf-8", "surrogatepass")).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([k] * n)), pa.array([key] * n), pa.array(range(n), pa.int32()),
                 pa.array([int(p.min()) for p in parts], pa.int32()), pa.array(parts, pa.list_(pa.int32()))], names)

    return _mapped(df, tokenizer, id_col, text_col,
                   "doc_id any, text_key string, block int, least int, counts array<int>", rows)


def longest_within(table: DataFrame, budget: int) -> DataFrame:
    """``doc_id, text_key, fit_chars long``: the longest prefix of each text
    of ``prefix_table`` that has at most ``budget`` tokens. Blocks that start
    beyond the budget are left out by their ``least``; no text is read."""
    place = F.array_max(F.transform("counts", lambda c, i: F.when(c <= budget, i.cast("long"))))
    return table.where(F.col("least") <= budget) \
        .groupBy("doc_id", "text_key").agg(F.max(F.col("block") * BLOCK + place).alias("fit_chars"))


def counts_at(table: DataFrame, cuts: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_chars, n_tokens``: the tokens of the first
    ``n_chars`` code points for each row ``doc_id, n_chars`` of ``cuts``;
    cuts beyond a text's end have no row."""
    asked = cuts.select(F.col("doc_id"), F.col("n_chars").cast("long").alias("n_chars")) \
        .withColumn("block", F.expr(f"cast(n_chars div {BLOCK} as int)"))
    place = F.col("n_chars") % BLOCK
    return table.join(asked, ["doc_id", "block"]).where((F.size("counts") > place) & (place >= 0)) \
        .select("doc_id", "text_key", "n_chars", F.element_at("counts", (place + 1).cast("int")).cast("long").alias("n_tokens"))
