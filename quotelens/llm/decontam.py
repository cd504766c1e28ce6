"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of the template
that documents share with benchmark items are joined by hash; an occurrence
counts if its placeholders stand for the item's values consistently, so that
a question with other numbers or names is caught as well. Windows that hold
hardly any literal words are joined on their literal values instead."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, fresh, mix64, small_batches, stage, window_hashes

# Units of measure and currency that may follow a number.
UNITS = frozenset((
    "mm cm m km in inch inches ft feet yd yard yards mi mile miles mg g kg t lb lbs oz gram grams ml cl l litre litres "
    "liter liters gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month "
    "months year years hz khz mhz ghz b kb mb gb tb v w kw kwh j kj cal kcal k c f % $ € £ dollar dollars euro euros "
    "cent cents percent degrees mph kmh").split())
NUMBER, NAME, UNIT = (np.uint64(x << 4) for x in (1, 2, 3))
IS_NUMBER, IS_UNIT, IS_TITLE, ENDS = 1, 2, 4, 8
EDGES = re.compile(r"^[^\w%$€£]+|[^\w%$€£]+$")
GLUED = re.compile(r"^([$€£]?)([+-]?\d[\d.,]*)([^\W\d_]{1,7}|[%$€£])$")
DIGIT = re.compile(r"\d")
BITS = 22


class Tokens(dict):
    """Run without white space -> 60 bits of its literal's hash and four
    flags; 0 for a run without word."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, run: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        plain = run.isalpha()
        word = run if plain else EDGES.sub("", run)
        got = 0
        if word:
            low = word.lower()
            flags = ENDS * (run[-1] in ".!?:")
            if not plain and DIGIT.search(word):
                flags |= IS_NUMBER
            if low in UNITS:
                flags |= IS_UNIT
            if word[0].isupper() and len(word) > 1 and not word[1].isupper():
                flags |= IS_TITLE
            got = (xxhash.xxh64_intdigest(low) | 0xF) & ~0xF | flags
        self[run] = got
        return got


def literal(run: str) -> str:
    return EDGES.sub("", run).lower()


def template(runs: list[str], tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(word, literal, kind, place, first)`` per word: its hash with placeholders,
    its literal hash, 0 or the kind of placeholder, which run it is, and
    whether it is a capitalised literal that begins a sentence."""
    code = np.fromiter(map(tokens.__getitem__, runs), np.uint64, len(runs))
    place = np.flatnonzero(code)
    code = code[place]
    flags = (code & np.uint64(15)).astype(np.int64)
    lit = code & ~np.uint64(15)
    after_end = np.r_[True, (flags[:-1] & ENDS) > 0] if len(code) else np.empty(0, bool)
    number = (flags & IS_NUMBER) > 0
    after_number = np.r_[False, number[:-1]] if len(code) else after_end
    kind = np.where(number, 1, np.where(((flags & IS_UNIT) > 0) & after_number, 3,
                                        np.where(((flags & IS_TITLE) > 0) & ~after_end, 2, 0)))
    word = np.select([kind == 1, kind == 2, kind == 3], [NUMBER, NAME, UNIT], lit)
    return word, lit, kind, place, ((flags & IS_TITLE) > 0) & after_end & (kind == 0)


def window_keys(word: np.ndarray, lit: np.ndarray, kind: np.ndarray, width: int, literals: int) -> np.ndarray:
    """The key of each window: of the template where it has ``literals``
    literal words or more, of the literal values elsewhere."""
    if len(word) < width:
        return np.empty(0, np.uint64)
    known = np.cumsum(np.r_[0, kind == 0])
    enough = known[width:] - known[:-width] >= min(literals, width)
    keys = window_hashes(word, width)
    if not enough.all():
        keys = np.where(enough, keys, mix64(window_hashes(lit, width) + np.uint64(1)))
    return keys


def _bitmap(windows: DataFrame) -> np.ndarray:
    """2**BITS bits, set for the keys of the benchmark's windows; its size does
    not depend on the benchmark's, and what it lets through is joined."""
    rows = windows.select(F.shiftrightunsigned("key", 64 - BITS).alias("slot")) \
        .groupBy(F.expr("shiftright(slot, 6)").alias("at")) \
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("b")).collect()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    for r in rows:
        out[r["at"]] = np.uint64(r["b"] & 0xFFFFFFFFFFFFFFFF)
    return out


def _windows(rows: DataFrame, widths: list[int], literals: int, bitmap=None) -> DataFrame:
    """``id, key, at, width, windows, slots, first`` of each window of
    ``rows(id, text)``, and (``first`` = 1) once more of those that differ if
    capitalised words at the start of sentences are names.

    With a bitmap: of every width in ``widths``, those that it lets through.
    Without: all of the largest width that the text is as long as."""
    def run(batches):
        tokens = Tokens()
        bits = bitmap.value if bitmap is not None else None
        for b in batches:
            for first in range(0, b.num_rows, 512):
                ids, keys, ats, sizes, totals, slots, firsts = [], [], [], [], [], [], []
                part = b.slice(first, 512)
                for i, t in enumerate(part.column(1).to_pylist()):
                    runs = (t or "").split()
                    word, lit, kind, place, begins = template(runs, tokens)
                    for names in (0, 1):
                        if names:
                            if not begins.any():
                                break
                            word, kind = np.where(begins, NAME, word), np.where(begins, 2, kind)
                            other = np.cumsum(np.r_[0, begins])
                        for width in widths:
                            key = window_keys(word, lit, kind, width, literals)
                            hit = np.flatnonzero(other[width:] > other[:-width]) if names and len(key) else np.arange(len(key))
                            if bits is not None:
                                slot = key[hit] >> np.uint64(64 - BITS)
                                word_at, bit = (slot >> np.uint64(6)).astype(np.int64), slot & np.uint64(63)
                                hit = hit[np.flatnonzero((bits[word_at] >> bit) & np.uint64(1))]
                            for j in hit.tolist():
                                inside = np.flatnonzero(kind[j:j + width]) + j
                                ids.append(i)
                                keys.append(key[j])
                                ats.append(j)
                                sizes.append(width)
                                totals.append(len(key))
                                firsts.append(names)
                                slots.append([f"{kind[x]}{literal(runs[place[x]])}" for x in inside.tolist()])
                            if bits is None and len(key):
                                break
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(ids, pa.int64())), pa.array(np.array(keys, np.uint64).view(np.int64)),
                     pa.array(ats, pa.int32()), pa.array(sizes, pa.int32()), pa.array(totals, pa.int32()),
                     pa.array(slots, pa.list_(pa.string())), pa.array(firsts, pa.int32())],
                    ["id", "key", "at", "width", "windows", "slots", "first"])
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, key long, at int, width int, windows int, slots array<string>, first int")


def find_leaks(df: DataFrame, benchmark: DataFrame, width: int = 5, literals: int = 3, coverage: float = 0.5,
               consistency: float = 0.85, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, matched int, windows int, coverage double,
    consistency double, changed boolean, first_word int, text_key binary`` of
    each document and benchmark item that it leaks.

    An item leaks into a text where ``coverage`` of its windows of ``width``
    words are found in it, counting only runs of windows whose placeholders
    take one value for each value of the item in a share of ``consistency`` of
    the cases. Capitalised words that begin a sentence count as literals and,
    in runs of their own, as names. ``changed`` says that some value differs from the item's;
    ``text_key`` is the text's MD5. A run without letters, digits or money
    signs is no word; an item shorter than a window is one window, and one of
    fewer than ``literals`` words is too short to leak.

    Null or empty texts and items leak nothing. Repeated rows count once, rows
    with a null id are reported with a null id; items with equal texts are all
    reported. Other columns are not read; an empty table on either side gives
    an empty result."""
    text = F.col(f"`{text_col}`").cast("string")
    docs = small_batches(df).select(F.struct(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("text_key")).alias("id"),
                     text.alias("text"))
    items = benchmark.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    widths = list(range(width, literals - 1, -1))
    known = stage(_windows(items.distinct(), widths, literals).select(
        F.col("id").alias("item_id"), "key", F.col("at").alias("item_at"), "windows", F.col("slots").alias("item_slots"),
        "width", F.col("first").alias("item_first")), "items")
    used = [r["width"] for r in known.select("width").distinct().collect()]
    bitmap = df.sparkSession.sparkContext.broadcast(_bitmap(known))
    hits = stage(_windows(docs, sorted(used), literals, bitmap).select("id.doc_id", "id.text_key", "key", "at", "slots", F.col("first").alias("doc_first")), "hits")
    pairs = hits.join(known, "key")
    zipped = F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc"))
    run = pairs.groupBy("doc_id", "text_key", "item_id", "windows", (F.col("at") - F.col("item_at")).alias("shift"),
                        F.greatest("item_first", "doc_first").alias("names")).agg(
        F.collect_set("item_at").alias("ats"), F.min("at").alias("first"),
        F.array_distinct(F.flatten(F.collect_list(zipped))).alias("values"))
    sure = F.when(F.size("values") == 0, 1.0).otherwise(
        F.size(F.array_distinct(F.transform("values", lambda v: v["item"]))) / F.size("values"))
    differs = F.exists("values", lambda v: v["item"] != v["doc"])
    run = run.select("*", sure.alias("sure"), differs.alias("differs")).where(F.col("sure") >= consistency)
    out = run.groupBy("doc_id", "text_key", "item_id", "windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("matched"), F.min("sure").alias("consistency"),
        F.max("differs").alias("changed"), F.min("first").alias("first_word"))
    return out.withColumn("coverage", F.col("matched") / F.col("windows")).where(F.col("coverage") >= coverage).select(
        "doc_id", "item_id", "matched", "windows", "coverage", "consistency", "changed", "first_word", "text_key")


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` whose text leaks no benchmark item, unchanged,
    whatever their columns' names. Rows with a null or empty text stay, null
    ids and repeated rows are judged by their text like others; an empty table
    stays empty, an empty benchmark takes nothing out."""
    bad, key = fresh("bad", "key")
    leaks = stage(find_leaks(df, benchmark, text_col=text_col, **how).select(F.col("text_key").alias(bad)).distinct(), "leaks")
    keyed = df.withColumn(key, F.unhex(F.md5(F.col(f"`{text_col}`").cast("string").cast("binary"))))
    return keyed.join(leaks, F.col(key) == F.col(bad), "left_anti").select(*columns_of(df))
