"""Sharding by histogram sort, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

KEYS = ("_h1", "_h2", "_h3")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per input row: the size, the text's checksum and a
    three-part sort key (text hash, id hash, row number), so that equal texts
    are neighbours and even repeated rows can be cut apart."""
    text = F.col(f"`{text_col}`").cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    return df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("_h1"),
        F.xxhash64(F.col(f"`{id_col}`"), F.lit(7)).alias("_h2"),
        F.monotonically_increasing_id().alias("_h3"),
    )


def _at_or_below(keys: list[tuple]) -> Column:
    """How many of the sorted ``keys`` are at or below the row's key."""
    fixed = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for v, k in zip(key, KEYS)]) for key in keys])
    return F.size(F.filter(fixed, lambda c: c <= F.struct(*KEYS)))


def splitters(keyed: DataFrame, shards: int, bins: int, tolerance: float) -> tuple[list[tuple], list[dict]]:
    """The ``shards - 1`` keys that cut the rows into equal bytes.

    Each open boundary owns an interval of keys that holds its target. One
    job per round splits every interval into ``bins`` equal steps of the key
    part that still differs, and sums exact bytes and the lowest and highest
    key of each step; the step that holds the target is the next interval. A
    boundary closes as soon as one of the counted keys misses its target by
    at most ``tolerance`` of a shard, or its interval is a single key. Only
    the counts of the probes (boundaries x bins rows at most) reach the
    driver. Also returns a record of each round."""
    lo3, hi3 = F.min(F.struct(*KEYS)).alias("lo"), F.max(F.struct(*KEYS)).alias("hi")
    span = keyed.agg(F.sum("size").alias("b"), lo3, hi3).first()
    total = span["b"] or 0
    allowed = tolerance * total / shards
    target = [total * (i + 1) / shards for i in range(shards - 1)]
    found: list = [None] * (shards - 1)
    history: list[dict] = []
    if not total:
        return [], history
    first, last = tuple(span["lo"]), tuple(span["hi"])
    # interval -> (bytes below it, boundaries that it holds)
    open_: dict = {(first, last): (0, list(range(shards - 1)))}
    while open_:
        part, low, width, top = [], [], [], []
        for lo, hi in sorted(open_):
            i = next((i for i in range(3) if lo[i] != hi[i]), 2)
            part.append(i + 1)
            low.append(lo[i])
            width.append(-(-(hi[i] - lo[i] + 1) // bins))
            top.append(hi)
        g = F.col("_g")
        own = F.element_at(F.array(*KEYS), F.element_at(F.array(*map(F.lit, part)), g)).cast("decimal(20,0)")
        lows = F.array(*[F.lit(v).cast("decimal(20,0)") for v in low])
        widths = F.array(*[F.lit(v).cast("decimal(20,0)") for v in width])
        tops = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for v, k in zip(hi, KEYS)]) for hi in top])
        counted = keyed.withColumn("_g", _at_or_below([lo for lo, _ in sorted(open_)])) \
            .where((g > 0) & (F.struct(*KEYS) <= F.element_at(tops, g))) \
            .withColumn("_s", F.floor((own - F.element_at(lows, g)) / F.element_at(widths, g)).cast("long")) \
            .groupBy((g - 1).alias("g"), "_s").agg(F.sum("size").alias("b"), lo3, hi3).collect()
        by: dict[int, list] = {}
        for r in counted:
            by.setdefault(r["g"], []).append((tuple(r["lo"]), tuple(r["hi"]), r["b"]))
        nxt: dict = {}
        for g, (_, (below, which)) in enumerate(sorted(open_.items())):
            run = below
            for lo, hi, b in sorted(by.get(g, [])):
                for i in which:
                    if found[i] is None and run <= target[i] < run + b:
                        if target[i] - run <= allowed:
                            found[i] = lo
                        elif lo == hi:
                            found[i] = lo if target[i] - run <= run + b - target[i] else (lo[0], lo[1], lo[2] + 1)
                        else:
                            nxt.setdefault((lo, hi), (run, []))[1].append(i)
                run += b
        history.append({"intervals": len(open_), "counts": len(counted), "open": sum(len(x[1]) for x in nxt.values())})
        open_ = nxt
    return [k if k is not None else last for k in found], history


def shard(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
          bins: int = 1024, tolerance: float = 0.002, rows_per_bucket: int = 20_000) -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal bytes (the
    ``bytes`` law), by histogram sort: splitters are found by counting, then
    the rows are exchanged once.

    Returns ``doc_id, size long, text_crc32 long, law, shard int, slot long,
    grown_shard int (null)``. ``size`` is the text's UTF-8 bytes plus 16; a
    null text counts as no bytes and has the checksum of the empty text.
    ``slot`` numbers the rows of a shard from 0 without gaps, bucket by
    bucket in key order, where a bucket is a narrow range of text hashes and
    id hashes; so no task ever sorts a whole shard, and a text that a third
    of the rows hold is spread over many buckets. Null ids are kept (the id
    hash of null), repeated rows are kept and may be cut apart. Fewer rows
    than shards leave shards empty; an empty table gives an empty result.
    Other columns of the input are not read."""
    keyed = stage(_keyed(df, id_col, text_col), "shardkeys")
    cuts, _ = splitters(keyed, shards, bins, tolerance)
    at = _at_or_below(sorted(cuts)) if cuts else F.lit(0)
    rows = keyed.count()
    bits = max(4, (max(1, rows) // rows_per_bucket).bit_length() + 2)
    bucket = F.shiftrightunsigned("_h1", 64 - bits) * 64 + F.shiftrightunsigned("_h2", 58)
    placed = keyed.withColumn("shard", at.cast("int")).withColumn("_bucket", bucket)
    sizes = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    start = F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")
    sizes = sizes.select("shard", "_bucket", start.alias("_start"))
    rank = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(*KEYS)) - 1
    out = placed.withColumn("_rank", rank).join(sizes, ["shard", "_bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      (F.col("_start") + F.col("_rank")).cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id",
                 files_per_shard: int = 8) -> None:
    """Write the whole rows of ``df`` below ``path`` as ``shard=N`` folders in
    slot order within each file, several files per shard; ids must be unique."""
    p = placed.select(F.col("doc_id").alias("_id"), "shard", "slot")
    full = df.join(p, df[id_col].eqNullSafe(F.col("_id"))).drop("_id")
    full.repartition("shard", F.col("slot") % files_per_shard).sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)
