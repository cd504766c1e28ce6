"""Near-duplicate documents by HyperMinHash.

Each text's set of word shingles is hashed into 512 buckets; a bucket stores
the smallest hash that falls into it, compressed to its count of leading
zeros and ten mantissa bits. Neighbouring registers merge into 256, runs of
these form bands; texts that agree
in a band are candidates; the collision-corrected estimate of the compressed
registers drops hopeless pairs; the full shingle sets confirm the rest.

How many bands a text has follows from its size: two sets of similarity t
differ in at most d = (1 - t) / t * n shingles (n: the smaller set), each of
which changes one register at most. With more than d bands, one band must
agree, so up to ``most_bands`` no link can be missed; larger texts have that
many bands, so narrow that a pair at the threshold shares none with a chance
below ``MISS`` (at 0.85: 32 bands of eight registers, 4e-5; at 0.8: 64 of
four, 2e-15)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, columns_of, components, drop_stage, fresh, mix64, partitions, small_batches, stage, window_hashes

REGISTERS = 512
BAND_REGISTERS = 256
MANTISSA = 10
EMPTY = 0xFFFF
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
MISS = 1e-4
CHUNK = 256


def shingle_set(words: list, k: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are
    one shingle, no words none."""
    if not words:
        return np.empty(0, np.uint64)
    ids = hasher.ids(words)
    return np.unique(window_hashes(ids, min(k, len(ids))))


def words_of(text: str | None) -> list:
    """A-Z lower-cased, cut at ASCII white space (space and 0x09 to 0x0D)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def registers(hashes: np.ndarray) -> np.ndarray:
    """The compressed registers of a sorted set of hashes."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(55)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        low = (hashes[first] << np.uint64(9)) | np.uint64(1)
        part, exponent = np.frexp(low.astype(np.float64))
        zeros = np.clip(64 - exponent, 0, 62)
        mantissa = ((1.0 - part) * 2 * ((1 << MANTISSA) - 1)).astype(np.int64)
        out[bucket[first]] = (zeros << MANTISSA) | mantissa
    return out


def differences(n: int, threshold: float) -> int:
    """In how many shingles a set of n can differ from one that is similar."""
    return int((1 - threshold) / threshold * n + 1e-9)


def most_bands(threshold: float) -> int:
    """Bands of the largest sets: 32 or more, as the threshold asks for."""
    return next((b for b in LEVELS if b >= 32 and (1 - threshold ** (BAND_REGISTERS // b)) ** b < MISS), LEVELS[-1])


def level(n: int, threshold: float) -> int:
    """Bands for a set of n shingles (see the module's text)."""
    d, most = differences(n, threshold), most_bands(threshold)
    return next((b for b in LEVELS if d < b < most), most)


def band_keys(regs: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band that has a register in use."""
    # a larger register is a smaller hash; unused ones count as the largest hash
    regs = np.where(regs == EMPTY, 0, regs.astype(np.int64) + 1).reshape(BAND_REGISTERS, -1).max(axis=1)
    at = np.arange(BAND_REGISTERS)
    part = at * bands // BAND_REGISTERS
    salted = mix64((np.uint64(bands) << np.uint64(40)) + (at.astype(np.uint64) << np.uint64(20)) + regs.astype(np.uint64))
    start = np.flatnonzero(np.diff(part, prepend=-1))
    keys = np.add.reduceat(salted, start)
    used = np.add.reduceat(regs, start) > 0
    return mix64(keys)[used]


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(similarity, registers that differ)`` of register rows, corrected for
    the chance that two different minima share a compressed register."""
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(-1)
    total = np.maximum(used.sum(-1), 1)
    differ = used.sum(-1) - same
    chance = 2.0 ** -(MANTISSA + 1)  # of a shared exponent (1/3 at most) and mantissa, rounded up
    return np.clip((same / total - chance) / (1 - chance), 0, 1), differ


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, ck, n, regs`` per row of ``docs(doc_id, ck, text)``: set size
    and registers (null without words)."""
    def run(batches):
        hasher = WordHasher()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingle_set(words_of(t), k, hasher) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()),
                     pa.array([registers(x).tobytes() if len(x) else None for x in sets], pa.binary())],
                    ["doc_id", "ck", "n", "regs"])
    return docs.mapInArrow(run, "doc_id long, ck binary, n long, regs binary")


def node_keys(regs: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """The band keys of a text: at its own level, and on to that of the
    largest set that it can be similar to."""
    low, high = (LEVELS.index(level(m, threshold)) for m in (n, int(n / threshold + 1e-9)))
    return np.concatenate([band_keys(regs, bands) for bands in LEVELS[low:high + 1]]).view(np.int64)


def _bands(reps: DataFrame, threshold: float) -> DataFrame:
    """``key, node``: the band keys of each text."""
    def run(batches):
        for b in batches:
            node, n = b.column(0).to_numpy(), b.column(1).to_pylist()
            for at in range(0, b.num_rows, 2048):
                keys = [node_keys(np.frombuffer(b.column(2)[i].as_buffer(), np.uint16), n[i], threshold)
                        for i in range(at, min(at + 2048, b.num_rows))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.repeat(node[at:at + 2048], [len(x) for x in keys]))],
                    ["key", "node"])
    return reps.select("node", "n", "regs").mapInArrow(run, "key long, node long")


def _hopeful(threshold: float):
    """Keeps pairs that the registers do not rule out: a pair at the
    threshold differs in at most d registers, and its estimate lies 4.5
    standard deviations below the threshold with a chance of 3 in a million."""
    slack = 4.5 * (threshold * (1 - threshold) / 400) ** 0.5

    def keep(na, nb, ra, rb):
        low = np.minimum(na, nb)
        sized = low >= threshold * np.maximum(na, nb) - 1e-9
        similar, differ = estimate(ra, rb)
        most = np.floor((1 - threshold) / threshold * low + 1e-9)
        return sized & (differ <= most) & ((similar >= threshold - slack) | (most < REGISTERS // 4))
    return keep


def _filter_pairs(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The distinct ``pairs(a, b)`` that the registers leave hopeful."""
    keep = _hopeful(threshold)

    def run(batches):
        for b in batches:
            if b.num_rows:
                na, nb = (b.column(i).to_numpy().astype(np.float64) for i in (2, 3))
                ra, rb = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
                yield b.select([0, 1]).filter(pa.array(keep(na, nb, ra, rb)))
    side = reps.select("node", "n", "regs")
    a = side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    b = side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ra", "rb") \
        .mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` with 100 * common >= percent * union on the full
    sets, written; the stage ``pairs`` goes."""
    def sets(batches):
        hasher = WordHasher()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                found = [shingle_set(words_of(t), k, hasher).tobytes() for t in b.column(1).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), pa.array(found, pa.binary())], ["node", "s"])

    def check(batches):
        for b in batches:
            ok = []
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node")
    one = docs.join(wanted.select("node", "ck", F.col("head").alias("doc_id")), ["doc_id", "ck"]) \
        .select("node", "text").mapInArrow(sets, "node long, s binary").groupBy("node").agg(F.first("s").alias("s"))
    found = stage(one, "sets")
    a = found.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    b = found.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    ok = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")
    linked = stage(ok, "linked")
    drop_stage(found)
    drop_stage(pairs)
    return linked


def _hub_pairs(bands: DataFrame) -> DataFrame:
    """Each member of a band group against the group's hub, the member that
    comes first in a random order."""
    hubs = bands.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("hub"))
    return _pairs(bands.join(hubs, "key").where("node != hub"))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _mixed(bands: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the band groups that lie in several components: ``key,
    node, comp``, the group's size ``total``, its largest component ``main``
    with ``most`` rows, and a ``hub`` in that."""
    marked = bands.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    order = F.struct(F.xxhash64("node", F.lit(1)).alias("h"), "node")
    parts = marked.groupBy("key", "comp").agg(F.count("*").alias("m"), F.min(order)["node"].alias("hub"))
    mixed = parts.groupBy("key").agg(F.sum("m").alias("total"), F.count("*").alias("comps"),
                                     F.max(F.struct("m", "comp", "hub")).alias("top")) \
        .where("comps > 1").select("key", "total", "top.hub", F.col("top.m").alias("most"), F.col("top.comp").alias("main"))
    return stage(marked.join(mixed, "key"), "mixed")


def _rest_pairs(mixed: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ``mixed`` rows that the registers leave hopeful.

    The rows outside a group's largest component are compared with all its
    rows, by registers alone and in blocks: rows are dealt into chunks of about
    ``CHUNK``, and each pair of chunks meets in one bounded task group. Only
    hopeful pairs of different components come out."""
    n_part = partitions(mixed.sparkSession)
    rows = mixed.join(nodes.select("node", "n", "regs"), "node")
    salt = F.xxhash64("node", "key")
    right = F.ceil(F.col("total") / CHUNK).cast("int")
    left = F.ceil((F.col("total") - F.col("most")) / CHUNK).cast("int")
    cols = ["key", "node", "comp", "n", "regs", "outer"]
    rows = rows.withColumn("outer", F.col("comp") != F.col("main"))
    as_right = rows.withColumn("j", F.pmod(salt, right)) \
        .withColumn("i", F.explode(F.sequence(F.lit(0), left - 1))).select(*cols, "i", "j", F.lit(0).alias("side"))
    as_left = rows.where("outer").withColumn("i", F.pmod(salt, left)) \
        .withColumn("j", F.explode(F.sequence(F.lit(0), right - 1))).select(*cols, "i", "j", F.lit(1).alias("side"))
    keep = _hopeful(threshold)

    def compare(table: pa.Table) -> pa.Table:
        key, side = table.column("key")[0].as_py(), table.column("side").to_numpy()
        node, comp, n = (table.column(c).to_numpy() for c in ("node", "comp", "n"))
        outer = table.column("outer").to_numpy()
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        other = np.flatnonzero(side == 0)
        keys: dict[int, np.ndarray] = {}

        def keys_of(i: int) -> np.ndarray:
            if i not in keys:
                keys[i] = node_keys(regs[i], int(n[i]), threshold)
            return keys[i]
        out = []
        for x in np.flatnonzero(side == 1):
            y = other[(comp[other] != comp[x]) & ~(outer[other] & (node[other] < node[x]))]
            y = y[keep(np.full(len(y), float(n[x])), n[y].astype(np.float64), regs[x][None, :], regs[y])]
            # a pair that meets in several groups comes out of that with the smallest key only
            out += [sorted((node[x], node[i])) for i in y.tolist() if np.intersect1d(keys_of(x), keys_of(i)).min() == key]
        both = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    blocks = as_right.unionByName(as_left).repartition(n_part, "key", "i", "j")
    return blocks.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles long, component_id long, kept boolean, text_key
    binary`` per row.

    Words are lower-cased (A-Z) and cut at ASCII white space; a text's set
    holds its distinct k-word shingles (fewer words: the sequence as one).
    Texts with a similarity of ``threshold`` or more (a whole per cent) are
    linked; ``component_id`` is the smallest id reachable, and a row is kept
    if that is its own id. ``text_key`` is the MD5 of the text.

    Copies are one text, a class with the smallest of their ids, and never
    meet in a join. In each band group every member is compared with a hub,
    and those outside the largest component with a hub of that; what is still
    in separate components is compared in blocks.
    A text that is null or without words has an empty set and is linked with
    nothing. A row with a null id links nothing, has a null component and is
    kept. Rows are linked by their texts only: repeated rows share a
    component, and one id on different texts can be in several. Other columns
    are not read; an empty table gives an empty result."""
    percent = round(threshold * 100)
    text = F.col(f"`{text_col}`").cast("string")
    docs = small_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("ck"),
                     text.alias("text"))
    full = stage(sketches(docs, k), "sketches")
    nodes = stage(full.where("doc_id is not null and n > 0").groupBy("ck").agg(
        F.min("doc_id").alias("head"), F.first("n").alias("n"), F.first("regs").alias("regs"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = stage(full.drop("regs"), "rows")
    drop_stage(full)
    bands = stage(_bands(nodes, threshold), "bands")
    several = bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    shared = stage(bands.join(several, "key", "left_semi"), "shared")
    drop_stage(bands)
    hopeful = stage(_filter_pairs(_hub_pairs(shared), nodes, threshold), "hopeful")
    linked = _confirm(hopeful, docs, nodes, k, percent)
    mixed = _mixed(shared, components(linked))
    hopeful = stage(_filter_pairs(_pairs(mixed.where("comp != main")), nodes, threshold), "hopeful")
    drop_stage(mixed)
    linked = linked.union(_confirm(hopeful, docs, nodes, k, percent))
    mixed = _mixed(shared, components(linked))
    drop_stage(shared)
    rest = stage(_rest_pairs(mixed, nodes, threshold), "rest")
    drop_stage(mixed)
    linked = linked.union(_confirm(rest, docs, nodes, k, percent))
    heads = stage(nodes.select("ck", "node", "head"), "heads")
    drop_stage(nodes)
    named = heads.join(components(linked), "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("head").alias("component_id"))
    named = named.join(lowest, "component").select("ck", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(named, "ck", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), F.col("ck").alias("text_key"))


def drop_near_duplicates(df: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row
    with the smallest id stays, once if it is repeated; columns unchanged,
    whatever their names. Rows with a null id stay, as do those whose text is
    null, empty or without words, once for each id; of the different texts of
    one id each is judged by its own links. An empty table stays empty."""
    i, t, n, key = fresh("id", "text", "copies", "key")
    kept = near_duplicates(df, k, threshold, id_col, text_col).where("kept and doc_id is not null") \
        .groupBy("doc_id", "text_key").agg(F.count("*").alias(n))
    kept = stage(kept.select(F.col("doc_id").alias(i), F.col("text_key").alias(t), n), "kept")
    own_id = F.col(f"`{id_col}`")
    own = df.withColumn(key, F.unhex(F.md5(F.col(f"`{text_col}`").cast("string").cast("binary"))))
    own = own.join(kept, (F.col(i) == own_id.cast("long")) & F.col(t).eqNullSafe(F.col(key)))
    once = own.where(F.col(n) == 1).select(*columns_of(df))
    again = own.where(F.col(n) > 1).dropDuplicates([i, key]).select(*columns_of(df))
    return once.union(again).union(df.where(own_id.isNull()))
