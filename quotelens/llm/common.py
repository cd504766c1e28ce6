"""Helpers that the operators share: pruned reads, written stages, word
hashes and connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table  # noqa: F401  (re-exported for the operators)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder that
    ``spark.checkpoint.dir`` names and read it back: cuts the lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a stage that no later plan reads."""
    spark = df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(*names: str) -> list[str]:
    """Column names that no table has."""
    mark = uuid.uuid4().hex[:10]
    return [f"{n}_{mark}" for n in names]


def columns_of(df: DataFrame) -> list[F.Column]:
    """All columns of ``df``, whatever their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def write_shared_bytes(spark: SparkSession, data: bytes, name: str) -> str:
    """Write one driver-built file into the shared folder; returns its URI."""
    uri = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex[:12]}-{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return uri


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """Let Spark hand at most 1000 rows at once to Python where the session
    keeps its default of 10,000: the rows here are whole texts and sketches,
    and a batch is held by the JVM and by Python at the same time."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_ROWS) == "10000":
        conf.set(ARROW_ROWS, "1000")
    return df


def give_back() -> None:
    """Return freed memory to the system. Spark keeps idle Python workers for
    the next task, and what these hold counts beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # a C library without it
        pass


def giving_back(run):
    """``run`` for ``mapInArrow``; once a task's rows are out, what it held is
    freed and given back."""
    def whole(batches):
        yield from run(batches)
        give_back()
    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_col) -> F.Column:
    """True where crc32 of the id's decimal text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def is_held_out(doc_id) -> bool:
    """``held_out`` for one Python id."""
    return doc_id is not None and zlib.crc32(str(int(doc_id)).encode()) % 4 == 2


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


class WordHasher(dict):
    """word bytes -> 64-bit hash, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        import xxhash
        self.limit, self.digest = limit, xxhash.xxh64_intdigest

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = self.digest(word)
        return h

    def ids(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k ids, in order (empty if there are fewer): the
    ids (hashes themselves) times an odd number for each place, summed and
    mixed."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    odd = mix64(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    h = ids[:n] * odd[0]
    for j in range(1, k):
        h += ids[j:j + n] * odd[j]
    return mix64(h)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as
    ``(node long, component long)``, component = smallest node reachable.

    Alternates large-star and small-star steps (each a min per node over a
    partial aggregate and a join), with every step written to the shared
    folder; a star forest is reached after about log(n) steps. Empty edges
    give an empty table; loops and repeated edges are allowed."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")) \
        .where(F.col("u") != F.col("v")).distinct()
    e = stage(e, "edges")
    last = None
    while True:
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(low, "u").where(F.col("v") > F.col("u")) \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stage(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        small = stage(small, "small")
        drop_stage(large)
        drop_stage(e)
        e = small
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        last = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
