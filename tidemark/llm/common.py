"""Shared helpers of the training-data operators: scratch tables, word and shingle hashing, components.

Words are the runs of bytes outside ``\\x20 \\x09-\\x0D`` of the UTF-8 text with A-Z lower-cased; for
UTF-8 this is what ``bytes.lower().split()`` yields, because multi-byte characters hold no such byte.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship

SHINGLE_WORDS = 5
#: Odd multipliers that weigh the word hashes of a shingle; drawn once, so hashes agree between jobs.
_MULT = np.random.default_rng(20240501).integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Scratch:
    """Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``).

    ``put`` writes a frame and reads it back, which cuts its lineage: a lost executor costs the
    tasks it was running, never the tables already written. As nothing needs the frame's shuffles after
    that, Spark is told to clean them up at the end of the write.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        ship(spark)
        self.root = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str = "t", codec: str | None = None) -> DataFrame:
        path, before = self.path(name), self.spark.conf.get(self.CLEANUP, "false")
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            (df.write.option("compression", codec) if codec else df.write).parquet(path)
        finally:
            self.spark.conf.set(self.CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for what is run inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fold(col: str, n: int):
    """crc32 of the id written as text, modulo n: the learning and held-out folds."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


class WordHash(dict):
    """Word -> 64-bit hash, remembered for a bounded number of words."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORD_HASH = WordHash()


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASH.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_sequence(text: str | None) -> np.ndarray:
    """Hashes of the five-word shingles in order; of the whole sequence when it is shorter; empty without words."""
    h = word_hashes(words(text))
    n = len(h)
    if n == 0:
        return h
    if n < SHINGLE_WORDS:
        return mix((h * _MULT[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n) * _MULT[-1:])
    out = h[: n - 4] * _MULT[0]
    for j in range(1, SHINGLE_WORDS):
        out = out + h[j : n - 4 + j] * _MULT[j]
    return mix(out)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_sequence(text))


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every id that has an edge; root is the smallest id it reaches.

    Alternating large-star and small-star rounds: each is a partial aggregate (minimum neighbour)
    joined back to the edges, so no adjacency list is ever gathered. Each round is written out.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )
    e = scratch.put(e, "edges")
    before = _sum_of(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are written, so that the joins are plain ones, whose large partitions Spark can split.
        low = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = scratch.put(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = scratch.put(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(lower, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        new = scratch.put(small, "edges")
        after = _sum_of(new)
        scratch.drop(e, low, large, lower)
        e = new
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots.select("id", F.col("id").alias("root")))


def _sum_of(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def portions(b, column: int, most: int):
    """Slices of an Arrow batch that hold about so many bytes of text, or one row."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
    k = 0
    while k < b.num_rows:
        e = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + most)))
        yield b.slice(k, e - k)
        k = e


def runs(batches, keys: list[str]):
    """From Arrow batches sorted by the key columns: (table, starts, ends) of whole groups, each group in one piece."""
    import pyarrow as pa

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        start = _starts(t, keys)
        cut = start[-1]
        held = t.slice(cut)
        if cut:
            yield t.slice(0, cut).combine_chunks(), start[:-1], start[1:]
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0]), np.array([held.num_rows])


def _starts(t, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)
