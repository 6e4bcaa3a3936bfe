"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A test item is short and a document long, so their Jaccard similarity says little. Items are
partitioned by size (q in (Q/2, Q], Q a power of two); for each partition a document's sequence of
shingles is cut into windows of 2Q at a stride of Q, so a passage of Q lies whole in some window.
Containment t of an item in a window of at most 2Q then means a Jaccard similarity of at least
t / (2Q/q + 1 - t), which is 0.176 or more; the search runs with single-row bands tuned to that:
a passage escapes all BANDS = 48 bands in fewer than one case in 10,000 (items of 5 to 8 shingles, whose windows
hold up to three times as many, in one of a few thousand). Items of fewer than FEW shingles are looked up by
each shingle. Every candidate is verified by the exact share of the item's five-word shingles that the whole
document holds; an item of fewer than five words is one shingle, which only a text of just these words has.

Documents are never shuffled. The index of a block of items is broadcast, in arrays of about 8 bytes a shingle and
600 an item; a block has about ITEM_SHINGLES shingles (or one item, which was one row), however large the
benchmark is, and documents are read once for each block: once up to some ten thousand items.

Defined results: null or wordless texts and items match nothing; fewer than five words make one
shingle; rows that repeat an item count once, repeated documents are searched each and reported once;
null ids are kept as null; empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import shingle_sequence, shingle_set

NUM, DEN = 75, 100
BANDS = 48
LEAST_LOG, FEW = 3, 5
ITEM_SHINGLES = 4_000_000
BITS = 20
_LOW = np.uint64((1 << BITS) - 1)

_A = np.random.default_rng(23).integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.arange(BANDS, dtype=np.uint64)[:, None] << np.uint64(58)


def _hashes(x: np.ndarray) -> np.ndarray:
    """BANDS x shingles."""
    return (x[None, :] * _A[:, None]) >> np.uint64(12)


class Keys:
    """Keys and the items that they lead to, in two sorted arrays behind a bitmap of the keys' low bits."""

    def __init__(self, keys: list[np.ndarray], items: list[np.ndarray]):
        k, i = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(k, kind="stable")
        self.keys, self.items = k[order], i[order].astype(np.int32)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.keys & _LOW] = True

    def lead(self, asked: np.ndarray) -> np.ndarray:
        asked = asked[self.seen[asked & _LOW]]
        lo, hi = np.searchsorted(self.keys, asked), np.searchsorted(self.keys, asked, "right")
        return np.concatenate([self.items[x:y] for x, y in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist())] or [self.items[:0]])


class Index:
    """The items of a block: their sets, and for each size partition the keys that lead to them.

    Items of fewer than FEW shingles are too short for bands: each of their shingles leads to them.
    """

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items, keys, owners = [], defaultdict(list), defaultdict(list)
        for i, text in items:
            x = shingle_set(text)
            if not len(x):
                continue
            log = max(LEAST_LOG, int(len(x) - 1).bit_length()) if len(x) >= FEW else -1
            k = x if log < 0 else _hashes(x).min(1) ^ _BAND[:, 0]
            keys[log].append(k)
            owners[log].append(np.full(len(k), len(self.items)))
            self.items.append((i, x))
        self.parts = {log: Keys(keys[log], owners[log]) for log in keys}

    def found(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item, shingles shared, shingles of the item) for the items contained in the text."""
        seq = shingle_sequence(text)
        if not len(seq) or not self.parts:
            return []
        leads, logs = [], sorted(x for x in self.parts if x >= 0)
        if -1 in self.parts:
            leads.append(self.parts[-1].lead(seq))
        if logs:
            first = 1 << logs[0]
            ends = np.arange(0, len(seq), first)
            mins = np.empty((BANDS, len(ends)), np.uint64)
            step = max(1, 4096 // first)
            for k in range(0, len(ends), step):
                part = seq[k * first : (k + step) * first]
                mins[:, k : k + step] = np.minimum.reduceat(_hashes(part), np.arange(0, len(part), first), axis=1)
            at = logs[0]
            for log in logs:
                while at < log:
                    mins = np.minimum.reduceat(mins, np.arange(0, mins.shape[1], 2), axis=1)
                    at += 1
                windows = np.minimum(mins[:, :-1], mins[:, 1:]) if mins.shape[1] > 1 else mins
                leads.append(self.parts[log].lead((windows ^ _BAND).ravel()))
        candidates = np.unique(np.concatenate(leads)).tolist()
        if not candidates:
            return []
        own = np.unique(seq)
        out = []
        for c in candidates:
            i, x = self.items[c]
            pos = np.searchsorted(own, x)
            shared = int((own[np.minimum(pos, len(own) - 1)] == x).sum())
            if DEN * shared >= NUM * len(x):
                out.append((i, shared, len(x)))
        return out


def _indexes(benchmark: DataFrame):
    """Broadcast indexes, one block of items after another."""
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select("item_id", "text").distinct()
    total = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // ITEM_SHINGLES))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in rows]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for every item that a document contains."""
    out = None
    for index in _indexes(benchmark):

        def search(batches, index=index):
            for b in batches:
                rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in index.value.found(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "item_id", "n_shared", "n_item"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, "doc_id long, item_id long, n_shared long, n_item long")
        out = part if out is None else out.union(part)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_shared", "n_item")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_shared", "x.n_item", F.col("x.c").alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The input rows whose text contains no item."""
    for index in _indexes(benchmark):
        docs = docs.where(_clean(index)("text"))
    return docs


def _clean(index):
    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([not index.value.found(t) for t in s], dtype=bool)

    return clean
