"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features say which runs of 3, 4 and 5 characters a text holds (lower-cased, white space as one blank). Each
is scaled by its log-count ratio between the two labels; a logistic regression is fitted on the scaled
features. The fit reads at most MAX_POSITIVE + MAX_NEGATIVE labelled rows, taken in a fixed random order
of doc_id: the documented bound of the sample, and what bounds the model that is broadcast. Of the sample's
n-grams all are features that tell the labels apart: by APART deviations at least, or by standing in ALONE
toxic texts or more and no other. The sample's features are written and stay with the executors: of a step of the
fit the driver gets sums of gradients only. Scoring reads every whole text once, without a shuffle.

Defined results: null text is scored as the empty text; without rows of both labels every score is the
smoothed share of label 1; labels that are null are ignored, of several for a doc_id the largest
counts; repeated rows are scored each; a score of exactly 0.5 is predicted 1; a null doc_id is in no fold, so
its held_out is null and it teaches nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch, fold

ORDERS = (3, 4, 5)
MAX_POSITIVE, MAX_NEGATIVE = 4_000, 8_000
#: Among millions of n-grams, those whose shares differ by fewer deviations are chance finds, and so are those in fewer toxic texts alone.
APART, ALONE = 4.0, 3
SMOOTH, L2, STEPS, ROWS = 1.0, 1e-4, 150, 512
_MULT = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str | None) -> np.ndarray:
    """64-bit hashes of all n-grams in order of length and place."""
    t = " " + " ".join((text or "").lower().split()) + " "
    x = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    out, h = [], x
    for n in range(2, ORDERS[-1] + 1):
        if len(x) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _MULT + x[n - 1 :]
        if n in ORDERS:
            out.append((h ^ (h >> np.uint64(32))) * _MULT)
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


class Model:
    """n-grams, their weights (ratio times coefficient) and the intercept."""

    def __init__(self, kept: np.ndarray, ratio: np.ndarray, weight: np.ndarray | None = None, bias: float = 0.0):
        self.kept, self.ratio = kept, ratio
        self.weight = np.zeros(len(kept)) if weight is None else weight
        self.bias = bias
        self._table = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g.view(np.uint64) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _index(self) -> None:
        """A table with open addresses: an n-gram stands in the first free slot from its own on."""
        self._bits = max(10, int(4 * len(self.kept)).bit_length())
        self._table, todo, at = np.full(1 << self._bits, -1, np.int32), np.arange(len(self.kept)), self._slot(self.kept)
        self._walk = 1
        while len(todo):
            free = self._table[at] < 0
            self._table[at[free]] = todo[free]  # of several for one slot one stays
            left = self._table[at] != todo
            todo, at = todo[left], (at[left] + 1) & ((1 << self._bits) - 1)
            self._walk += 1

    def features(self, text: str | None) -> np.ndarray:
        """Which of the kept n-grams the text holds."""
        if self._table is None:
            self._index()
        g = grams(text)
        at, found = self._slot(g), []
        for _ in range(self._walk):
            k = self._table[at]
            has = k >= 0
            g, at, k = g[has], at[has], k[has]
            if not len(g):
                break
            same = self.kept[k] == g
            found.append(k[same])
            g, at = g[~same], (at[~same] + 1) & ((1 << self._bits) - 1)
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)

    def score(self, text: str | None) -> float:
        return float(_sigmoid(self.bias + self.weight[self.features(text)].sum()))

    def fit(self, blocks: RDD, n: int, n1: int) -> None:
        """Full-batch logistic regression over features scaled by the ratios, on blocks of n rows, n1 of them labelled 1.

        A step is one pass over the blocks, of which each partition returns one sum of gradients.
        """
        w, b = np.zeros(len(self.kept)), float(np.log(n1 / (n - n1)))
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, STEPS + 1):
            g = np.sum(blocks.mapPartitions(_slope(w * self.ratio, b)).collect(), axis=0)
            g /= n
            g[:-1] = g[:-1] * self.ratio + L2 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        self.weight, self.bias = w * self.ratio, b


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def _blocked(rows):
    """Blocks of ROWS rows: the features of all in a row, how many each has, and the labels."""
    rows = iter(rows)
    while part := list(islice(rows, ROWS)):
        x = [np.frombuffer(r["x"], np.int32) for r in part]
        yield np.concatenate(x), np.array([len(f) for f in x]), np.array([r["label"] for r in part], float)


def _slope(scaled: np.ndarray, bias: float):
    """The gradient by the scaled features and the bias, summed over a partition's blocks."""

    def run(blocks):
        g = np.zeros(len(scaled) + 1)
        for col, sizes, label in blocks:
            row = np.repeat(np.arange(len(label)), sizes)
            err = _sigmoid(bias + np.bincount(row, scaled[col], len(label))) - label
            g[:-1] += np.bincount(col, err[row], len(scaled))
            g[-1] += err.sum()
        yield g

    return run


def _counted(batches):
    """Documents of each label that hold an n-gram, summed over the task's rows."""
    found = {0: [], 1: []}
    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found[y].append(np.unique(grams(t)))
    per = {y: np.unique(np.concatenate(x), return_counts=True) if x else (np.empty(0, np.int64), np.empty(0, np.int64)) for y, x in found.items()}
    for y, (g, c) in per.items():
        z = np.zeros(len(g), np.int64)
        for k in range(0, len(g), 200_000):
            p, n = (c, z) if y else (z, c)
            yield pa.RecordBatch.from_arrays([pa.array(g[k : k + 200_000]), pa.array(p[k : k + 200_000]), pa.array(n[k : k + 200_000])], ["gram", "pos", "neg"])


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, label (0 or 1). At most so many rows of each label are read."""
    ship(docs.sparkSession)
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    share = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    pick = lambda y, most: known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most max_positive + max_negative ids: the bound that allows the broadcast.
    sample = F.broadcast(pick(1, max_positive).union(pick(0, max_negative)))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("text", "label")
    base = float(np.log((share["p"] + 0.5) / (share["n"] - share["p"] + 0.5)))
    if not share["p"] or share["p"] == share["n"]:
        return Model(np.empty(0, np.int64), np.empty(0), bias=base)
    totals = rows.groupBy("label").count().collect()
    size = {r["label"]: r["count"] for r in totals}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Model(np.empty(0, np.int64), np.empty(0), bias=base)
    counts = rows.mapInArrow(_counted, "gram long, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = (F.col("pos") + SMOOTH) / (n1 + 2 * SMOOTH), (F.col("neg") + SMOOTH) / (n0 + 2 * SMOOTH)
    # How far the two shares lie apart in deviations.
    apart = F.abs(p - q) / F.sqrt(p * (1 - p) / n1 + q * (1 - q) / n0)
    telling = (apart >= APART) | ((F.col("pos") >= ALONE) & (F.col("neg") == 0))
    kept = counts.where(telling).select("gram", F.log(p / q).alias("ratio")).toArrow().sort_by("gram")
    model = Model(kept["gram"].to_numpy(), kept["ratio"].to_numpy())

    def featured(batches):
        for b in batches:
            out = [model.features(t).astype(np.int32).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column(1)], ["x", "label"])

    # The features stay on the executors; the driver gets one gradient a partition and step.
    scratch = Scratch(docs.sparkSession)
    got = scratch.put(rows.mapInArrow(featured, "x binary, label int"), "features")
    blocks = got.rdd.coalesce(docs.sparkSession.sparkContext.defaultParallelism).mapPartitions(_blocked).persist(StorageLevel.MEMORY_AND_DISK)
    model.fit(blocks, n1 + n0, n1)
    blocks.unpersist()
    scratch.drop(got)
    model.bias += base - float(np.log(n1 / n0))  # from the sample's share of label 1 to that of all labelled rows
    return model


def score(text: str | Column, model: Model, spark) -> Column:
    """A double in (0, 1) for a text column."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for s in parts:
            yield pd.Series([m.score(t) for t in s], dtype=float)

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from rows whose crc32(doc_id) mod folds is not 0."""
    learn = fold("doc_id", folds) != 0
    model = fit(docs.where(learn), labels.where(learn).select("doc_id", F.col("toxic").alias("label")))
    out = docs.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), score("text", model, docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The input rows without those predicted toxic."""
    learn = fold("doc_id", folds) != 0
    model = fit(docs.where(learn), labels.where(learn).select("doc_id", F.col("toxic").alias("label")))
    return docs.where(score("text", model, docs.sparkSession) < 0.5)
