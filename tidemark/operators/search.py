"""Hyperparameter search (M7): every trial in every fold is fitted in the same passes over the rows.

A pass is one Spark job: tasks add up their rows' part of what all models need and Spark sums the parts by cell,
so the driver sees numbers whose count hangs on trials, folds and features, never on rows. Random choices hash the row's id.

* linear: penalised logistic regressions. One pass gives each fold's Gram matrix, of which a quarter bounds every
  Hessian; then each pass gives the gradients of all trials x folds, as one matrix product a batch, and the driver
  solves each model's penalised quadratic bound (accelerated, restarted). Objective and standardisation are Spark ML's.
* forest, boosted: histogram trees on features cut at 31 quantiles; a pass grows one level of all trees of all folds.
  Rows that fall in the same bins with the same weight are alike to every tree, so they are first counted by these
  cells, by fold and label and with their copies in the bootstrap samples, and the passes read the cells: their
  number ends at that of the bins' combinations, and sums are the same as over rows.
  Trials that differ only in what a larger fit contains share it exactly: a forest's first trees, its trees cut
  at a lower depth, a boosted model's first rounds.

Each trial is also fitted on all rows, in the same passes. AUC by fold comes from counts in 1,024 bins of the
probability, with the share of pairs that fall in one bin as ``slack``; that of the best trials is exact.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import released, ship, written
from .quantiles import cumulative

ALL = -1  # the fold number of the fit on all rows
BINS, AUC_BINS, CELLS, ENTRIES = 32, 1_024, 1_000_000, 2_000_000
PORTION = 65_536  # numbers that a step over rows x models holds in the processor's cache
TREES, ROUNDS = (10, 20, 40), (5, 10, 20)
SHRINK = 1.0  # added to a boosted leaf's hessian
GRID = 2.0**24  # gradients are multiples of 1 / GRID, so that their sums do not hang on the order of tasks


@dataclass
class Trial:
    number: int
    learner: str
    params: dict[str, float]
    aucs: list[float] = field(default_factory=list)
    slack: float = 0.0
    exact: float | None = None

    @property
    def auc(self) -> float:
        return self.exact if self.exact is not None else float(np.mean(self.aucs))


def draw(names: Sequence[str], trials: int, seed: int = 42) -> list[Trial]:
    """Seeded random parameters, learners in turn."""
    out = []
    for i in range(trials):
        name, rng = names[i % len(names)], np.random.default_rng([seed, i])
        pick = lambda *xs: xs[int(rng.integers(len(xs)))]  # noqa: E731, B023
        if name == "linear":
            params = {"penalty": float(10 ** rng.uniform(-4, 0)), "l1_share": float(rng.uniform(0, 1))}
        elif name == "forest":
            params = {"depth": pick(3, 4, 5, 6), "trees": pick(*TREES), "features": pick(0.5, 1.0), "least": pick(2, 20)}
        elif name == "boosted":
            params = {"depth": pick(2, 3, 4), "rounds": pick(*ROUNDS), "rate": pick(0.1, 0.3), "least": pick(1, 5)}
        else:
            raise ValueError(f"unknown learner {name}")
        out.append(Trial(i, name, params))
    return out


def _columns(b: pa.RecordBatch):
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
    return x, *(b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold", "w", "h"))


def _bytes(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of binaries, and where each starts and the last ends."""
    at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    data = np.frombuffer(c.buffers()[2], np.uint8) if c.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _numbers(c: pa.Array, kind) -> np.ndarray:
    """(rows, width) of a column of equally long binaries."""
    return np.frombuffer(_bytes(c)[0].tobytes(), kind).reshape(len(c), -1)


def _packed(v: np.ndarray) -> pa.Array:
    """Rows of numbers as binaries: of bytes where all are counts below 256, else of doubles."""
    small = ((v >= 0) & (v < 256) & (v == np.floor(v))).all(1)
    short = np.where(small[:, None], v, 0).astype(np.uint8)
    return pa.array([a.tobytes() if of else b.tobytes() for of, a, b in zip(small, short, np.ascontiguousarray(v))], pa.binary())


def _unpacked(c: pa.Array, width: int) -> np.ndarray:
    data, at = _bytes(c)
    small, at = np.diff(at) == width, at[:-1, None]
    if small.all():
        return data.reshape(len(c), width).astype(float)
    out = np.empty((len(c), width))
    out[small] = data[at[small] + np.arange(width)]
    out[~small] = data[at[~small] + np.arange(8 * width)].view(float)
    return out


def _summed(rows: DataFrame, size: int, add: Callable, shared: Any) -> np.ndarray:
    """(2, size): what ``add(total, shared, batch)`` adds up over all batches of rows. Tasks send the numbers they touched."""
    sent = rows.sparkSession.sparkContext.broadcast(shared)

    def each(batches):
        total = np.zeros((2, size))
        for b in batches:
            if b.num_rows:
                add(total, sent.value, b)
        k = np.flatnonzero(total.any(0))
        for i in range(0, len(k), 100_000):
            at = k[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["k", "a", "b"])

    got = rows.mapInArrow(each, "k long, a double, b double").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    out = np.zeros((2, size))
    out[:, got.column("k").to_numpy()] = got.column("a").to_numpy(), got.column("b").to_numpy()
    sent.destroy()
    return out


# Logistic regressions


@dataclass
class Linear:
    """Coefficients by model (trial, fold) on standardised features, intercept first."""

    mean: np.ndarray
    scale: np.ndarray
    beta: dict[tuple[int, int], np.ndarray]

    def standard(self, x: np.ndarray) -> np.ndarray:
        z = np.nan_to_num((x - self.mean) / self.scale, nan=0.0, posinf=0.0, neginf=0.0)
        return np.hstack([np.ones((len(x), 1)), z])

    def score(self, x: np.ndarray, number: int, fold: int) -> np.ndarray:
        return _sigmoid(self.standard(x) @ self.beta[number, fold])


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -500, 500)))


def _add_means(total, k, b):
    x, y, fold, w, _ = _columns(b)
    d = x.shape[1]
    seen = ~np.isnan(x)
    total[0, :d] += (np.where(seen, x, 0) * w[:, None]).sum(0)
    total[1, :d] += (seen * w[:, None]).sum(0)
    for f in range(k):
        total[0, d + f] += (w * y)[fold == f].sum()
        total[1, d + f] += (w[fold == f] ** 2).sum()


def _add_grams(total, shared, b):
    k, fit = shared
    x, _, fold, w, _ = _columns(b)
    z = fit.standard(x)
    d = z.shape[1]
    for f in range(k):
        on = fold == f
        total[0, f * d * d : (f + 1) * d * d] += (z[on].T @ (z[on] * w[on, None])).ravel()


def _add_gradients(total, shared, b):
    fit, beta, folds = shared
    x, y, fold, w, _ = _columns(b)
    z, down = fit.standard(x), -beta.T
    step, gradient = max(1, PORTION // len(beta)), np.zeros((z.shape[1], len(beta)))
    for f in np.unique(fold):
        own, on = np.zeros_like(gradient), fold == f
        zf, yf, wf = z[on], y[on, None], w[on, None]
        for i in range(0, len(zf), step):
            r = zf[i : i + step] @ down
            np.clip(r, -500, 500, out=r)
            np.exp(r, out=r)
            r += 1
            np.reciprocal(r, out=r)
            r -= yf[i : i + step]
            own += (zf[i : i + step] * wf[i : i + step]).T @ r
        inside = (folds != f) | (folds == ALL)
        gradient[:, inside] += own[:, inside]
    total[0] += gradient.ravel()


def _solve(at: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, l1: np.ndarray, l2: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Least of the penalised quadratic bound of each model (row) around ``at``, by coordinate descent on all models at once."""
    beta, g = at.copy(), gradient.copy()
    for _ in range(sweeps):
        most = 0.0
        for j in range(beta.shape[1]):
            if hessian[j, j] <= 0:
                continue
            u = hessian[j, j] * beta[:, j] - g[:, j]
            new = np.sign(u) * np.maximum(np.abs(u) - l1[:, j], 0) / (hessian[j, j] + l2[:, j])
            step = new - beta[:, j]
            beta[:, j] = new
            g += step[:, None] * hessian[j]
            most = max(most, float(np.abs(step).max()))
        if most < 1e-9:
            break
    return beta


def fit_linear(rows: DataFrame, trials: Sequence[Trial], d: int, k: int, passes: int = 80, tolerance: float = 1e-5) -> Linear:
    sums = _summed(rows, d + k, _add_means, k)
    fit = Linear(np.divide(sums[0, :d], sums[1, :d], out=np.zeros(d), where=sums[1, :d] > 0), np.ones(d), {})
    n = d + 1
    grams = _summed(rows, k * n * n, _add_grams, (k, fit))[0].reshape(k, n, n)
    whole = grams.sum(0)
    spread = np.sqrt(np.maximum(np.diag(whole)[1:] / max(whole[0, 0], 1), 0))
    fit.scale = np.where(spread > 1e-12 * (1 + np.abs(fit.mean)), spread, np.inf)
    unit = np.concatenate([[1.0], 1 / fit.scale])
    grams = grams * unit[:, None] * unit[None, :]
    models = [(t, f) for t in trials for f in [*range(k), ALL]]
    folds = np.array([f for _, f in models])
    train = {f: grams.sum(0) - (grams[f] if f >= 0 else 0) for f in [*range(k), ALL]}
    size = {f: max(g[0, 0], 1.0) for f, g in train.items()}
    squares = {f: sums[1, d:].sum() - (sums[1, d + f] if f >= 0 else 0) for f in train}  # of the weights
    deviation = {f: np.sqrt(np.maximum(np.diag(g) - g[0] ** 2 / size[f], 0) / max(size[f] - squares[f] / size[f], 1e-12)) for f, g in train.items()}
    for f in deviation:
        deviation[f][0] = 0.0  # the intercept goes free
    penalty = np.array([[t.params["penalty"], t.params["l1_share"]] for t, _ in models])
    by_column = np.stack([deviation[f] for f in folds])
    l1 = (penalty[:, 0] * penalty[:, 1])[:, None] * by_column
    l2 = (penalty[:, 0] * (1 - penalty[:, 1]))[:, None] * by_column**2
    beta = np.zeros((len(models), n))
    labels = sums[0, d:].sum() - np.array([sums[0, d + f] if f >= 0 else 0 for f in folds])
    share = np.clip(labels / np.array([size[f] for f in folds]), 1e-6, 1 - 1e-6)
    beta[:, 0] = np.log(share / (1 - share))
    ahead, t, active = beta.copy(), np.ones(len(models)), np.arange(len(models))
    for _ in range(passes):
        sent = ahead[active]
        g = _summed(rows, n * len(active), _add_gradients, (fit, sent, folds[active]))[0].reshape(n, -1).T
        new = np.empty_like(sent)
        for f in set(folds[active]):
            on = folds[active] == f
            at = active[on]
            new[on] = _solve(sent[on], g[on] / size[f], train[f] / (4 * size[f]), l1[at], l2[at])
        moved = new - beta[active]
        restart = ((sent - new) * moved).sum(1) > 0
        nxt = np.where(restart, 1.0, (1 + np.sqrt(1 + 4 * t[active] ** 2)) / 2)
        ahead[active] = new + np.where(restart, 0.0, (t[active] - 1) / nxt)[:, None] * moved
        beta[active], t[active] = new, nxt
        active = active[np.abs(moved).max(1) > tolerance * (1 + np.abs(new).max(1))]
        if not len(active):
            break
    fit.beta = {(m.number, f): beta[i] for i, (m, f) in enumerate(models)}
    return fit


# Trees


@dataclass
class Trees:
    """Trees as heaps: the children of node i are 2 i + 1 and 2 i + 2; a node without a feature is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, trees: int, depth: int) -> Trees:
        n = 2 ** (depth + 1) - 1
        return cls(np.full((trees, n), -1, np.int16), np.zeros((trees, n), np.int16), np.zeros((trees, n)))

    def take(self, at) -> Trees:
        return Trees(self.feature[at], self.cut[at], self.value[at])

    def nodes(self, tree: int, bins: np.ndarray, depths: Sequence[int]) -> Iterator[np.ndarray]:
        """For each of the ascending depths the node of every row at that depth, or the leaf above it."""
        f, every = self.feature[tree].astype(np.int64), np.arange(self.feature.shape[1])
        leaf, flat, start = f < 0, bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        f, cut, below = np.where(leaf, 0, f), np.where(leaf, BINS, self.cut[tree]), np.where(leaf, every, 2 * every + 1)
        node = np.zeros(len(bins), np.int64)
        for above, depth in zip([0, *depths], depths):
            for _ in range(above, depth):
                node = below.take(node) + (flat.take(start + f.take(node)) > cut.take(node))
            yield node

    def values(self, bins: np.ndarray, depths: Sequence[int]) -> dict[int, np.ndarray]:
        """For each of the depths (rows, trees): the values of the nodes there, or of the leaves above."""
        depths = sorted(set(depths))
        out = {d: np.empty((len(bins), len(self.feature))) for d in depths}
        for t in range(len(self.feature)):
            for d, node in zip(depths, self.nodes(t, bins, depths)):
                out[d][:, t] = self.value[t].take(node)
        return out


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Place of each value among its feature's cut points; NaN comes last."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if len(edges) else np.zeros((len(x), 0), int)


@dataclass
class Cells:
    """Rows counted by their bins and weight: one row a cell, or a few. ``key``: the bins as bytes, then the weight;
    ``n``: by fold (the last for any other number) the rows and those of label 1; ``c``: the same of the copies that
    the bootstrap sample of each tree holds."""

    frame: DataFrame
    folds: int
    trees: int


def _key(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    key = _numbers(b.column("key"), np.uint8)
    return key[:, :-8], np.ascontiguousarray(key[:, -8:]).view(float).ravel()


def _gathered(batches, step: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of ``step`` rows or a little more."""
    held, n = [], 0
    for b in batches:
        for i in range(0, b.num_rows, step):
            held.append(b.slice(i, step))
            n += held[-1].num_rows
            if n >= step:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))


def cells(rows: DataFrame, edges: Sequence[np.ndarray], k: int, trees: int = 0) -> Cells:
    """Tasks count what they read by cell and fold, then what belongs to a cell comes together; so a frequent cell has
    a few rows a task. The number of copies hangs on row and tree alone."""
    spark, width, step = rows.sparkSession, 1 + trees, max(1, ENTRIES // max(1 + trees, len(edges)))
    sent = spark.sparkContext.broadcast(edges)

    def each(batches):
        for b in _gathered(batches, step):
            x, y, fold, w, h = _columns(b)
            slot = np.where((fold >= 0) & (fold < k), fold, k).astype(np.uint8)
            raw = np.hstack([slot[:, None], binned(x, sent.value).astype(np.uint8), w.astype(float)[:, None].view(np.uint8)])
            words = np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.uint64)
            order = np.lexsort(words.T)
            starts = _runs(words[order])
            rows_of = np.hstack([np.ones((len(order), 1)), _copies(h[order], np.arange(trees))])
            found = np.stack([np.add.reduceat(rows_of, starts, 0), np.add.reduceat(rows_of * y[order, None], starts, 0)], 1)
            first = raw[order[starts]]
            for i in range(0, len(starts), 10_000):
                at = slice(i, i + 10_000)
                key = pa.array([v.tobytes() for v in first[at, 1:]], pa.binary())
                yield pa.RecordBatch.from_arrays([key, pa.array(first[at, 0].astype(np.int32)), _packed(found[at].reshape(-1, 2 * width))], ["key", "f", "v"])

    def merged(batches):
        for b in batches:
            if not b.num_rows:
                continue
            key = _numbers(b.column("key"), np.uint8)
            starts = _runs(key)
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
            at = run * (k + 1) + b.column("f").to_numpy()
            order = np.argsort(at, kind="stable")
            parts = _runs(at[order, None])
            found = np.zeros((len(starts) * (k + 1), 2 * width))
            found[at[order][parts]] = np.add.reduceat(_unpacked(b.column("v"), 2 * width)[order], parts, 0)
            found = found.reshape(len(starts), k + 1, 2, width)
            columns = [pa.array([v.tobytes() for v in key[starts]], pa.binary()), *(_packed(v.reshape(len(starts), -1)) for v in (found[..., 0], found[..., 1:]))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "c"])

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = rows.mapInArrow(each, "key binary, f int, v binary").repartition(parts, "key").sortWithinPartitions("key")
    out = Cells(written(counted.mapInArrow(merged, "key binary, n binary, c binary")), k, trees)
    sent.destroy()
    return out


def _kept(out: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which folds (k and the rest) count where one is left out, as columns; and each model's column."""
    left, column = np.unique(out, return_inverse=True)
    return (np.arange(k + 1)[:, None] != left[None, :]).astype(float), column


def _add_level(total, shared, b):
    """Histograms of gradient and hessian by (slot, feature, bin) for the nodes that are open at this level."""
    trees, level, slot, first, weigh = shared
    bins, w = _key(b)
    d, bins = bins.shape[1], bins.astype(np.int64)
    by_feature = np.ascontiguousarray(bins.T) + np.arange(d)[:, None] * BINS
    weighed = weigh(b, w)
    for t in range(len(first) - 1):
        (node,) = trees.nodes(t, bins, [level])
        at = slot[t].take(node) - first[t]
        g, hess = weighed(t)
        on = np.flatnonzero((at >= 0) & (hess > 0))
        whole = slice(first[t] * d * BINS, first[t + 1] * d * BINS)
        at, g, hess = at.take(on) * (d * BINS), g.take(on), hess.take(on)
        for j in range(d):
            cell = at + by_feature[j].take(on)
            total[0, whole] += np.bincount(cell, g, whole.stop - whole.start)
            total[1, whole] += np.bincount(cell, hess, whole.stop - whole.start)


def _grow(frame: DataFrame, d: int, trees: Trees, depths: np.ndarray, least: np.ndarray, shrink: float, weigh: Callable, allowed: Callable | None = None) -> None:
    """Grow all trees level by level, each to its own depth."""
    for level in range(int(depths.max())):
        first = 2**level - 1
        inner = np.zeros_like(trees.feature, bool)
        if level == 0:
            inner[:, 0] = True
        else:
            parents = trees.feature[:, (first - 1) // 2 : first] >= 0
            inner[:, first : 2 * first + 1] = np.repeat(parents, 2, axis=1)
        open_ = np.argwhere(inner & (level < depths)[:, None])
        for i in range(0, len(open_), max(1, CELLS // (d * BINS))):
            part = open_[i : i + max(1, CELLS // (d * BINS))]
            used, start = np.unique(part[:, 0], return_index=True)
            slot = np.full((len(used), trees.feature.shape[1]), -1, np.int64)
            slot[np.searchsorted(used, part[:, 0]), part[:, 1]] = np.arange(len(part))
            hist = _summed(frame, len(part) * d * BINS, _add_level, (trees.take(used), level, slot, np.append(start, len(part)), weigh(used)))
            _split(trees, part, hist.reshape(2, len(part), d, BINS), least[part[:, 0]], shrink, allowed)


def _split(trees: Trees, part: np.ndarray, hist: np.ndarray, least: np.ndarray, shrink: float, allowed: Callable | None) -> None:
    """Values of the nodes; for those that can be split the feature and cut of the largest gain, and the values below."""
    g, h = hist
    left_g, left_h = g.cumsum(-1), h.cumsum(-1)
    all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    ok = (left_h >= least[:, None, None]) & (right_h >= least[:, None, None]) & (left_h > 0) & (right_h > 0)
    if allowed is not None:
        ok &= np.stack([allowed(t, n) for t, n in part])[:, :, None]
    score = lambda a, b: np.divide(a * a, b + shrink, out=np.zeros_like(a), where=b + shrink > 0)
    value = lambda a, b: np.divide(-a, b + shrink, out=np.zeros(len(a)), where=b + shrink > 0)
    gain = np.where(ok, score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h), -1.0).reshape(len(part), -1)
    best = gain.argmax(1)
    won = np.flatnonzero(gain[np.arange(len(part)), best] > 1e-9)
    t, n = part[:, 0], part[:, 1]
    trees.value[t, n] = value(all_g[:, 0, 0], all_h[:, 0, 0])
    t, n, at = t[won], n[won], (won, best[won] // BINS, best[won] % BINS)
    trees.feature[t, n], trees.cut[t, n] = at[1:]
    for child, a, b in ((1, left_g, left_h), (2, right_g, right_h)):
        trees.value[t, 2 * n + child] = value(a[at], b[at])


_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720)])


def _copies(h: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """(rows, trees): how often a bootstrap sample holds the row, by hash of row and tree."""
    z = h.astype(np.uint64)[:, None] + (tree.astype(np.uint64) + np.uint64(1))[None, :] * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) / 2.0**53, side="right").astype(float)


def _by_copies(number, out, k, trees, b, w):
    """Gradients of a forest's trees: of squared loss around 0, times a bootstrap sample's copies."""
    keep, column = _kept(out, k)
    copies = _unpacked(b.column("c"), 2 * (k + 1) * trees).reshape(len(w), k + 1, 2, trees)
    every, ones = (np.ascontiguousarray((copies[:, :, i].transpose(2, 0, 1) @ keep).transpose(0, 2, 1)) * w for i in (0, 1))
    return lambda t: (-ones[number[t], column[t]], every[number[t], column[t]])


@dataclass
class Forests:
    edges: list[np.ndarray]
    first: dict[tuple, int]  # (family, fold) -> its first tree
    trees: Trees
    family: dict[int, tuple]

    def each(self, bins: np.ndarray, trials: Sequence[Trial], fold: int) -> Iterator[tuple[Trial, np.ndarray]]:
        """Each trial and its scores of the rows."""
        for family in dict.fromkeys(self.family[t.number] for t in trials):
            own, at = [t for t in trials if self.family[t.number] == family], self.first[family, fold]
            values = self.trees.take(slice(at, at + max(t.params["trees"] for t in own))).values(bins, [t.params["depth"] for t in own])
            yield from ((t, values[t.params["depth"]][:, : t.params["trees"]].mean(1)) for t in own)

    def score(self, x: np.ndarray, trial: Trial, fold: int) -> np.ndarray:
        return next(self.each(binned(x, self.edges), [trial], fold))[1]


def fit_forests(rows: DataFrame | Cells, trials: Sequence[Trial], edges: list[np.ndarray], k: int, seed: int) -> Forests:
    made = rows if isinstance(rows, Cells) else cells(rows, edges, k, max(t.params["trees"] for t in trials))
    family = {t.number: (t.params["features"], t.params["least"]) for t in trials}
    kinds = {f: [t for t in trials if family[t.number] == f] for f in sorted(set(family.values()))}
    plan = [(f, fold, i) for f, ts in kinds.items() for fold in [*range(k), ALL] for i in range(max(t.params["trees"] for t in ts))]
    depths = np.array([max(t.params["depth"] for t in kinds[f]) for f, _, _ in plan])
    least, d = np.array([float(f[1]) for f, _, _ in plan]), len(edges)
    number, folds = np.array([i for _, _, i in plan]), np.array([f for _, f, _ in plan])
    trees = Trees.empty(len(plan), int(depths.max()))

    def weigh(used):
        return partial(_by_copies, number[used], folds[used], k, made.trees)

    def allowed(t, node):
        """The features that a node may be split by, drawn by tree and node alone."""
        some = np.zeros(d, bool)
        some[np.random.default_rng([seed, int(number[t]), int(node)]).permutation(d)[: max(1, int(np.ceil(plan[t][0][0] * d)))]] = True
        return some

    _grow(made.frame, d, trees, depths, least, 0.0, weigh, allowed)
    if made is not rows:
        released(made.frame)
    first = {}
    for i, (f, fold, _) in enumerate(plan):
        first.setdefault((f, fold), i)
    return Forests(edges, first, trees, family)


@dataclass
class Boosted:
    edges: list[np.ndarray]
    model: dict[tuple, int]  # (family, fold) -> its row in each round
    base: np.ndarray
    rate: np.ndarray
    rounds: list[Trees]
    depth: int
    family: dict[int, tuple]

    def each(self, bins: np.ndarray, trials: Sequence[Trial], fold: int) -> Iterator[tuple[Trial, np.ndarray]]:
        """Each trial and its scores of the rows."""
        for family in dict.fromkeys(self.family[t.number] for t in trials):
            own, at = [t for t in trials if self.family[t.number] == family], self.model[family, fold]
            rounds = self.rounds[: max(t.params["rounds"] for t in own)]
            values = Trees(*(np.stack([getattr(r, c)[at] for r in rounds]) for c in ("feature", "cut", "value"))).values(bins, [self.depth])[self.depth]
            yield from ((t, _sigmoid(self.base[at] + self.rate[at] * values[:, : t.params["rounds"]].sum(1))) for t in own)

    def score(self, x: np.ndarray, trial: Trial, fold: int) -> np.ndarray:
        return next(self.each(binned(x, self.edges), [trial], fold))[1]


def _by_margins(at, out, k, b, w):
    """Gradients of the logistic loss at the margins of the rounds before. Each row's is rounded, then counted."""
    keep, column = _kept(out, k)
    n = _unpacked(b.column("n"), 2 * (k + 1)).reshape(len(w), k + 1, 2)
    every, ones = (np.ascontiguousarray((n[:, :, i] @ keep).T) for i in (0, 1))
    margins = np.ascontiguousarray(_numbers(b.column("m"), float).T)
    grid = w * GRID

    def weighed(t):
        p, some, good = _sigmoid(margins[at[t]]), every[column[t]], ones[column[t]]
        return (np.rint(p * grid) * (some - good) + np.rint((p - 1) * grid) * good) / GRID, np.rint(p * (1 - p) * grid) * some / GRID

    return weighed


def _with_margins(frame: DataFrame, fit: Boosted) -> DataFrame:
    """The cells with all models' margins after the last round, as one binary of doubles; at first their base."""
    sent = frame.sparkSession.sparkContext.broadcast((fit.base, fit.rate, fit.rounds[-1:], fit.depth))

    def each(batches):
        base, rate, last, depth = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            m = _numbers(b.column("m"), float) if last else np.zeros((b.num_rows, len(base))) + base
            for trees in last:
                m = m + rate * trees.values(_key(b)[0].astype(np.int64), [depth])[depth]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array([v.tobytes() for v in m], pa.binary())], ["key", "n", "m"])

    out = written(frame.select("key", "n", *(["m"] if fit.rounds else [])).mapInArrow(each, "key binary, n binary, m binary"))
    sent.destroy()
    return out


def fit_boosted(rows: DataFrame | Cells, trials: Sequence[Trial], edges: list[np.ndarray], k: int, shares: dict[int, float]) -> Boosted:
    """All models advance by a round together; each round's margins are written, so that a pass grows one level of one round."""
    made = rows if isinstance(rows, Cells) else cells(rows, edges, k)
    family = {t.number: (t.params["depth"], t.params["rate"], t.params["least"]) for t in trials}
    rounds = {f: max(t.params["rounds"] for t in trials if family[t.number] == f) for f in sorted(set(family.values()))}
    plan = [(f, fold) for f in rounds for fold in [*range(k), ALL]]
    folds = np.array([fold for _, fold in plan])
    share = np.clip([shares[fold] for fold in folds], 1e-6, 1 - 1e-6)
    fit = Boosted(edges, {p: i for i, p in enumerate(plan)}, np.log(share / (1 - share)), np.array([f[1] for f, _ in plan]), [], max(f[0] for f in rounds), family)
    current = _with_margins(made.frame, fit)
    for r in range(max(rounds.values())):
        on = np.array([i for i, (f, _) in enumerate(plan) if rounds[f] > r])
        trees = Trees.empty(len(plan), fit.depth)
        grown = trees.take(on)
        weigh = lambda used, on=on: partial(_by_margins, on[used], folds[on[used]], k)
        _grow(current, len(edges), grown, np.array([plan[i][0][0] for i in on]), np.array([float(plan[i][0][2]) for i in on]), SHRINK, weigh)
        trees.feature[on], trees.cut[on], trees.value[on] = grown.feature, grown.cut, grown.value
        fit.rounds.append(trees)
        before, current = current, _with_margins(current, fit)
        released(before)
    released(current)
    if made is not rows:
        released(made.frame)
    return fit


# The search


@dataclass
class Search:
    """The trials and their fits."""

    trials: list[Trial]
    folds: int
    fits: dict[str, Any]
    features: str

    def ranked(self) -> list[Trial]:
        return sorted(self.trials, key=lambda t: (-t.auc, t.number))

    def table(self, spark) -> DataFrame:
        """trial, learner, params, auc (mean over folds; exact for the best), slack."""
        rows = [(t.number, t.learner, json.dumps(t.params, sort_keys=True), t.auc, 0.0 if t.exact is not None else t.slack) for t in self.trials]
        return spark.createDataFrame(rows, "trial int, learner string, params string, auc double, slack double")

    def scores(self, df: DataFrame, trials: Sequence[Trial], fold: str | None = None) -> DataFrame:
        """The columns of ``df`` and s_<trial>: with ``fold`` the score of the fit without the row's fold, else of the fit on all rows."""
        ship(df.sparkSession)
        kept = [c for c in df.columns if c != self.features]
        sent = df.sparkSession.sparkContext.broadcast((self.fits, list(trials), self.folds))
        rows = df.select(*kept, _array(df, self.features).alias("__x"), (F.col(fold).cast("int") if fold else F.lit(ALL)).alias("__fold"))

        def each(batches):
            fits, wanted, k = sent.value
            for b in batches:
                n = b.num_rows
                out = np.full((len(wanted), n), np.nan)
                x = b.column("__x")
                good = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False)) if n else np.empty(0, int)
                if len(good):
                    m = x.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(good), -1)
                    f = b.column("__fold").fill_null(-2).to_numpy(zero_copy_only=False)[good]
                    for i, t in enumerate(wanted):
                        for v in set(f) & {*range(k), ALL}:
                            out[i, good[f == v]] = fits[t.learner].score(m[f == v], *((t.number,) if t.learner == "linear" else (t,)), int(v))
                cols = [b.column(c) for c in kept] + [pa.array(v, from_pandas=True) for v in out]
                yield pa.RecordBatch.from_arrays(cols, [*kept, *[f"s_{t.number}" for t in wanted]])

        kinds = ", ".join(f"`{c}` {k}" for c, k in df.dtypes if c != self.features)
        return rows.mapInArrow(each, f"{kinds}, {', '.join(f's_{t.number} double' for t in trials)}")


def _array(df: DataFrame, c: str):
    return vector_to_array(c) if dict(df.dtypes)[c] == "vector" else F.col(c).cast("array<double>")


def _add_linear_ranks(total, shared, b):
    """Positives and negatives by (trial, fold, bin of the score)."""
    fit, trials, k = shared
    x, y, fold, _, _ = _columns(b)
    for f in range(k):
        on = np.flatnonzero(fold == f)
        if len(on):
            _rank(total, ((i, fit.score(x[on], t.number, f)) for i, t in enumerate(trials)), k, f, y[on], 1 - y[on])


def _add_tree_ranks(total, shared, b):
    fits, trials, k = shared
    bins, place = _key(b)[0].astype(np.int64), {t.number: i for i, t in enumerate(trials)}
    n = _unpacked(b.column("n"), 2 * (k + 1)).reshape(len(bins), k + 1, 2)
    for f in range(k):
        on = np.flatnonzero(n[:, f, 0])
        for name, fit in fits.items():
            scored = fit.each(bins[on], [t for t in trials if t.learner == name], f)
            _rank(total, ((place[t.number], p) for t, p in scored), k, f, n[on, f, 1], n[on, f, 0] - n[on, f, 1])


def _rank(total, scored, k, f, positives, negatives):
    for i, p in scored:
        at, cell = slice((i * k + f) * AUC_BINS, (i * k + f + 1) * AUC_BINS), np.minimum((p * AUC_BINS).astype(int), AUC_BINS - 1)
        total[0, at] += np.bincount(cell, positives, AUC_BINS)
        total[1, at] += np.bincount(cell, negatives, AUC_BINS)


def search(df: DataFrame, ident: str, names: Sequence[str], trials: int, label: str = "label", fold: str = "fold", features: str = "features", k: int = 5, seed: int = 42, weight: str | None = None, exact: int = 3) -> Search:
    """M7: cross-validated AUC of seeded random trials of the learners, all fitted together.

    Rows without label, fold or features are left out; NaN features count as the mean (linear) or as the largest
    (trees); repeated rows count each; no rows, or one class only, is an error.
    """
    spark = df.sparkSession
    ship(spark)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = df.select(F.xxhash64(F.lit(seed), F.col(ident).cast("string")).alias("h"), _array(df, features).alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"), w.alias("w"))
    rows = written(known.where("x is not null and y is not null and fold is not null and w is not null"))
    counts = {r["fold"]: (r["n"], r["p"]) for r in rows.groupBy("fold").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("p")).collect()}  # one row a fold
    n, p = (sum(v[i] for v in counts.values()) for i in (0, 1))
    if not 0 < p < n:
        raise ValueError("the rows have not two classes")
    shares = {f: (p - (counts.get(f, (0, 0))[1] if f >= 0 else 0)) / max(n - (counts.get(f, (0, 0))[0] if f >= 0 else 0), 1e-12) for f in [*range(k), ALL]}
    drawn = draw(names, trials, seed)
    of = lambda name: [t for t in drawn if t.learner == name]
    d = rows.agg(F.max(F.size("x"))).first()[0]
    fits: dict[str, Any] = {}
    ranks = np.zeros((2, len(drawn), k, AUC_BINS))

    def ranked(kinds, frame, add, fit):
        own = [t for t in drawn if t.learner in kinds]
        ranks[:, [t.number for t in own]] = _summed(frame, len(own) * k * AUC_BINS, add, (fit, own, k)).reshape(2, len(own), k, AUC_BINS)

    if of("linear"):
        fits["linear"] = fit_linear(rows, of("linear"), d, k)
        ranked(["linear"], rows, _add_linear_ranks, fits["linear"])
    if of("forest") or of("boosted"):
        points = [i / BINS for i in range(1, BINS)]
        cuts = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.get("x", F.lit(j))), F.get("x", F.lit(j))), points, 10_000).alias(f"c{j}") for j in range(d)]).first()
        edges = [np.unique(c or []) for c in cuts]
        made = cells(rows, edges, k, max((t.params["trees"] for t in of("forest")), default=0))
        if of("forest"):
            fits["forest"] = fit_forests(made, of("forest"), edges, k, seed)
        if of("boosted"):
            fits["boosted"] = fit_boosted(made, of("boosted"), edges, k, shares)
        trees = {name: fit for name, fit in fits.items() if name != "linear"}
        ranked(list(trees), made.frame, _add_tree_ranks, trees)
        released(made.frame)
    found = Search(drawn, k, fits, features)
    for i, t in enumerate(drawn):
        both = [(pos, neg) for pos, neg in zip(*ranks[:, i]) if pos.sum() and neg.sum()]
        t.aucs = [float((pos * (neg.cumsum() - neg / 2)).sum() / (pos.sum() * neg.sum())) for pos, neg in both]
        t.slack = max((float((pos * neg).sum() / (2 * pos.sum() * neg.sum())) for pos, neg in both), default=0.0)
    released(rows)
    best = found.ranked()[:exact]
    if best:
        exact_aucs(found, df, best, label, fold)
    return found


def exact_aucs(found: Search, df: DataFrame, trials: Sequence[Trial], label: str, fold: str) -> None:
    """Tie-aware AUC of each trial and fold, from counts of distinct scores in range buckets; the mean over folds goes to the trial."""
    scored = found.scores(df.select(found.features, label, fold).where(F.col(label).isNotNull()), trials, fold)
    each = F.explode(F.array(*[F.struct(F.lit(t.number).alias("t"), F.col(f"s_{t.number}").alias("s")) for t in trials]))
    rows = scored.select(F.col(fold).alias("f"), F.col(label).alias("y"), each.alias("x")).where("x.s is not null")
    counts = written(rows.groupBy(F.struct(F.col("x.t").alias("t"), "f").alias("g"), F.col("x.s").alias("s")).agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("n")))
    below = cumulative(counts, "g", "s", ["n"])
    got = below.groupBy("g").agg(F.sum(F.col("p") * (F.col("cum_n") - F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n")).collect()  # one row a trial and fold
    released(counts)
    for t in trials:
        aucs = [r["u"] / (r["p"] * r["n"]) for r in got if r["g"]["t"] == t.number and r["p"] and r["n"]]
        t.exact = float(np.mean(aucs)) if aucs else None
