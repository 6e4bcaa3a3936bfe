"""The search's trees read rows counted by cell: as many as there are cells, and the same sums as over rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import search as X

EDGES = [np.array([-0.5, 0.5]), np.array([1.0, 2.0, 3.0])]


def drawn(spark, n, weights=(1.0,), folds=3, copies=1):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(n, 2)) * [1, 2], 1) + [0, 2]
    x[::17, 1] = np.nan
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(float)
    w, fold = rng.choice(weights, n), rng.integers(-1, folds + 1, n) if folds > 3 else rng.integers(0, folds, n)
    rows = [(int(i + n * c), x[i].tolist(), float(y[i]), int(fold[i]), float(w[i])) for c in range(copies) for i in range(n)]
    d = spark.createDataFrame(rows, "id long, x array<double>, y double, fold int, w double")
    return d.select(F.xxhash64("id").alias("h"), "x", "y", "fold", "w"), (x, y, fold, w)


def test_passes_of_trees_read_cells_not_rows(spark, monkeypatch):
    """30 copies of the rows make the passes no longer."""
    read, summed = [], X._summed

    def counting(frame, size, add, shared):
        if add is X._add_level:
            read.append(frame.count())
        return summed(frame, size, add, shared)

    monkeypatch.setattr(X, "_summed", counting)
    forest = X.Trial(0, "forest", {"depth": 2, "trees": 3, "features": 1.0, "least": 2})
    boosted = X.Trial(1, "boosted", {"depth": 2, "rounds": 2, "rate": 0.3, "least": 1})
    d, _ = drawn(spark, 300, copies=30)
    X.fit_forests(d, [forest], EDGES, 3, 7)
    X.fit_boosted(d, [boosted], EDGES, 3, {f: 0.5 for f in (0, 1, 2, X.ALL)})
    assert read and max(read) <= 4 * 12 < d.count()


@pytest.mark.parametrize("entries", [2_000_000, 200])
def test_cells_count_every_row(spark, monkeypatch, entries):
    monkeypatch.setattr(X, "ENTRIES", entries)  # many parts of a cell, or one a task
    trees, k = 4, 4
    d, (x, y, fold, w) = drawn(spark, 400, (0.3, 1.0, 2.5), folds=k, copies=2)
    want = {}
    for r in d.collect():
        v = np.array([r["x"]])
        cell = (tuple(X.binned(v, EDGES)[0]), r["w"])
        at, c = want.setdefault(cell, (np.zeros((k + 1, 2)), np.zeros((k + 1, 2, trees)))), X._copies(np.array([r["h"]]), np.arange(trees))[0]
        f = r["fold"] if 0 <= r["fold"] < k else k
        for label, of in ((0, 1.0), (1, r["y"])):
            at[0][f, label] += of
            at[1][f, label] += of * c
    made = X.cells(d, EDGES, k, trees)
    got, seen = {}, Counter()
    for b in made.frame.toArrow().to_batches():
        bins, weight = X._key(b)
        n, c = X._unpacked(b.column("n"), 2 * (k + 1)), X._unpacked(b.column("c"), 2 * (k + 1) * trees)
        for i in range(len(bins)):
            at = got.setdefault((tuple(bins[i]), weight[i]), (np.zeros((k + 1, 2)), np.zeros((k + 1, 2, trees))))
            at[0][:] += n[i].reshape(k + 1, 2)
            at[1][:] += c[i].reshape(k + 1, 2, trees)
            seen[tuple(bins[i]), weight[i]] += 1
    assert set(got) == set(want) and max(seen.values()) == 1
    assert all(np.array_equal(g, v) for cell in want for g, v in zip(got[cell], want[cell]))


def test_packed_counts_and_large_ones():
    v = np.array([[0, 1, 255], [3, 256, 0], [7, 8, 9], [0.5, 2, 2]], float)
    assert np.array_equal(X._unpacked(X._packed(v), 3), v) and np.array_equal(X._unpacked(X._packed(v)[1:3], 3), v[1:3])
    assert np.array_equal(X._unpacked(X._packed(v[[0, 2]]), 3), v[[0, 2]]) and X._unpacked(X._packed(v[:, :0]), 0).shape == (4, 0)


def test_weighted_trees_equal_sums_over_rows(spark):
    """Root splits and leaves of both learners, by hand over single rows with fractional weights."""
    k = 4
    d, (x, y, fold, w) = drawn(spark, 500, (0.3, 1.7), folds=k)
    h = np.array([r["h"] for r in d.collect()])
    bins = X.binned(x, EDGES)
    forest = X.Trial(0, "forest", {"depth": 1, "trees": 2, "features": 1.0, "least": 1})
    boosted = X.Trial(1, "boosted", {"depth": 1, "rounds": 1, "rate": 0.3, "least": 1})
    shares = {f: 0.4 for f in (*range(k), X.ALL)}
    f, b = X.fit_forests(d, [forest], EDGES, k, 7), X.fit_boosted(d.repartition(5), [boosted], EDGES, k, shares)
    for out in (0, 3, X.ALL):
        keep = (fold != out) | (out == X.ALL)
        for t in range(2):
            hess = X._copies(h, np.arange(2))[:, t] * w * keep
            by_hand(f.trees, f.first[f.family[0], out] + t, bins, -y * hess, hess, 0.0)
        p = 0.4
        by_hand(b.rounds[0], b.model[b.family[1], out], bins, (p - y) * w * keep, p * (1 - p) * w * keep, X.SHRINK)


def by_hand(trees, at, bins, g, h, shrink):
    gain = lambda a: g[a].sum() ** 2 / (h[a].sum() + shrink)
    sides = {(j, c): bins[:, j] <= c for j in range(2) for c in range(len(EDGES[j]) + 1)}
    found = {s: gain(a) + gain(~a) for s, a in sides.items() if h[a].sum() >= 1 and h[~a].sum() >= 1}
    split = (int(trees.feature[at, 0]), int(trees.cut[at, 0]))
    assert np.isclose(found[split], max(found.values()), rtol=1e-6)
    a = sides[split]
    assert np.allclose(trees.value[at, :3], [-g.sum() / (h.sum() + shrink), -g[a].sum() / (h[a].sum() + shrink), -g[~a].sum() / (h[~a].sum() + shrink)], atol=1e-6)


@pytest.mark.parametrize("name", ["M7_search", "M8_stack"])
def test_customers_are_worked_out_once(spark, sf, monkeypatch, name):
    """What the search reads, pass by pass, is a written table, not the joins and aggregates over orders; it is deleted afterwards."""
    from pathlib import Path

    from tidemark.plans import queries_analysis as Q

    read, search = [], X.search

    def watched(df, *a, **k):
        read.append(df.inputFiles())
        return search(df, *a, **k)

    monkeypatch.setattr(Q.SE, "search", watched)
    monkeypatch.setattr(Q, "_LEARNERS", ("linear",))
    monkeypatch.setattr(Q.M, "trial_budget", lambda n: 3)
    assert getattr(Q, name)(spark, sf).count() == {"M7_search": 3, "M8_stack": 4}[name]
    assert read and not any("orders.parquet" in f for f in read[0])
    assert not any(Path(f.removeprefix("file:").replace("///", "/")).exists() for f in read[0])
