"""The search that fits all trials in all folds together, against single fits."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import modelling as M
from tidemark.operators import search as X


def table(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 2, 3, 0] + [0, 1, 200, 7]
    m = 1.2 * x[:, 0] - 0.4 * x[:, 1] + 0.2 * (x[:, 2] - 200) ** 2 - 2
    y = (rng.random(n) < 1 / (1 + np.exp(-m))).astype(int)
    rows = [(i, v.tolist(), int(t), i % 5 % 2 + 1.0) for i, (v, t) in enumerate(zip(x, y))]
    return M.folds(spark.createDataFrame(rows, "id long, features array<double>, label int, w double"), "id", "label", 3)


@pytest.fixture(scope="module")
def rows(spark):
    return table(spark).persist()


def test_logistic_trials_equal_single_fits(rows):
    found = X.search(rows, "id", ["linear"], 4, k=3, weight="w")
    fit = found.fits["linear"]
    v = rows.withColumn("features", array_to_vector("features"))
    for t in found.trials:
        for f in (1, X.ALL):
            lr = LogisticRegression(regParam=t.params["penalty"], elasticNetParam=t.params["l1_share"], maxIter=300, tol=1e-11, weightCol="w").fit(v.where(F.col("fold") != f))
            got = fit.beta[t.number, f]
            slopes = got[1:] / fit.scale
            assert np.allclose(slopes, lr.coefficients.toArray(), atol=2e-4) and abs(got[0] - (slopes * fit.mean).sum() - lr.intercept) < 5e-3


def test_trials_share_what_larger_fits_contain(rows):
    """A trial's score is the same whether it is fitted alone or cut out of a larger fit."""
    d = rows.select(F.xxhash64("id").alias("h"), F.col("features").alias("x"), F.col("label").cast("double").alias("y"), F.col("fold").cast("int").alias("fold"), F.lit(1.0).alias("w"))
    edges = [np.unique(np.quantile([r[0][j] for r in rows.select("features").collect()], np.arange(1, 32) / 32)) for j in range(4)]
    x = np.array([r[0] for r in rows.select("features").collect()])
    y = np.array([r[0] for r in rows.select("label").collect()])
    small = X.Trial(0, "forest", {"depth": 2, "trees": 4, "features": 0.5, "least": 2})
    large = X.Trial(1, "forest", {"depth": 5, "trees": 9, "features": 0.5, "least": 2})
    both, alone = X.fit_forests(d, [small, large], edges, 3, 7), X.fit_forests(d.repartition(3), [small], edges, 3, 7)
    for f in (0, X.ALL):
        assert np.array_equal(both.score(x, small, f), alone.score(x, small, f))
    assert M_auc(both.score(x, large, X.ALL), y) > M_auc(both.score(x, small, X.ALL), y) > 0.7
    shares = {f: 0.5 for f in (0, 1, 2, X.ALL)}
    few = X.Trial(2, "boosted", {"depth": 2, "rounds": 3, "rate": 0.3, "least": 1})
    many = X.Trial(3, "boosted", {"depth": 2, "rounds": 8, "rate": 0.3, "least": 1})
    deep = X.Trial(4, "boosted", {"depth": 3, "rounds": 4, "rate": 0.3, "least": 1})
    both, alone = X.fit_boosted(d, [few, many, deep], edges, 3, shares), X.fit_boosted(d.repartition(3), [few], edges, 3, shares)
    for f in (2, X.ALL):
        assert np.array_equal(both.score(x, few, f), alone.score(x, few, f))
    assert M_auc(both.score(x, many, X.ALL), y) > M_auc(both.score(x, few, X.ALL), y) > 0.8
    # A first boosted split by hand: the cut of least squared loss around the base.
    tree, bins, p = alone.rounds[0], X.binned(x, edges), 0.5
    g, h = p - y, np.full(len(y), p * (1 - p))
    at = alone.model[alone.family[2], X.ALL]
    gain = lambda a: g[a].sum() ** 2 / (h[a].sum() + 1)
    best = max((gain(bins[:, j] <= c) + gain(bins[:, j] > c), -j, -c) for j in range(4) for c in range(31) if 1 <= h[bins[:, j] <= c].sum() <= h.sum() - 1)
    assert (tree.feature[at, 0], tree.cut[at, 0]) == (-best[1], -best[2])


def M_auc(score, y):
    a, b = score[y == 1][:, None], score[y == 0][None, :]
    return float(((a > b) + 0.5 * (a == b)).mean())


def test_search_over_three_learners(spark, rows):
    holes = spark.createDataFrame([(900, None, 1, 1.0, 0), (901, [float("nan"), 1.0, 2.0, 7.0], 0, 1.0, 1), (902, [1.0, 1.0, 2.0, 7.0], None, 1.0, 2)], "id long, features array<double>, label int, w double, fold int")
    d = rows.unionByName(holes)
    found = X.search(d, "id", ["linear", "forest", "boosted"], 6, k=3)
    best = found.ranked()[:3]
    oof = found.scores(d, best, "fold")
    got = oof.collect()
    assert len(got) == 403 and sum(r[f"s_{best[0].number}"] is None for r in got) == 1 and set(oof.columns) == {"id", "label", "w", "fold", *[f"s_{t.number}" for t in best]}
    known = [r for r in got if r["label"] is not None and r["id"] != 900]
    for t in best:
        by = [M_auc(np.array([r[f"s_{t.number}"] for r in known if r["fold"] == f]), np.array([r["label"] for r in known if r["fold"] == f])) for f in range(3)]
        assert np.isclose(np.mean(by), t.exact) and abs(np.mean(t.aucs) - t.exact) <= t.slack + 1e-9
    assert best[0].learner != "linear" and best[0].auc > 0.75
    assert {r["learner"] for r in found.table(spark).collect()} == {"linear", "forest", "boosted"}
    whole = found.scores(d.drop("fold"), best[:1]).where("id = 0").first()
    assert 0 < whole[f"s_{best[0].number}"] < 1
    with pytest.raises(ValueError):
        X.search(d.where("label = 1"), "id", ["linear"], 1, k=3)
    with pytest.raises(ValueError):
        X.draw(["other"], 1)
