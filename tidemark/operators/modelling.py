"""Training, search, stacking, calibration and evaluation (M1-M20), on Spark ML.

Random choices hash the row's id with a seed, so results do not depend on partitioning. Curves over
scores work on counts of distinct scores with running totals in two levels, never on a global window
over rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship, written
from .quantiles import cumulative, least, order_levels, quantiles

# Cuts of class imbalance, search budgets, calibration and routing limits.
WEIGHT_CUT, SAMPLE_CUT = (0.25, 0.75), (0.30, 0.70)
SMALL, LARGE, TRIALS_SMALL, TRIALS_LARGE = 2_000, 10_000, 30, 150
CALIBRATION_LOSS, ISOTONIC_ROWS = 0.005, 1_000


def unit_hash(ident: str, seed: int) -> Column:
    """A number in [0, 1) from id and seed."""
    h = F.sha2(F.concat_ws(":", F.col(ident).cast("string"), F.lit(str(seed))).cast("binary"), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16**13)


def label_encode(df: DataFrame, target: str, out: str = "label") -> DataFrame:
    """M1: 1 for the second of the two sorted classes; null stays null."""
    named = F.col(target).cast("string")
    classes = sorted(r[0] for r in df.where(named.isNotNull()).select(named).distinct().limit(3).collect())
    if len(classes) != 2:
        raise ValueError(f"{target} has not two classes")
    return df.withColumn(out, (F.col(target).cast("string") == classes[1]).cast("int"))


def stratified_split(df: DataFrame, ident: str, label: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """M2: column ``is_test``; of each class the rows whose hash is below the exact quantile ``test`` of the class."""
    h = df.withColumn("__h", unit_hash(ident, seed))
    cut = quantiles(h, ["__h"], (test,), label).select(F.col(label).alias("__l"), F.col("q")[0].alias("__cut"))  # one row a class
    return h.join(F.broadcast(cut), F.col(label).eqNullSafe(F.col("__l"))).withColumn("is_test", F.col("__h") < F.col("__cut")).drop("__h", "__l", "__cut")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """M3: n / (2 n_class) when the positive rate is outside .25 to .75, else 1."""
    s = df.agg(F.count("*").alias("__n"), F.sum(F.col(label)).alias("__p"))  # one row
    rate = F.col("__p") / F.col("__n")
    w = F.when((rate < WEIGHT_CUT[0]) | (rate > WEIGHT_CUT[1]), F.col("__n") / (2 * F.when(F.col(label) == 1, F.col("__p")).otherwise(F.col("__n") - F.col("__p")))).otherwise(1.0)
    return df.crossJoin(F.broadcast(s)).withColumn(out, w).drop("__n", "__p")


def oversample(df: DataFrame, ident: str, label: str, seed: int = 42) -> DataFrame:
    """M4: minority rows repeated until they match the majority; which ones get one copy more is by hash. Nothing happens near balance or with one minority row."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("p")).first()
    n, p = r["n"], r["p"]
    minority, few = (1, p) if p * 2 <= n else (0, n - p)
    if not n or few < 2 or SAMPLE_CUT[0] <= p / n <= SAMPLE_CUT[1]:
        return df
    ratio = (n - few) / few
    whole, rest = int(ratio), ratio - int(ratio)
    copies = F.when(F.col(label) == minority, whole + (unit_hash(ident, seed) < rest).cast("int")).otherwise(1)
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).drop("__copy")


def _closest(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """__a, __b, d: of each row of ``a`` the k rows of ``b`` of least squared distance, then least id, without itself, and perhaps some more.

    One matrix product finds which distances may be among the k least; those are computed exactly.
    """
    b = b.sort_values("id", ignore_index=True)
    x, y, left, right = np.stack(a["x"]), np.stack(b["x"]), a["id"].to_numpy(), b["id"].to_numpy()
    middle = y.mean(0)
    u, v = x - middle, y - middle
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    rows, cols, exact = [], [], []
    for s in range(0, len(x), step := max(1, 4_000_000 // max(1, len(y)))):
        e = min(len(x), s + step)
        d = uu[s:e, None] - 2 * (u[s:e] @ v.T) + vv[None, :]
        d[left[s:e, None] == right[None, :]] = np.inf
        near = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(e - s, np.inf)
        slack = 1e-9 * (uu[s:e] + vv.max())
        at, of = np.nonzero((d <= (near + slack)[:, None]) & np.isfinite(d))
        true = ((x[s + at] - y[of]) ** 2).sum(1)
        order = np.lexsort((of, true, at))  # columns are in order of ids
        at, of, true = at[order], of[order], true[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < k
        rows.append(left[s + at[keep]]), cols.append(right[of[keep]]), exact.append(true[keep])
    return pd.DataFrame({"__a": np.concatenate(rows), "__b": np.concatenate(cols), "d": np.concatenate(exact)})


def nearest(rows: DataFrame, ident: str, x: str, k: int, block: int = 4_096, asked: list | None = None) -> DataFrame:
    """__a, __b, d, rn: the k nearest other rows of each row by squared distance of the arrays ``x`` (then by id), exactly.

    Rows belong to the cell of their nearest pivot, of which there are so many that a cell holds about a quarter of a
    block, up to 4,096. A row's k-th distance is bounded by its own cell and the pivots; it asks only the cells that
    the triangle inequality does not put farther away. Full cells are cut into blocks and so are the rows that ask one;
    a task compares a block with a block. ``asked`` gets the number of (row, block) comparisons and that of all.
    """
    ship(rows.sparkSession)
    spark, kind = rows.sparkSession, dict(rows.dtypes)[ident]
    told = rows.select(F.col(ident).alias("id"), F.col(x).cast("array<double>").alias("x"))
    n = told.count()
    if not n:
        return told.select(F.col("id").alias("__a"), F.col("id").alias("__b"), F.lit(0.0).alias("d"), F.lit(1).alias("rn"))
    few = min(4_096, -(-4 * n // block))
    drawn = told.orderBy(F.xxhash64("id"), "id").limit(few).collect()  # the pivots
    pivots = spark.sparkContext.broadcast((np.array([r["x"] for r in drawn], float), [r["id"] for r in drawn]))

    def distances(v: np.ndarray) -> np.ndarray:
        p = pivots.value[0]
        return np.sqrt(np.maximum((v * v).sum(1)[:, None] - 2 * (v @ p.T) + (p * p).sum(1)[None, :], 0))

    def placed(batches):
        for b in batches:
            if len(b):
                d = distances(np.stack(b["x"]))
                yield b.assign(cell=d.argmin(1).astype(np.int32), r=d.min(1))

    celled = written(told.mapInPandas(placed, f"id {kind}, x array<double>, cell int, r double"))
    cells = {r["cell"]: (r["n"], r["r"]) for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect()}  # one row a pivot
    parts = {c: -(-m // block) for c, (m, _) in cells.items()}
    many = lambda of, name, key: F.pmod(F.xxhash64("id", F.lit(key)), F.element_at(F.create_map(*[v for c, m in of.items() for v in (F.lit(c), F.lit(m))]), F.col(name))).cast("int")
    blocks = celled.withColumn("part", many(parts, "cell", 0))

    def bounded(g: pd.DataFrame) -> pd.DataFrame:
        """The row's k-th distance from its own block or the pivots, whichever is less."""
        v, ids = np.stack(g["x"]), g["id"].to_numpy()
        d = distances(v)
        d[ids[:, None] == np.array(pivots.value[1], dtype=ids.dtype)[None, :]] = np.inf
        bound = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(g), np.inf)
        own = _closest(g, g, k).groupby("__a")["d"].agg(["max", "size"])
        own = own[own["size"] >= k]["max"]
        return g.assign(u=np.minimum(bound, np.sqrt(g["id"].map(own).fillna(np.inf).to_numpy())))[["id", "x", "cell", "u"]]

    known = sorted(cells)
    radius = np.array([cells[c][1] for c in known])

    def asking(batches):
        p, _ = pivots.value
        gaps = np.sqrt(np.maximum(((p[:, None, :] - p[None, known, :]) ** 2).sum(2), 0)) if len(p) <= 512 else None
        for b in batches:
            for g in (b.iloc[i : i + 1_000] for i in range(0, len(b), 1_000)):
                v, u, cell = np.stack(g["x"]), g["u"].to_numpy()[:, None], g["cell"].to_numpy()
                d = distances(v)
                own, slack = d[np.arange(len(g)), cell][:, None], 1e-7 * (1 + d.max())
                d = d[:, known]
                may = d - radius[None, :] <= u + slack
                if gaps is not None:  # the other side of the plane between two pivots
                    apart = gaps[cell]
                    may &= (d * d - own * own) <= 2 * apart * (u + slack) + slack
                at, to = np.nonzero(may)
                yield pd.DataFrame({"id": g["id"].to_numpy()[at], "x": g["x"].to_numpy()[at], "to": np.array(known, np.int32)[to]})

    asks = blocks.groupBy("cell", "part").applyInPandas(bounded, f"id {kind}, x array<double>, cell int, u double").mapInPandas(asking, f"id {kind}, x array<double>, to int")
    asks = written(asks)
    per = {r["to"]: r["n"] for r in asks.groupBy("to").agg(F.count("*").alias("n")).collect()}  # one row a pivot
    if asked is not None:
        asked += [sum(m * parts[c] for c, m in per.items()), n * sum(parts.values())]
    lots = {c: -(-m // block) for c, m in per.items()}
    every = lambda of, name: F.explode(F.sequence(F.lit(0), F.element_at(F.create_map(*[v for c, m in of.items() for v in (F.lit(c), F.lit(m))]), F.col(name)) - 1))
    left = asks.withColumn("lot", many(lots, "to", 1)).withColumn("part", every(parts, "to")).withColumnRenamed("to", "cell")
    right = blocks.where(F.col("cell").isin(list(per))).withColumn("lot", every(lots, "cell")).select("id", "x", "cell", "part", "lot")
    compared = lambda a, b: _closest(a, b, k) if len(a) and len(b) else pd.DataFrame({"__a": [], "__b": [], "d": []})
    found = left.groupBy("cell", "part", "lot").cogroup(right.groupBy("cell", "part", "lot")).applyInPandas(compared, f"__a {kind}, __b {kind}, d double")
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("__a").orderBy("d", "__b"))).where(F.col("rn") <= k)


def smote(df: DataFrame, ident: str, numeric: Sequence[str], label: str, categorical: Sequence[str] = (), k: int = 5, seed: int = 42, block: int = 4_096) -> DataFrame:
    """M5: new minority rows between a minority row and one of its k nearest neighbours, found exactly; categories are the neighbours' mode."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("p")).first()
    n, p = int(r["n"]), int(r["p"])
    minority, few = (1, p) if p * 2 <= n else (0, n - p)
    k = min(k, few - 1)
    if n < 100 or k < 1 or SAMPLE_CUT[0] <= p / n <= SAMPLE_CUT[1]:
        return df
    own = df.where(F.col(label) == minority)
    s = own.agg(*[x for i, c in enumerate(numeric) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
    scaled = own.withColumn("__x", F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(s[f"m{i}"])) - s[f"m{i}"]) / (s[f"s{i}"] or 1.0) for i, c in enumerate(numeric)]))
    b = scaled.select(F.col(ident).alias("__b"), *[F.col(c).alias(f"__c_{c}") for c in categorical], *[F.col(c).cast("double").alias(f"__n_{c}") for c in numeric])
    near = nearest(scaled, ident, "__x", k, block).join(b, "__b")
    modes = near.groupBy("__a").agg(*[F.mode(f"__c_{c}", True).alias(f"__m_{c}") for c in categorical], F.count("*").alias("__k"))
    each = (n - 2 * few) / few
    whole, rest = int(each), each - int(each)
    base = own.withColumn("__copies", F.lit(whole) + (unit_hash(ident, seed) < rest).cast("int")).where("__copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    key = F.concat_ws("/", F.col(ident).cast("string"), F.col("__i").cast("string"))
    base = base.withColumn("__key", key).join(modes, base[ident] == modes["__a"]).drop("__a").withColumn("rn", (F.floor(unit_hash("__key", seed + 1) * F.col("__k")) + 1).cast("int"))
    made = base.join(near.select("__a", "rn", *[f"__n_{c}" for c in numeric]), (base[ident] == near["__a"]) & (base["rn"] == near["rn"])).withColumn("__u", unit_hash("__key", seed + 2))
    types = dict(df.dtypes)
    cols = []
    for c in df.columns:
        x = F.col(c)
        if c in numeric:
            x = (F.col(c).cast("double") + F.col("__u") * (F.col(f"__n_{c}") - F.col(c).cast("double"))).cast(types[c] if types[c] in ("double", "float") else "double")
        elif c in categorical:
            x = F.col(f"__m_{c}")
        cols.append(x.alias(c))
    return df.unionByName(made.select(*cols), allowMissingColumns=True)


def route_models(rows: int, profiles: Sequence[dict]) -> list[str]:
    """M6: which learners a table gets, by its size and columns."""
    text = any(p["role"] == "TEXT" for p in profiles)
    wide = any(p["role"] == "CATEGORICAL" and p["unique_count"] > 0.1 * rows for p in profiles)
    out = []
    if text or wide or rows < 1_000:
        out.append("linear")
    if not (text or wide) and rows >= 500:
        out.append("forest")
    if rows > 2_000:
        out.append("boosted")
    return out or ["linear"]


def learner(name: str, label: str = "label", weight: str | None = None, seed: int = 42):
    kw = {"labelCol": label, "featuresCol": "features"} | ({"weightCol": weight} if weight else {})
    if name == "linear":
        return LogisticRegression(maxIter=50, regParam=0.01, elasticNetParam=0.1, **kw)
    if name == "forest":
        return RandomForestClassifier(numTrees=40, maxDepth=6, seed=seed, **kw)
    return GBTClassifier(maxIter=20, maxDepth=4, seed=seed, **kw)


def slim(model):
    """The fitted model, or pipeline of models, without its training summaries.

    A summary holds the training data's session, which would be shipped to the executors with every
    transform, and can't be once the session observes metrics.
    """
    for m in getattr(model, "stages", [model]):
        if getattr(m, "hasSummary", False):
            m._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def trial_budget(rows: int, asked: int = 50) -> int:
    """M7: how many trials a search over so many rows gets."""
    if rows < SMALL:
        return min(asked, TRIALS_SMALL)
    return max(asked, TRIALS_LARGE) if rows > LARGE else asked


def folds(df: DataFrame, ident: str, label: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold numbers by hash; class shares agree but for chance."""
    return df.withColumn(out, F.floor(unit_hash(ident, seed) * k).cast("int"))


def out_of_fold(df: DataFrame, names: Sequence[str], ident: str, label: str = "label", fold: str = "fold", k: int = 5) -> DataFrame:
    """M8: each learner's score of every row from a fit without its fold: ident, label, s_<name>."""
    out = None
    for name in names:
        parts = None
        for f in range(k):
            m = slim(learner(name, label).fit(df.where(F.col(fold) != f)))
            p = m.transform(df.where(F.col(fold) == f)).select(F.col(ident), F.col(label), vector_to_array("probability")[1].alias(f"s_{name}"))
            parts = p if parts is None else parts.unionByName(p)
        out = parts if out is None else out.join(parts.drop(label), ident)
    return out


def stack(oof: DataFrame, names: Sequence[str], label: str = "label") -> tuple[object, float]:
    """M8: the best of two logistic regressions and a ridge on the out-of-fold scores, and its AUC."""
    v = VectorAssembler(inputCols=[f"s_{n}" for n in names], outputCol="features").transform(oof)
    best, best_auc = None, -1.0
    for est in (LogisticRegression(labelCol=label, regParam=0.001), LogisticRegression(labelCol=label, regParam=0.01), LinearRegression(labelCol=label, regParam=0.1)):
        m = slim(est.fit(v))
        scored = m.transform(v)
        s = scored.withColumn("score", vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction"))
        auc = roc_auc(s, "score", label).first()["auc"]
        if auc is not None and auc > best_auc:
            best, best_auc = m, auc
    return best, best_auc


def calibrate(valid: DataFrame, check: DataFrame, score: str, label: str = "label"):
    """M9: isotonic with enough rows, else a logistic curve; kept when AUC on rows it was not fitted on falls by no more than CALIBRATION_LOSS."""
    n = valid.count()
    if n >= ISOTONIC_ROWS:
        m = IsotonicRegression(labelCol=label, featuresCol=score, isotonic=True).fit(valid.withColumn(label, F.col(label).cast("double")))
        out = m.transform(check).withColumnRenamed("prediction", "calibrated")
    else:
        va = VectorAssembler(inputCols=[score], outputCol="__s")
        m = slim(LogisticRegression(labelCol=label, featuresCol="__s").fit(va.transform(valid)))
        out = m.transform(va.transform(check)).withColumn("calibrated", vector_to_array("probability")[1])
    before, after = (roc_auc(out, s, label).first()["auc"] for s in (score, "calibrated"))
    return m, bool(after is not None and before is not None and before - after <= CALIBRATION_LOSS), out


def _curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """neg score, p, c and their running sums from the highest score down."""
    c = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.lit(0).alias("g"), (-F.col(score)).alias("neg")).agg(F.sum(F.col(label)).cast("long").alias("p"), F.count("*").alias("c"))
    return cumulative(c, "g", "neg", ["p", "c"])


def best_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold of the highest F1, 2PR / (P + R + 1e-9), the lowest on a tie."""
    c = _curve(df, score, label)
    total = c.agg(F.sum("p").alias("all_p"))
    x = c.crossJoin(F.broadcast(total))  # one row
    prec, rec = F.col("cum_p") / F.col("cum_c"), F.coalesce(F.try_divide("cum_p", "all_p"), F.lit(0.0))
    f1 = F.lit(2.0) * prec * rec / (prec + rec + 1e-9)
    return x.select((-F.col("neg")).alias("threshold"), F.round(f1, 12).alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Tie-aware area under the curve, from counts of distinct scores."""
    c = _curve(df, score, label)
    # Negatives below a score, and half of those at it, for each positive.
    neg = F.col("c") - F.col("p")
    t = c.agg(F.sum("p").cast("double").alias("n1"), F.sum(neg).cast("double").alias("n0"))
    x = c.crossJoin(F.broadcast(t))  # one row
    below = F.col("n0") - (F.col("cum_c") - F.col("cum_p"))
    u = x.agg(F.sum(F.col("p") * (below + neg / 2)).alias("u"), F.max("n1").alias("n1"), F.max("n0").alias("n0"))
    return u.select(F.try_divide("u", F.col("n1") * F.col("n0")).alias("auc"))


def precision_at_k(df: DataFrame, score: str, label: str, ident: str, share: float = 0.1) -> DataFrame:
    """k = max(1, a tenth of the rows); the share of positives in the k highest scores."""
    k = max(1, int(df.count() * share))
    down = F.when(F.col(score).isNull(), float("inf")).otherwise(-F.col(score).cast("double"))
    return least(df, [F.when(F.isnan(down), float("-inf")).otherwise(down), *order_levels(df, ident)], k).agg(F.count("*").alias("k"), F.avg(F.col(label).cast("double")).alias("precision_at_k"))


def campaign_roi(p_at_k: DataFrame, value: Column | float, success: float = 0.3, contact_cost: float = 5.0) -> DataFrame:
    """Customers saved, benefit, cost and return of contacting the k highest scores."""
    v = F.lit(value) if isinstance(value, (int, float)) else value
    saved = F.col("precision_at_k") * F.col("k") * success
    benefit, cost = saved * v, F.col("k") * F.lit(contact_cost)
    return p_at_k.select("k", "precision_at_k", saved.alias("saved"), benefit.alias("benefit"), cost.alias("cost"), ((benefit - cost) / F.greatest(F.lit(1.0), cost)).alias("roi"))


def evaluate_logistic(df: DataFrame, pipeline: Pipeline, ident: str, label: str, test: float = 0.3) -> tuple[PipelineModel, DataFrame]:
    """Split, fit the feature pipeline and a logistic regression, score the test rows."""
    d = stratified_split(df, ident, label, test)
    m = slim(Pipeline(stages=[*pipeline.getStages(), LogisticRegression(labelCol=label, maxIter=50)]).fit(d.where(~F.col("is_test"))))
    return m, m.transform(d.where("is_test")).withColumn("score", vector_to_array("probability")[1])


def importances(model, names: Sequence[str], spark, top: int = 20) -> DataFrame:
    """The largest absolute coefficients, or tree importances."""
    v = model.coefficients.toArray() if hasattr(model, "coefficients") else model.featureImportances.toArray()
    rows = [(n, float(abs(x)), float(x)) for n, x in zip(names, v)]
    return spark.createDataFrame(rows, "feature string, importance double, value double").orderBy(F.desc("importance"), "feature").limit(top)


def vector_names(df: DataFrame, column: str = "features") -> list[str]:
    """Names of a vector column's slots."""
    attrs = df.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    return [a["name"] for a in sorted((a for k in attrs.values() for a in k), key=lambda a: a["idx"])]


def permutation_importance(model, df: DataFrame, columns: Sequence[str], ident: str, label: str, rows: int = 100, seed: int = 42) -> DataFrame:
    """The AUC lost when a column's values are dealt anew among a hash-ordered sample of rows."""
    d = df.orderBy(unit_hash(ident, seed), ident).limit(rows).persist()
    model = slim(model)
    auc = lambda x: roc_auc(model.transform(x).withColumn("__s", vector_to_array("probability")[1]), "__s", label).first()["auc"] or 0.0
    base, out = auc(d), []
    number = lambda x, how, name: x.withColumn(name, F.row_number().over(Window.orderBy(how)))  # noqa: E731  at most ``rows`` rows
    for c in columns:
        left = number(d.drop(c), F.col(ident), "__r")
        right = number(d.select(c, ident), unit_hash(ident, seed + 1), "__r").drop(ident)
        out.append((c, base - auc(left.join(right, "__r").drop("__r"))))
    return df.sparkSession.createDataFrame(out, "feature string, auc_drop double").orderBy(F.desc("auc_drop"), "feature")


def two_target(df: DataFrame, label: str, composite: str) -> tuple[object, object, DataFrame]:
    """A classifier and a regressor on one feature vector; 0.7 cross entropy + 0.3 squared error of both; probabilities from the first."""
    a, b = slim(LogisticRegression(labelCol=label, maxIter=50).fit(df)), slim(LinearRegression(labelCol=composite).fit(df))
    s = b.transform(a.transform(df).withColumnRenamed("prediction", "__pa").withColumn("p", vector_to_array("probability")[1]))
    p = F.least(F.greatest(F.col("p"), F.lit(1e-7)), F.lit(1 - 1e-7))
    bce = -(F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p))
    mse = F.pow(F.col("prediction") - F.col(composite), F.lit(2.0))
    return a, b, s.agg(F.avg(bce).alias("bce"), F.avg(mse).alias("mse"), (F.avg(bce) * 0.7 + F.avg(mse) * 0.3).alias("loss"))


def forgetting(runs: DataFrame) -> DataFrame:
    """Scenario, mean and population deviation over seeds of (before - after) / before."""
    rate = F.try_divide(F.col("before") - F.col("after"), F.col("before"))
    return runs.groupBy("scenario").agg(F.avg(rate).alias("mean_rate"), F.stddev_pop(rate).alias("std_rate"), F.count("*").alias("seeds"))


def save_model(model: PipelineModel, path: str, spark, threshold: float, features: Sequence[str], metrics: dict) -> DataFrame:
    """The fitted pipeline under ``path`` and its ledger row."""
    model.write().overwrite().save(path)
    row = spark.createDataFrame([(path, float(threshold), list(features), json.dumps(metrics))], "model_uri string, optimal_threshold double, feature_names array<string>, metrics string")
    row.write.mode("overwrite").json(path.rstrip("/") + "_ledger")
    return row


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
