"""Composite target scores (K1-K6)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import modes

# Fixed values.
EXPLAINED, AUTO_ATTACH = 0.8, 2
SCORE = "cpi_score"


@dataclass
class Weight:
    column: str
    weight: float
    method: str = "minmax"  # minmax, zscore, binary_encode, raw


@dataclass
class Fitted:
    """A fitted score: (column, fill, shift, scale, weight) of each part, the sum's range, and what made it."""

    strategy: str
    parts: list[tuple[str, float, float, float, float]] = field(default_factory=list)
    codes: dict[str, list[str]] = field(default_factory=dict)
    low: float = 0.0
    high: float = 1.0
    flip: bool = False
    explained: float | None = None
    attach: bool = False

    def column(self) -> Column:
        """The score of a row as an expression: what K6 applies to new batches without fitting again."""
        if not self.parts:
            return F.lit(None).cast("double")
        total = F.lit(0.0)
        for name, fill, shift, scale, weight in self.parts:
            total = total + F.lit(weight) * ((F.coalesce(self._value(name), F.lit(fill)) - F.lit(shift)) / F.lit(scale or 1.0))
        span = self.high - self.low
        score = (total - F.lit(self.low)) / F.lit(span) if span > 0 else F.lit(0.0)
        score = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
        return F.lit(1.0) - score if self.flip else score

    def _value(self, name: str) -> Column:
        if name not in self.codes:
            return F.col(f"`{name}`").cast("double")
        out = F.lit(None).cast("double")
        for i, v in enumerate(self.codes[name]):
            out = F.when(F.col(f"`{name}`").cast("string") == v, float(i)).otherwise(out)
        return out


def _numeric(df: DataFrame, c: str) -> bool:
    return dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def pca_score(df: DataFrame, columns: Sequence[str], target: str) -> Fitted:
    """K1: mean-filled, min-maxed columns on their first principal component, min-maxed, pointing with the target."""
    a = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("l", F.min), ("h", F.max))]).first()
    stats = [(a[f"m{i}"] or 0.0, a[f"l{i}"] or 0.0, (a[f"h{i}"] or 0.0) - (a[f"l{i}"] or 0.0)) for i in range(len(columns))]
    if all(s[2] == 0 for s in stats):
        return Fitted("PCA", explained=0.0)
    scaled = df.select("*", *[((F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m)) - lo) / (span or 1.0)).alias(f"__x{i}") for i, (c, (m, lo, span)) in enumerate(zip(columns, stats))])
    vec = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(columns))], outputCol="__v").transform(scaled)
    model = PCA(k=1, inputCol="__v", outputCol="__p").fit(vec)
    w = [float(x) for x in model.pc.toArray()[:, 0]]
    total = sum((F.col(f"__x{i}") * w[i] for i in range(len(columns))), F.lit(0.0))
    r = scaled.select(total.alias("s"), F.col(f"`{target}`").cast("double").alias("y")).agg(F.min("s"), F.max("s"), F.corr("s", "y")).first()
    return Fitted("PCA", [(c, m, lo, span, wi) for c, (m, lo, span), wi in zip(columns, stats, w)], {}, r[0], r[1], bool(r[2] is not None and r[2] < 0), float(model.explainedVariance[0]))


def weighted_score(df: DataFrame, weights: Sequence[Weight]) -> Fitted:
    """K2: weighted sum of normalised columns over the sum of absolute weights, min-maxed. Missing columns are skipped; nulls take the mean, or the commonest category."""
    known = {"minmax", "zscore", "binary_encode", "raw"}
    if bad := [w.method for w in weights if w.method not in known]:
        raise ValueError(f"unknown method {bad[0]}")
    there = [w for w in weights if w.column in df.columns]
    total = sum(abs(w.weight) for w in there)
    if not there or not total:
        return Fitted("WEIGHTED")
    out = Fitted("WEIGHTED")
    for w in there:
        if not _numeric(df, w.column) or w.method == "binary_encode":
            counts = df.where(F.col(f"`{w.column}`").isNotNull()).groupBy(F.col(f"`{w.column}`").cast("string").alias("v")).count().orderBy("v").limit(1001).collect()
            if len(counts) > 1000:
                raise ValueError(f"{w.column} has more than 1000 categories")
            out.codes[w.column] = [r["v"] for r in counts]
    aggs = []
    for i, w in enumerate(there):
        x = out._value(w.column)
        aggs += [F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    a = df.agg(*aggs).first()
    commonest = {w.column: modes(df.select(out._value(w.column).alias("v")), ["v"]).get("v") for w in there if w.column in out.codes}
    for i, w in enumerate(there):
        lo, hi, mean, sd = (a[f"{k}{i}"] or 0.0 for k in "lhms")
        fill = (commonest[w.column] or 0.0) if w.column in out.codes else mean
        shift, scale = {"minmax": (lo, hi - lo), "binary_encode": (lo, hi - lo), "zscore": (mean, sd), "raw": (0.0, 1.0)}[w.method]
        out.parts.append((w.column, fill, shift, scale, w.weight / total))
    out.low, out.high = 0.0, 1.0
    s = sum((F.lit(wt) * ((F.coalesce(out._value(n), F.lit(f)) - F.lit(sh)) / F.lit(sc or 1.0)) for n, f, sh, sc, wt in out.parts), F.lit(0.0))
    r = df.agg(F.min(s), F.max(s)).first()
    out.low, out.high = (r[0] or 0.0), (r[1] or 0.0)
    return out


def auto_weights(associations: DataFrame, numeric: Sequence[str]) -> list[Weight]:
    """K3: a column's weight is its association with the target, its method by its type."""
    return [Weight(r["column_name"], float(r["association"]), "minmax" if r["column_name"] in numeric else "binary_encode") for r in associations.orderBy("column_name").collect()]


def synthesize(df: DataFrame, group: DataFrame, target: str) -> Fitted:
    """K4: NONE without auxiliary columns, PCA when two numbers explain enough, else WEIGHTED; attached unasked when small."""
    rows = group.where("group_role = 'AUXILIARY'").orderBy("column_name").collect()
    names = [r["column_name"] for r in rows if r["column_name"] in df.columns]
    if not names:
        return Fitted("NONE")
    numeric = [c for c in names if _numeric(df, c)]
    if len(numeric) >= 2:
        f = pca_score(df, numeric, target)
        if f.explained is not None and f.explained >= EXPLAINED:
            f.attach = len(names) <= AUTO_ATTACH
            return f
    f = weighted_score(df, auto_weights(group.where("group_role = 'AUXILIARY'"), numeric))
    f.attach = len(names) <= AUTO_ATTACH
    return f


def confirm(df: DataFrame, group: DataFrame, target: str, strategy: str | None = None, weights: Sequence[Weight] = ()) -> tuple[DataFrame, Fitted]:
    """K5: the user's choice, or the automatic one; the table with its score."""
    if strategy == "WEIGHTED" and weights:
        f = weighted_score(df, weights)
    elif strategy == "PCA":
        names = [r["column_name"] for r in group.where("group_role = 'AUXILIARY'").orderBy("column_name").collect() if _numeric(df, r["column_name"])]
        f = pca_score(df, names, target) if len(names) >= 2 else synthesize(df, group, target)
    else:
        f = synthesize(df, group, target)
    return (df.withColumn(SCORE, f.column()) if f.parts else df), f


def attach_if_expected(df: DataFrame, expected: Sequence[str], fitted: Fitted) -> DataFrame:
    """K6: the score from its fitted parameters, when a model expects it and the input lacks it."""
    return df.withColumn(SCORE, fitted.column()) if SCORE in expected and SCORE not in df.columns else df
