"""Exploratory statistics (E1-E18), each as aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..session import ship
from .quantiles import cumulative, quantiles


def shape(df: DataFrame) -> DataFrame:
    """E1."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles, maximum; one pass for all columns."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).alias(f"x{i}"))
    row = df.agg(*aggs)
    rows = row.select(F.explode(F.array(*[F.col(f"x{i}") for i in range(len(columns))])).alias("x")).select("x.*")
    q = quantiles(df, columns, (0.25, 0.5, 0.75)).select(F.col("column_name").alias("of"), "q")
    part = lambda k, name: F.get("q", F.lit(k)).alias(name)
    return rows.join(q, rows.column_name == q.of, "left").select("column_name", "count", "mean", "std", "min", part(0, "q25"), part(1, "q50"), part(2, "q75"), "max")


def null_counts(df: DataFrame) -> DataFrame:
    """E2."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("nulls")) for i, c in enumerate(df.columns)])).alias("x")).select("x.*")


def top_values(df: DataFrame, name: str, k: int = 20) -> DataFrame:
    """E3."""
    return df.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """A, b, n and n's share of its row; long form, so neither side needs to be small."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return n.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    """A column a value of b."""
    return df.groupBy(a).pivot(b, list(values)).count().fillna(0)


def chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """E5: statistic (Yates' correction when 2 x 2) and dof, over all cells, empty ones included."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    o = d.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    r, c = o.groupBy("a").agg(F.sum("o").alias("r")), o.groupBy("b").agg(F.sum("o").alias("c"))
    size = r.agg(F.count("*").alias("kr"), F.sum("r").alias("n")).crossJoin(c.agg(F.count("*").alias("kc")))  # one row
    # Cells without rows add their expected counts: what is missing of n.
    x = o.join(r, "a").join(c, "b").crossJoin(F.broadcast(size))
    e = F.col("r").cast("double") * F.col("c") / F.col("n")
    yates = F.when((F.col("kr") == 2) & (F.col("kc") == 2), 0.5).otherwise(0.0)
    gap = F.abs(F.col("o") - e)
    gap = gap - F.least(yates, gap)
    s = x.agg(F.sum(gap * gap / e).alias("s"), F.sum(e).alias("e"), F.max("n").alias("n"), F.max("kr").alias("kr"), F.max("kc").alias("kc"))
    return s.select((F.col("s") + F.col("n") - F.col("e")).alias("statistic"), ((F.col("kr") - 1) * (F.col("kc") - 1)).alias("dof"))


def chi2_test(df: DataFrame, a: str, b: str) -> dict:
    r = chi2(df, a, b).first()
    return {"statistic": r[0], "dof": r[1], "p_value": stats.chi2_p(r[0], r[1])}


def grouped_stats(df: DataFrame, by: str, x: str) -> DataFrame:
    """E6."""
    rows = df.groupBy(by).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    q = quantiles(df, [x], (0.5,), by).select(F.col(by).alias("__of"), F.get("q", F.lit(0)).alias("median"))
    return rows.join(q, rows[by].eqNullSafe(q["__of"]), "left").select(by, "count", "mean", "median", "std")


def welch_t(df: DataFrame, by: str, x: str, a, b, least: int = 10) -> DataFrame:
    """T and degrees of freedom; null when a group has fewer than ``least`` values."""
    pick = lambda v, f: f(F.when(F.col(by) == v, F.col(x)))
    r = df.agg(pick(a, F.count).alias("na"), pick(b, F.count).alias("nb"), pick(a, F.avg).alias("ma"), pick(b, F.avg).alias("mb"), pick(a, F.var_samp).alias("va"), pick(b, F.var_samp).alias("vb"))
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    ok = (F.col("na") >= least) & (F.col("nb") >= least)
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(ea + eb))
    dof = F.try_divide((ea + eb) * (ea + eb), ea * ea / (F.col("na") - 1) + eb * eb / (F.col("nb") - 1))
    return r.select("na", "nb", F.when(ok, t).alias("t"), F.when(ok, dof).alias("dof"))


def welch_test(df: DataFrame, by: str, x: str, a, b) -> dict:
    r = welch_t(df, by, x, a, b).first().asDict()
    return r | {"p_value": stats.t_two_sided(r["t"], r["dof"]) if r["t"] is not None else None}


def mann_whitney(df: DataFrame, by: str, x: str, a, b) -> DataFrame:
    """U of the first group and z with the tie correction; ranks come from running counts over distinct values, in two levels."""
    c = df.where(F.col(by).isin(a, b) & F.col(x).isNotNull()).groupBy(F.lit(0).alias("g"), F.col(x).alias("v")).agg(F.count_if(F.col(by) == a).alias("ca"), F.count("*").alias("c"))
    r = cumulative(c, "g", "v", ["c"])
    rank = F.col("cum_c") - (F.col("c") - 1) / 2
    n = F.col("c").cast("double")
    s = r.agg(F.sum(F.col("ca") * rank).alias("ra"), F.sum("ca").cast("double").alias("na"), F.sum("c").cast("double").alias("n"), F.sum(n * n * n - n).alias("ties"))
    na, nb = F.col("na"), F.col("n") - F.col("na")
    u = F.col("ra") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * ((F.col("n") + 1) - F.col("ties") / (F.col("n") * (F.col("n") - 1))))
    return s.select(u.alias("u"), F.try_divide(u - na * nb / 2, sd).alias("z"))


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """i < j and, over the rows in which both columns have a number: n and the sums of x, y, x x, y y, x y, each column less its mean.

    A task adds up masked Gram blocks, four matrix products a batch, and sends each cell once; Spark sums the cells.
    NaN counts as null.
    """
    ship(df.sparkSession)
    number = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns}
    means = [m or 0.0 for m in df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(number.values())]).first()]
    d = len(columns)
    upper = np.triu_indices(d, 1)
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def blocks(batches):
        total = np.zeros((6, len(upper[0])))
        for b in batches:
            for at in range(0, b.num_rows, 4_096):
                part = b.slice(at, 4_096)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns], 1).astype(float) - means
                seen = ~np.isnan(x)
                x, m = np.where(seen, x, 0.0), seen.astype(float)
                first, second = x.T @ m, (x * x).T @ m
                for k, g in enumerate((m.T @ m, first, first.T, second, second.T, x.T @ x)):
                    total[k] += g[upper]
        for at in range(0, len(upper[0]), 50_000):
            s = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(upper[0][s], pa.int32()), pa.array(upper[1][s], pa.int32()), *[pa.array(t[s]) for t in total]], ["i", "j", *names])

    cells = df.select(*[x.alias(f"c{i}") for i, x in enumerate(number.values())]).mapInArrow(blocks, "i int, j int, " + ", ".join(f"{n} double" for n in names))
    return cells.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A, b, Pearson's r over complete pairs (null without a spread), for any number of columns in one pass."""
    n = F.col("n")
    per_n = lambda x: F.try_divide(x, n)
    vx, vy = F.col("sxx") - per_n(F.col("sx") * F.col("sx")), F.col("syy") - per_n(F.col("sy") * F.col("sy"))
    r = F.try_divide(F.col("sxy") - per_n(F.col("sx") * F.col("sy")), F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0))))
    spread = (n > 0) & (vx > F.col("sxx") * 1e-14) & (vy > F.col("syy") * 1e-14) & (vx > 1e-300) & (vy > 1e-300)
    name = F.array(*map(F.lit, columns))
    out = pair_moments(df, columns).withColumn("r", F.when(spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))))
    return out.select(F.get(name, F.col("i")).alias("a"), F.get(name, F.col("j")).alias("b"), "r")


def histogram(df: DataFrame, x: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Counts of equal-width bins, the top edge in the last one; also by a label."""
    r = F.broadcast(df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi")))  # one row
    place = F.least(F.floor(F.coalesce(F.try_divide((F.col(x) - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    d = df.where(F.col(x).isNotNull()).crossJoin(r)
    return d.groupBy(*([by] if by else []), place.alias("bin")).agg(F.count("*").alias("n"))


def box_plot(df: DataFrame, by: str, x: str) -> DataFrame:
    """Quartiles, whiskers (the extreme values within 1.5 quartile distances) and the number of outliers of each group."""
    q = quantiles(df, [x], (0.25, 0.5, 0.75), by)
    q = q.select(by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    d = df.join(q, by)
    step = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(x).between(F.col("q1") - step, F.col("q3") + step)
    return d.groupBy(by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(x))).alias("low"), F.max(F.when(inside, F.col(x))).alias("high"), F.count_if(~inside).alias("outliers"))


def density(df: DataFrame, by: str, x: str, low: float, high: float, points: int = 50, cells: int = 512) -> DataFrame:
    """Gaussian density of each group on a grid, Scott's bandwidth; values are counted in ``cells`` cells of the range first, so the work after that is bounded."""
    d = df.where(F.col(x).isNotNull())
    width = (high - low) / cells
    s = d.groupBy(by).agg(F.count("*").alias("n"), F.stddev_samp(x).alias("sd"))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    c = d.groupBy(by, F.floor((F.col(x) - low) / width).alias("cell")).agg(F.count("*").alias("c"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    g = c.join(s, by).withColumn("h", h).select("*", grid.alias("point"))
    at = F.lit(low) + F.col("point") * ((high - low) / (points - 1))
    z = (at - (F.lit(low) + (F.col("cell") + 0.5) * width)) / F.col("h")
    return g.groupBy(by, "point").agg(F.sum(F.col("c") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def rate_pivot(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """Rows and rate of y by two binned columns."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("rate"))


def segment_rate(df: DataFrame, by: str, y: str) -> DataFrame:
    """E14."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("rate"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def seeded_sample(df: DataFrame, ident: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """N rows by a hash of id and seed, the same however the table is partitioned."""
    h = F.sha2(F.concat_ws(":", F.col(ident).cast("string"), F.lit(str(seed))).cast("binary"), 256)
    return df.orderBy(h, ident).limit(n)


def rates_by_category(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """Column, value, n, rate for many columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.col(y).cast("double").alias("y"), F.explode(pairs).alias("p")).groupBy("p.column_name", "p.value").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
