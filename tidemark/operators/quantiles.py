"""Running counts, exact quantiles and selections over range buckets, so that no task holds a column's distinct values."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def bucketed(counts: DataFrame, value: str, out: str) -> DataFrame:
    """Number of the range bucket that a value falls in. The bounds are fixed numbers, taken once from approximate
    quantiles, so a value falls in the same bucket however often a task is run again; they only balance the work."""
    n = 2 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = [k / n for k in range(1, n)]
    bounds = counts.agg(F.percentile_approx(F.col(value).cast("double"), points, 20 * n)).first()[0] or []
    bounds = sorted({b for b in bounds if b == b and abs(b) < float("inf")})
    with_value = counts.withColumn("__v", F.col(value).cast("double"))
    splits = [-float("inf"), *bounds, float("inf")]
    if len(splits) < 3:
        return with_value.withColumn(out, F.lit(0.0)).drop("__v")
    return Bucketizer(splits=splits, inputCol="__v", outputCol=out, handleInvalid="keep").transform(with_value).drop("__v")


def cumulative(counts: DataFrame, by: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Running sums of count columns by ascending value inside each group, in two levels: totals of range buckets,
    then inside each bucket. One row a (by, value). The counts are written first: bounds, totals and sums read them."""
    parts = bucketed(written(counts), value, "__p")
    totals = parts.groupBy(F.col(by).alias("__by"), F.col("__p").alias("__at")).agg(*[F.sum(c).alias(f"__t_{c}") for c in columns])
    w = Window.partitionBy("__by").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__by", "__at", *[F.coalesce(F.sum(f"__t_{c}").over(w), F.lit(0)).alias(f"__b_{c}") for c in columns])
    inside = Window.partitionBy(by, "__p").orderBy(value)
    out = parts.join(before, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__p") == F.col("__at")))
    return out.withColumns({f"cum_{c}": F.col(f"__b_{c}") + F.sum(c).over(inside) for c in columns}).drop("__p", "__by", "__at", *[f"__b_{c}" for c in columns])


def quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float], by: str | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation) of number columns: [by,] column_name, q (an array, one for each point), n, distinct.

    Nulls and NaN don't count; a group or column without values has no row.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    group = F.struct(*([F.col(by).alias("by")] if by else []), F.col("x.column_name").alias("column_name"))
    rows = df.select(*([by] if by else []), F.explode(pairs).alias("x")).where("x.v is not null and not isnan(x.v)")
    c = rows.groupBy(group.alias("g"), F.col("x.v").alias("v")).agg(F.count("*").alias("c"))
    total = c.groupBy(F.col("g").alias("of")).agg(F.sum("c").alias("n"), F.count("*").alias("distinct"))
    r = cumulative(c, "g", "v", ["c"]).join(total, F.col("g").eqNullSafe(F.col("of"))).drop("of")
    place = lambda p, up: (F.ceil if up else F.floor)((F.col("n") - 1) * F.lit(float(p)))
    at = lambda i: F.max(F.when((F.col("cum_c") - F.col("c") <= i) & (i < F.col("cum_c")), F.col("v")))
    ends = r.groupBy("g").agg(F.max("n").alias("n"), F.max("distinct").alias("distinct"), *[at(place(p, up)).alias(f"{'hi' if up else 'lo'}{k}") for k, p in enumerate(points) for up in (False, True)])

    def between(k: int, p: float):
        r = (F.col("n") - 1) * F.lit(float(p))
        return F.when(F.floor(r) == F.ceil(r), F.col(f"lo{k}")).otherwise((F.ceil(r) - r) * F.col(f"lo{k}") + (r - F.floor(r)) * F.col(f"hi{k}"))

    return ends.select(*([F.col("g.by").alias(by)] if by else []), "g.column_name", F.array(*[between(k, p) for k, p in enumerate(points)]).alias("q"), "n", "distinct")


def quantile_lists(df: DataFrame, columns: Sequence[str], points: Sequence[float]) -> dict[str, list[float]]:
    """The same as numbers, by column: one row a column. Columns without values are left out."""
    return {r["column_name"]: list(r["q"]) for r in quantiles(df, columns, points).collect()}


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {c: q[0] for c, q in quantile_lists(df, columns, (0.5,)).items()}


def least(df: DataFrame, levels: Iterable[Column], quota: DataFrame | int, by: str | None = None) -> DataFrame:
    """Exactly the ``quota`` least rows (of each class ``by``) in the order of the levels, which are numbers without null or NaN.

    Level by level the class's k-th value is found from counts, all rows below it are taken, and those at it go to the
    next level, until no class has more of them than it still needs. Rows that are alike in all levels are told
    apart by a hash of their columns; of rows alike in every column as many are made as are needed. So nothing is
    sorted as a whole and no class is gathered. ``quota``: a number, or (class, quota) rows; classes without one give nothing.
    """
    spark, columns = df.sparkSession, df.columns
    group = F.struct(F.col(f"`{by}`").alias("t")) if by else F.struct(F.lit(0).alias("t"))
    wanted = quota if isinstance(quota, DataFrame) else spark.createDataFrame([(0, int(quota))], "t int, q long")
    wanted = wanted.toDF("t", "q").select(F.struct("t").alias("__of"), F.col("q").cast("long").alias("__left")).where("__left > 0")
    open_ = df.withColumn("__g", group)
    open_ = open_.join(wanted, F.col("__g").eqNullSafe(F.col("__of"))).drop("__of")
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, k in df.dtypes if "map<" not in k])
    taken = []
    for level in [*levels, F.shiftright(whole, 32), whole.bitwiseAND(F.lit(0xFFFFFFFF))]:
        open_ = open_.withColumn("__w", level.cast("double"))
        counts = open_.groupBy("__g", "__w").agg(F.count("*").alias("__c"), F.first("__left").alias("__left"))
        at = cumulative(counts, "__g", "__w", ["__c"]).where("cum___c >= __left")
        at = at.groupBy("__g").agg(F.min(F.struct("__w", "__c", (F.col("__left") - F.col("cum___c") + F.col("__c")).alias("__need"))).alias("x"))
        at = written(at.select(F.col("__g").alias("__of"), F.col("x.__w").alias("__cut"), "x.__c", "x.__need"))
        split = open_.join(at, F.col("__g").eqNullSafe(F.col("__of")), "left")
        taken.append(split.where("__cut is null or __w < __cut"))
        rest = split.where("__w = __cut")
        if at.where("__c > __need").isEmpty():
            taken.append(rest)
            break
        taken.append(rest.where("__c = __need"))
        open_ = rest.where("__c > __need").withColumn("__left", F.col("__need")).drop("__of", "__cut", "__c", "__need")
    else:
        alike = open_.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count("*").alias("__c"), F.first("__left").alias("__left"))
        taken.append(alike.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.least("__c", "__left")))))
    out = taken[0].select(*[F.col(f"`{c}`") for c in columns])
    for t in taken[1:]:
        out = out.union(t.select(*[F.col(f"`{c}`") for c in columns]))
    return out


def order_levels(df: DataFrame, name: str) -> Iterator[Column]:
    """The ascending order of a column (nulls first) as numbers that doubles hold exactly, level by level."""
    c, kind = F.col(f"`{name}`"), dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        n = c.cast("long")
        yield F.coalesce(F.shiftright(n, 32).cast("double"), F.lit(float("-inf")))
        yield F.coalesce(n.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"), F.lit(0.0))
        return
    if kind in ("float", "double"):
        yield F.when(c.isNull(), float("-inf")).when(F.isnan(c), float("inf")).otherwise(c.cast("double"))
        return
    b = c.cast("string").cast("binary")
    longest = df.agg(F.max(F.length(b))).first()[0] or 0
    for i in range(0, longest, 6):
        digits = F.rpad(F.hex(F.substring(b, i + 1, 6)), 12, "0")
        yield F.coalesce(F.conv(digits, 16, 10).cast("double"), F.lit(-1.0))


def hex_levels(c: Column) -> list[Column]:
    """The order of a text of 52 hex digits at least, as numbers that doubles hold exactly."""
    return [F.conv(F.substring(c, i, 13), 16, 10).cast("double") for i in (1, 14, 27, 40)]
