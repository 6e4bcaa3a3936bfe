"""Mixing sources to target weights along a time-varying curriculum. DataFrame expressions only.

Every source gets a share of the token budget by its weight (water-filling: no source above
``max_epochs`` times its size, the excess reshared by weight). A source's demand over training time
p in [0, 1] is its share times the integral of a linear weight schedule, ``1 + ramp * (2p - 1)``.
Its documents stand in one fixed random order; a copy whose tokens lie around cumulative token x is
due at the time when the source's demand reaches x, the inverse of that integral. Copies beyond the
share are not taken. The training order is a range sort by that time.

Running totals use two levels (buckets of about ROWS_PER_BUCKET documents, then totals of buckets),
so a source with most of the rows is dealt over as many tasks as any other. Sources themselves, one row each,
pass through one task, which is meant for up to some hundred thousand of them.

Defined results: null text has size 0; null source is a source of its own, last; sources of size 0
get target 0; rows that repeat a doc_id, or have none, are documents of their own, ordered by a hash of id and
text, so only rows alike in both share a bucket; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WEIGHTS = (3.0, 1.0, 2.0)
RAMPS = (-0.5, 0.0, 0.5)
BUDGET, MAX_EPOCHS = 1.5, 2.0
ROWS_PER_BUCKET = 10_000
SEED = 11


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row a source: source, source_size, n_docs, weight, ramp, target. ``sizes`` has source, size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # One row a source is what these windows see.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), (F.pmod(rank, F.lit(len(xs))) + 1).cast("int"))
    per = per.select("*", pick(weights).alias("weight"), pick(ramps).alias("ramp"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    per = per.withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    level = F.max(F.when(F.col("level") < F.col("full_at"), F.col("level"))).over(every)
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", "n_docs", "weight", "ramp", target.alias("target"))


def assign(docs: DataFrame, carry: bool = False, **plan) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken, positions.

    ``carry`` keeps the whole input row as the struct ``row``.
    """
    scratch = Scratch(docs.sparkSession)
    order = F.xxhash64(F.lit(SEED), "doc_id", "text")  # with the text, so that rows of one id, or without one, are dealt over buckets too
    sized = docs.select(*([F.struct("*").alias("row")] if carry else []), "doc_id", "source", n_words("text").alias("size"), order.alias("ord"))
    small = scratch.put(sized.select("doc_id", "source", "size", "ord"), "sizes")
    targets = scratch.put(source_targets(small, **plan).withColumn("buckets", F.ceil(F.col("n_docs") / ROWS_PER_BUCKET).cast("long")), "targets")

    def bucketed(df: DataFrame) -> DataFrame:
        t = targets.withColumnRenamed("source", "of")
        b = F.shiftright(F.shiftrightunsigned("ord", 33) * F.col("buckets"), 31)
        return df.join(t, df.source.eqNullSafe(t.of)).drop("of").withColumn("bucket", b)

    sums = bucketed(small).groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    prior = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("sum").over(prior), F.lit(0)).alias("prior"))
    rows = bucketed(sized if carry else small)
    rows = rows.join(sums, rows.source.eqNullSafe(sums.of) & (rows.bucket == sums.at)).drop("of", "at")
    inside = Window.partitionBy("source", "bucket").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("prior") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / F.lit(2.0)
    size, target = F.col("source_size").cast("double"), F.col("target")
    whole = F.floor(F.coalesce(F.try_divide(target, size), F.lit(0.0)) + F.lit(1e-12))
    rows = rows.withColumn("middle", middle)
    more = F.when((F.col("size") > 0) & (F.col("middle") < target - whole * size), 1).otherwise(0)
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, whole + more).otherwise(F.when(target > 0, 1).otherwise(0)).cast("int"))
    due = lambda c: _due(F.least(F.try_divide(F.col("middle") + c * size, target), F.lit(1.0)), F.col("ramp"))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), due)).otherwise(F.array().cast("array<double>"))
    return rows.select(*(["row"] if carry else []), "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), positions.alias("positions"))


def _due(y: Column, ramp: Column) -> Column:
    """The time p at which (1 - ramp) p + ramp p^2 = y."""
    a = F.lit(1.0) - ramp
    return F.coalesce(F.lit(2.0) * y / (a + F.sqrt(a * a + F.lit(4.0) * ramp * y)), F.lit(0.0))


def training_order(docs: DataFrame, **plan) -> DataFrame:
    """The input's rows, each as often as it is taken, in the order of training."""
    copies = assign(docs, carry=True, **plan).select("row", "doc_id", F.posexplode("positions").alias("copy", "position"))
    return copies.orderBy("position", "doc_id", "copy").select("row.*")
