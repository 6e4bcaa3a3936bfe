"""Watermarks, incremental loads, change records and the pipeline over them."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import released, written
from ..sources import keyed
from . import cleaning, lineage, quality

EPOCH = "2000-01-01"


def set_watermark(spark: SparkSession, path: str, table: str, ts) -> None:
    """The table's new watermark, in a table of one row a table; an unreadable one is left out."""
    row = spark.createDataFrame([(table, str(ts))], "table_name string, ts string").select("table_name", F.try_to_timestamp("ts").alias("ts"), F.current_timestamp().alias("set_at"))
    keyed.upsert(row.where("ts is not null"), path, ["table_name"])


def get_watermark(history: DataFrame | None, table: str):
    """The watermark set last, or None; unreadable ones don't count."""
    if history is None:
        return None
    r = history.where((F.col("table_name") == table) & F.col("ts").isNotNull()).agg(F.max_by("ts", "set_at")).first()
    return r[0]


def lookback(df: DataFrame, watermark=None, partition_col: str = "load_date", days: int = 7) -> DataFrame:
    """Rows of the last days before the watermark on; without one from the epoch; without the column all.

    A date or timestamp column is compared as it is stored, so the filter reaches the scan.
    """
    if partition_col not in df.columns:
        return df
    kind = dict(df.dtypes)[partition_col]
    since = F.date_sub(F.lit(str(watermark)).cast("date"), days) if watermark is not None else F.lit(EPOCH).cast("date")
    c = F.col(partition_col)
    return df.where((c if kind.startswith(("date", "timestamp")) else F.try_to_timestamp(c.cast("string"))) >= since)


def merge_latest(old: DataFrame, new: DataFrame, key: str, order_col: str) -> DataFrame:
    """Of each key the row with the latest date; a null date counts as latest, new rows win ties."""
    both = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, order_col, "__src")]
    w = Window.partitionBy(key).orderBy(F.col(order_col).desc_nulls_first(), F.desc("__src"), *[F.col(c).asc_nulls_last() for c in rest])
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__src")


def merge_partitions(new: DataFrame, path: str, key: str, order_col: str, partition_col: str) -> DataFrame:
    """``merge_latest`` into a table of Parquet partitions, rewriting no partition but those whose rows change.

    Touched are the partitions of the new rows and those that hold one of their keys (the keys' rows may move): only
    they are read whole, and of them only those written that come out different. A partition that loses all its rows is
    deleted. Merging the same rows again changes nothing, so a load that failed half-way is run again. Returns
    partition, rows_before, rows_after, action (written, unchanged, deleted) of the touched partitions.
    """
    spark = new.sparkSession
    new = written(new)
    kind = dict(new.dtypes)[partition_col]
    there = keyed.exists(spark, path)
    p = F.col(partition_col)
    old = spark.read.parquet(path).withColumn(partition_col, p.cast(kind)) if there else new.limit(0)
    keys = new.select(F.col(key).alias("__k")).distinct()
    holding = old.select(key, partition_col).join(keys, F.col(key).eqNullSafe(F.col("__k")), "left_semi").select(partition_col)
    touched = written(holding.union(new.select(partition_col)).distinct())  # one row a partition
    values = [r[0] for r in touched.collect()]
    within = p.isin([v for v in values if v is not None])
    part = old.where((within | p.isNull()) if None in values else within)
    whole = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != partition_col]
    # Only keys of the new rows are merged; all others stay as they are, repeated ones too.
    stays = part.join(keys, F.col(key).eqNullSafe(F.col("__k")), "left_anti")
    merged = merge_latest(part.join(keys, F.col(key).eqNullSafe(F.col("__k")), "left_semi"), new, key, order_col)
    out = written(stays.unionByName(merged, allowMissingColumns=True))

    def told(df: DataFrame, name: str) -> DataFrame:
        """Rows and an order-free checksum by partition."""
        has = [F.col(c) if c in df.columns else F.lit(None) for c in whole]
        return df.groupBy(p.alias(name)).agg(F.count("*").alias(f"{name}_n"), F.sum(F.xxhash64(F.struct(*has).cast("string")).cast("decimal(38,0)")).alias(f"{name}_sum"))

    a, b = told(part, "was"), told(out, "now")
    both = touched.join(a, p.eqNullSafe(F.col("was")), "left").join(b, p.eqNullSafe(F.col("now")), "left")
    same = F.col("was_sum").eqNullSafe(F.col("now_sum")) & F.col("was_n").eqNullSafe(F.col("now_n"))
    action = F.when(same, "unchanged").when(F.col("now_n").isNull(), "deleted").otherwise("written")
    rows = both.select(p.alias("partition"), F.coalesce("was_n", F.lit(0)).alias("rows_before"), F.coalesce("now_n", F.lit(0)).alias("rows_after"), action.alias("action"))
    result = spark.createDataFrame(rows.collect(), rows.schema)  # one row a partition
    changed = {r["partition"] for r in result.where("action = 'written'").collect()}
    gone = [r["partition"] for r in result.where("action = 'deleted'").collect()]
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    empty = [r[0] for r in spark.read.parquet(path).where(p.cast(kind).isin(gone) if None not in gone else p.isNull() | p.cast(kind).isin([g for g in gone if g is not None])).select(folder).distinct().collect()] if gone else []
    if changed:
        some = p.isin([c for c in changed if c is not None])
        keyed.overwrite_partitions(out.where((some | p.isNull()) if None in changed else some), path, partition_col)
    for f in empty:
        keyed.delete(spark, f)
    spark.catalog.refreshByPath(path)
    released(new, touched, out)
    return result


def changed_records(before: DataFrame, after: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """I4: every row of ``after`` as NEW or UPDATED by whether its key was there. ``strict`` compares values and adds DELETED."""
    old = before.select(F.col(key).alias("__key")).distinct()
    out = after.join(old, F.col(key) == F.col("__key"), "left").withColumn("change_type", F.when(F.col("__key").isNull(), "NEW").otherwise("UPDATED")).drop("__key")
    if not strict:
        return out
    same = before.select(*after.columns).distinct()
    unlike = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in after.columns]
    cond = unlike[0]
    for u in unlike[1:]:
        cond = cond & u
    out = out.alias("a").join(same.alias("b"), cond, "left_anti")
    gone = before.join(after.select(F.col(key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left_anti").select(*after.columns).withColumn("change_type", F.lit("DELETED"))
    return out.select(*after.columns, "change_type").unionByName(gone)


def change_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """I5."""
    a, b = before.agg(F.count("*").alias("rows_before")), after.agg(F.count("*").alias("rows_after"))
    return a.crossJoin(b).select("rows_before", "rows_after", (F.col("rows_after") - F.col("rows_before")).alias("row_change"), F.lit(len(after.columns) - len(before.columns)).cast("long").alias("column_change"))


def run_pipeline(
    spark: SparkSession,
    source: DataFrame,
    out: str | None,
    key: str = "CustomerID",
    mode: str = "full",
    partition_col: str = "load_date",
    sla: dict | None = None,
    existing: DataFrame | None = None,
    watermark=None,
    dry_run: bool = False,
) -> dict[str, DataFrame]:
    """Load, raw metrics and service levels, transform with lineage, metrics, write, new watermark.

    Row counts of the steps are counts of their outputs, of which Spark reads only the columns that
    decide on rows, all in one job. An incremental run into ``out`` rewrites only the partitions whose rows change. Returns the result, the metrics of both ends, the lineage edges and
    the step summary.
    """
    if mode not in ("full", "incremental"):
        raise ValueError(f"unknown mode {mode}")
    began = time.time()
    raw = lookback(source, watermark, partition_col) if mode == "incremental" else source
    raw_metrics = quality.collect_metrics(raw, "raw", key if key in raw.columns else None)
    if sla:
        quality.validate_sla(raw_metrics, sla)
    steps = [("convert_types", cleaning.convert_types), ("drop_invalid_rows", cleaning.drop_invalid_rows), ("map_booleans", cleaning.map_booleans), ("create_features", cleaning.create_features)]
    df, outputs = raw, [raw]
    for _, step in steps:
        df = step(df)
        outputs.append(df)
    schemas = [dict(x.dtypes) for x in outputs]
    counted = [x.agg(F.lit(i).alias("step"), F.count("*").alias("n")) for i, x in enumerate(outputs)]
    counts = [r["n"] for r in sorted(reduce(DataFrame.union, counted).collect())]  # one row a step
    merging = mode == "incremental" and key in df.columns and partition_col in df.columns
    if merging and existing is not None:
        df = merge_latest(existing, df, key, partition_col)
    elif merging and out is not None and not dry_run:
        merge_partitions(df, out, key, partition_col, partition_col)
        df = spark.read.parquet(out)
    if merging and existing is None and out is not None and not dry_run:
        pass  # already in place
    elif dry_run or out is None:
        df = df.persist()
        df.write.format("noop").mode("overwrite").save()
    else:
        df.write.mode("overwrite").parquet(out)
        df = spark.read.parquet(out)
    names = ["raw", *[n for n, _ in steps[:-1]], "processed"]
    edges = None
    for i, (name, _) in enumerate(steps):
        edge = lineage.edge(spark, names[i], names[i + 1], name, schemas[i], schemas[i + 1], counts[i], counts[i + 1], i)
        edges = edge if edges is None else edges.union(edge)
    done = quality.collect_metrics(df, "processed", key if key in df.columns else None, time.time() - began)
    summary = quality.step_summary([(n, counts[i], counts[i + 1]) for i, (n, _) in enumerate(steps)], spark)
    return {"result": df, "raw_metrics": raw_metrics, "metrics": done, "lineage": edges, "summary": summary}


def partition_columns(df: DataFrame, names: Sequence[str] = ("year", "month", "day")) -> list[str]:
    return [n for n in names if n in df.columns]
