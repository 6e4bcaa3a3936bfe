"""Keyed tables: Parquet in hash buckets of the key, of which a write rewrites the touched ones only.

A table holds one row a key, so its size hangs on its keys and not on how often it was written. Writing the same rows
again changes nothing, so a retried task or batch does no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import released, written

BUCKET = "bucket"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def overwrite_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Replace the partitions that the rows fall in, and no others. Large partitions are dealt to several tasks."""
    df.hint("rebalance", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def upsert(rows: DataFrame, path: str, key: Sequence[str], buckets: int = 16) -> None:
    """Put the rows in the place of those with the same key (null is a key like any other); one row a key is expected."""
    spark = rows.sparkSession
    new = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    if exists(spark, path):
        new = written(new)
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets``
        old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
        keys = new.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
        same = F.lit(True)
        for k in key:
            same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
        both = written(old.join(keys, same, "left_anti").unionByName(new, allowMissingColumns=True))
        overwrite_partitions(both, path, BUCKET)
        released(new, both)
    else:
        overwrite_partitions(new, path, BUCKET)
    spark.catalog.refreshByPath(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)
