"""Structured Streaming forms of exposure logging, first exposure, micro-batch scoring and the drift loop."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import drift, incremental, scoring
from ..sources import io, keyed

EXPOSURE = "id long, customer_id string, ab_group string, event string, ts timestamp"


def read_exposures(spark: SparkSession, path: str) -> DataFrame:
    """A2: JSON lines as they arrive."""
    return spark.readStream.schema(EXPOSURE).json(path)


def log_exposures(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append, the time of arrival for a missing one."""
    out = stream.withColumn("ts", F.coalesce("ts", F.current_timestamp()))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_exposures(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A3: a keyed table of each customer's first exposure by time, then id, however late it arrives.

    The state holds one small row a customer and knows no horizon; each micro-batch puts the customers it saw in
    their rows' place, so a batch that is repeated changes nothing.
    """
    first = stream.groupBy("customer_id").agg(F.min(F.struct("ts", "id", "ab_group")).alias("x")).select("customer_id", "x.ab_group", F.col("x.ts").alias("first_ts"))
    put = lambda df, _: None if df.isEmpty() else keyed.upsert(df, path, ["customer_id"])
    return first.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_load(stream: DataFrame, path: str, checkpoint: str, key: str, order_col: str, partition_col: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """What has arrived since the last run, transformed and merged into the partitions whose rows change."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            incremental.merge_partitions(transform(df) if transform else df, path, key, order_col, partition_col)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream(stream: DataFrame, model, ident: str, threshold: float, path: str, checkpoint: str) -> StreamingQuery:
    """Records scored in micro-batches."""
    out = scoring.predict_batch(model, stream, ident, threshold)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drift_loop(
    landing: DataFrame,
    reference: DataFrame,
    numerical: Sequence[str],
    categorical: Sequence[str],
    history: str,
    requests: str,
    checkpoint: str,
    best_job: Callable[[], tuple] | None = None,
    dataset_id: str = "d",
    zone: str | None = None,
    as_of: str | None = None,
    days: int = 30,
) -> StreamingQuery:
    """Each micro-batch of the landing zone is held against the reference; rows go to the history, and a drift adds a retrain request.

    Both tables have a partition for each dataset and batch, which a repeated batch replaces. After a batch, date
    partitions of ``zone`` that are older than ``days`` before ``as_of`` (today) are dropped (S15).
    """

    def put(rows: DataFrame, batch_id: int, path: str) -> None:
        keyed.overwrite_partitions(rows.withColumn("batch_id", F.lit(batch_id).cast("long")), path, "dataset_id", "batch_id")

    def batch(df: DataFrame, batch_id: int) -> None:
        if df.isEmpty():
            return
        spark = df.sparkSession
        rows = drift.report(reference, df, numerical, categorical).persist()
        put(drift.history_rows(rows, dataset_id, "1970-01-01 00:00:00").withColumn("created_at", F.current_timestamp()), batch_id, history)
        if not rows.where("drifted").isEmpty():
            job = best_job() if best_job else (None, None)
            put(spark.createDataFrame([(dataset_id, *(None if j is None else str(j) for j in job))], "dataset_id string, prior_job string, target_column string"), batch_id, requests)
        rows.unpersist()
        if zone is not None:
            io.drop_expired(spark, zone, as_of, days)

    return landing.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
