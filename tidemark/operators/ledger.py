"""Queries over the ledger of training jobs (L1-L10). A ledger: job_id, dataset_id, status, roc_auc, started_at, finished_at, is_active, ..."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import cumulative, medians


def metrics(jobs: DataFrame, now: str) -> DataFrame:
    """L1: jobs by status; of the finished ones those of the last day."""
    t = F.lit(now).cast("timestamp")
    s, recent = F.col("status"), F.col("finished_at") >= F.timestamp_add("HOUR", F.lit(-24), t)
    return jobs.agg(
        F.count_if(s == "queued").alias("queued"),
        F.count_if(s == "training").alias("running"),
        F.count_if((s == "completed") & recent).alias("completed_24h"),
        F.count_if((s == "failed") & recent).alias("failed_24h"),
        F.count("*").alias("total"),
    )


def summary(jobs: DataFrame, now: str, days: int = 7) -> DataFrame:
    """L2: jobs started in the last days: total, by status, and the best one."""
    t = F.lit(now).cast("timestamp")
    j = jobs.where(F.col("started_at") >= F.timestamp_add("DAY", F.lit(-days), t))
    # The best by score, then the smaller id.
    best = F.max(F.when(F.col("roc_auc").isNotNull(), F.struct("roc_auc", (-F.col("job_id")).alias("neg"))))
    r = j.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "training").alias("training"), F.count_if(F.col("status") == "queued").alias("queued"), best.alias("b"))
    return r.select("total", "completed", "training", "queued", (-F.col("b.neg")).alias("best_job_id"), F.col("b.roc_auc").alias("best_auc"))


def models(jobs: DataFrame, dataset_id) -> DataFrame:
    """L3: a dataset's completed jobs, newest first."""
    return jobs.where((F.col("dataset_id") == dataset_id) & (F.col("status") == "completed")).orderBy(F.desc_nulls_last("finished_at"), "job_id")


def promote(jobs: DataFrame, dataset_id, job_id) -> tuple[DataFrame, DataFrame]:
    """L4: (the ledger with exactly that job active in its dataset, what was active before)."""
    own = F.col("dataset_id") == dataset_id
    before = jobs.where(own & F.col("is_active")).select("job_id")
    return jobs.withColumn("is_active", F.when(own, F.col("job_id") == job_id).otherwise(F.col("is_active"))), before


def compare(jobs: DataFrame, a, b, tie: float = 0.005) -> DataFrame:
    """Scores of two jobs, rounded delta, winner or tie."""
    x, y = jobs.where(F.col("job_id") == a).alias("x"), jobs.where(F.col("job_id") == b).alias("y")
    delta = F.round(F.col("y.roc_auc") - F.col("x.roc_auc"), 4)
    winner = F.when(F.abs(delta) < tie, "tie").when(delta > 0, "b").otherwise("a")
    return x.join(y, F.lit(True)).select(F.col("x.job_id").alias("job_a"), F.col("y.job_id").alias("job_b"), F.col("x.roc_auc").alias("auc_a"), F.col("y.roc_auc").alias("auc_b"), delta.alias("delta"), winner.alias("winner"))


def already_trained(requests: DataFrame, jobs: DataFrame, least: float = 0.65) -> DataFrame:
    """Requests with a good completed job for the same dataset, target and (null-safe) prior model."""
    done = jobs.where((F.col("status") == "completed") & (F.col("roc_auc") > least)).alias("d")
    r = requests.alias("r")
    same = (F.col("r.dataset_id") == F.col("d.dataset_id")) & (F.col("r.target_column") == F.col("d.target_column")) & F.col("r.prior_model_uri").eqNullSafe(F.col("d.prior_model_uri"))
    return r.join(done, same, "left_semi")


def trained_datasets(jobs: DataFrame) -> DataFrame:
    """L7."""
    return jobs.where(F.col("status") == "completed").select("dataset_id").distinct()


def surplus_runs(jobs: DataFrame, keep: int = 5, by: str = "dataset_id") -> DataFrame:
    """The runs of each experiment beyond the newest ones."""
    w = Window.partitionBy(by).orderBy(F.desc("started_at"), F.desc("job_id"))
    return jobs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") > keep).drop("rn")


def latency(samples: DataFrame, x: str, seconds: float | None = None) -> DataFrame:
    """Median, the values at the 95 % and 99 % places of the sorted samples, mean, and requests a second.

    The places are found in running counts over distinct values, not in a sorted array of all.
    """
    c = samples.where(F.col(x).isNotNull()).groupBy(F.lit(0).alias("g"), F.col(x).alias("v")).agg(F.count("*").alias("c"))
    all_ = samples.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.sum(x).alias("total"))
    all_ = all_.withColumn("p50", F.lit(medians(samples, [x]).get(x)).cast("double"))
    r = cumulative(c, "g", "v", ["c"]).crossJoin(F.broadcast(all_))  # one row
    at = lambda p: F.least(F.floor(F.col("n") * p).cast("long"), F.col("n") - 1) + 1
    first = lambda p: F.min(F.when(F.col("cum_c") >= at(p), F.col("v")))
    out = r.agg(F.max("n").alias("n"), F.max("p50").alias("p50"), first(0.95).alias("p95"), first(0.99).alias("p99"), F.max("mean").alias("mean"), F.max("total").alias("total"))
    span = F.lit(seconds) if seconds is not None else F.col("total") / 1000
    return out.select("n", "p50", "p95", "p99", "mean", F.try_divide(F.col("n"), span).alias("rate"))


def status(jobs: DataFrame, job_id) -> DataFrame:
    """L10."""
    cols = [c for c in ("job_id", "status", "roc_auc", "optimal_threshold", "finished_at", "error_message") if c in jobs.columns]
    return jobs.where(F.col("job_id") == job_id).select(*cols)
