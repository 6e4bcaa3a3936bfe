"""Batch scoring and risk tiers."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .modelling import slim


def classify_risk(p: str | Column, t: str | Column | float) -> Column:
    """R2: High from min(1.5 t, 0.85), Medium from t, else Low."""
    p = F.col(p) if isinstance(p, str) else p
    t = F.lit(t) if isinstance(t, (int, float)) else F.col(t) if isinstance(t, str) else t
    return F.when(p >= F.least(t * 1.5, F.lit(0.85)), "High").when(p >= t, "Medium").otherwise("Low")


def predict_batch(model, df: DataFrame, ident: str, threshold: float) -> DataFrame:
    """Id, probability and tier of every row; the model runs in the JVM. Works on streams too."""
    out = slim(model).transform(df)
    p = vector_to_array("probability")[1]
    return out.select(F.col(ident), p.alias("probability"), classify_risk(p, threshold).alias("risk"))


def risk_summary(scored: DataFrame, threshold: float, source: str) -> DataFrame:
    """R3."""
    return scored.agg(F.count("*").alias("total"), *[F.count_if(F.col("risk") == k).alias(k.lower()) for k in ("High", "Medium", "Low")]).withColumns({"threshold": F.lit(float(threshold)), "source": F.lit(source)})


def optimal_threshold(jobs: DataFrame, metric: str = "metric_threshold", ledger: str = "optimal_threshold", artifact: str = "artifact_threshold") -> DataFrame:
    """The first of metric, ledger, artifact, default 0.5, and which it was."""
    has = [(F.col(c), n) for c, n in ((metric, "metric"), (ledger, "ledger"), (artifact, "artifact")) if c in jobs.columns]
    source = F.lit("default")
    for c, n in reversed(has):
        source = F.when(c.isNotNull(), n).otherwise(source)
    return jobs.withColumn("threshold", F.coalesce(*[c for c, _ in has], F.lit(0.5))).withColumn("threshold_source", source)


def active_models(jobs: DataFrame) -> DataFrame:
    """Each dataset's active completed job, else its best one."""
    w = Window.partitionBy("dataset_id").orderBy(F.desc("is_active"), F.desc_nulls_last("roc_auc"), "job_id")
    return jobs.where(F.col("status") == "completed").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
