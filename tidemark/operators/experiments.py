"""A/B tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats


def bucket(ident: str | Column) -> Column:
    """A number in [0, 1) from the first 16 hex digits of the id's SHA-256."""
    c = F.col(ident) if isinstance(ident, str) else ident
    h = F.conv(F.substring(F.sha2(c.cast("string").cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (h % 1_000_000).cast("double") / 1_000_000


def assign(df: DataFrame, ident: str, ratio: float = 0.5, out: str = "ab_group") -> DataFrame:
    """A1."""
    return df.withColumn(out, F.when(bucket(ident) < ratio, "A").otherwise("B"))


def first_exposure(exposures: DataFrame) -> DataFrame:
    """A3: the group of each customer's first exposure by time, then id."""
    return exposures.groupBy("customer_id").agg(F.min_by("ab_group", F.struct("ts", "id")).alias("ab_group"), F.min("ts").alias("first_ts"))


def analyze(assignments: DataFrame, outcomes: DataFrame, ident: str = "customer_id", outcome: str = "churn") -> DataFrame:
    """A4: group, n, successes, rate; no outcome counts as 0."""
    o = outcomes.groupBy(F.col(ident).alias("__k")).agg(F.max(outcome).alias("__y"))
    j = assignments.join(o, F.col(ident) == F.col("__k"), "left")
    return j.groupBy("ab_group").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("__y"), F.lit(0))).cast("long").alias("successes")).withColumn("rate", F.col("successes") / F.col("n"))


def z_statistic(groups: DataFrame) -> DataFrame:
    """A5: delta and pooled z of B against A; null when a group is missing or nothing varies."""
    pick = lambda g, c: F.max(F.when(F.col("ab_group") == g, F.col(c)))
    r = groups.agg(*[pick(g, c).alias(f"{c}_{g.lower()}") for g in "AB" for c in ("n", "successes", "rate")])
    p = F.try_divide(F.col("successes_a") + F.col("successes_b"), F.col("n_a") + F.col("n_b"))
    se = F.sqrt(p * (1 - p) * (1 / F.col("n_a") + 1 / F.col("n_b")))
    return r.select("n_a", "n_b", "rate_a", "rate_b", (F.col("rate_b") - F.col("rate_a")).alias("delta"), F.try_divide(F.col("rate_b") - F.col("rate_a"), se).alias("z"))


def z_test(groups: DataFrame) -> dict:
    """A5 with its two-sided p-value."""
    r = z_statistic(groups).first().asDict()
    if r["n_a"] is None or r["n_b"] is None:
        raise ValueError("both groups are needed")
    return r | {"p_value": stats.normal_two_sided(r["z"]) if r["z"] is not None else 1.0}


def sample_sizes(rates: DataFrame, mde: float, alpha: float = 0.05, power: float = 0.8, ratio: float = 1.0) -> DataFrame:
    """Per row of baseline ``rate`` the effect size h and the size of each group that finds a change of ``mde``."""
    k = (stats.normal_quantile(1 - alpha / 2) + stats.normal_quantile(power)) ** 2
    angle = lambda p: 2 * F.asin(F.sqrt(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))))
    h = angle(F.col("rate") + mde) - angle(F.col("rate"))
    n = F.ceil(F.try_divide(F.lit(k * (1 + 1 / ratio)), h * h))
    return rates.withColumn("effect_h", h).withColumn("n_a", n).withColumn("n_b", F.ceil(n * ratio))


def sanity(groups: DataFrame, least: int = 200) -> DataFrame:
    """A message for each group that is empty, negative or small."""
    bad = F.when(F.col("n") < 1, "empty").when(F.col("successes") < 0, "negative").when(F.col("n") < least, "small")
    return groups.withColumn("problem", bad).where("problem is not null").select("ab_group", "n", "problem")
