"""Drift between a reference and a target table (D1-D9). Long form (feature, value), so all features share a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .quantiles import cumulative, quantiles

# Fixed values.
BINS, EPSILON = 10, 1e-4
PSI_HIGH, PSI_MEDIUM, P_LIMIT = 0.2, 0.1, 0.05


def _long(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns])
    out = df.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null")
    return out.where(~F.isnan("value")) if kind == "double" else out


def numerical_psi(reference: DataFrame, target: DataFrame, columns: Sequence[str], bins: int = BINS, epsilon: float = EPSILON) -> DataFrame:
    """Feature, psi over the reference's deciles, outer bins open; 0 when either side is empty or the reference is constant."""
    r, t = _long(reference, columns, "double"), _long(target, columns, "double")
    edges = quantiles(r, ["value"], [k / bins for k in range(bins + 1)], by="feature")
    edges = edges.select("feature", F.sort_array(F.array_distinct("q")).alias("e"))  # one row a feature
    inner = F.slice("e", F.lit(2), F.greatest(F.size("e") - 2, F.lit(0)))
    edges = F.broadcast(edges.select("feature", inner.alias("cuts"), F.greatest(F.size("e") - 1, F.lit(0)).alias("bins")))
    place = F.size(F.filter("cuts", lambda c: c <= F.col("value")))

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.join(edges, "feature").groupBy("feature", place.alias("bin")).agg(F.count("*").alias(name))

    every = edges.where("bins > 0").select("feature", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), "bins")
    both = every.join(counted(r, "a"), ["feature", "bin"], "left").join(counted(t, "b"), ["feature", "bin"], "left").fillna(0, ["a", "b"])
    return _psi(both, columns, epsilon)


def _psi(both: DataFrame, columns: Sequence[str], epsilon: float) -> DataFrame:
    """Population stability from counts a, b by (feature, bin): with totals n, m the sum of (b / m - a / n) ln(b n / (a m)),
    of which the totals' part cancels, so one aggregate gives it however many bins a feature has."""
    a, b = F.col("a") + epsilon, F.col("b") + epsilon
    log = F.log(b / a)
    s = both.groupBy("feature").agg(F.sum("a").alias("n"), F.sum("b").alias("m"), F.sum(a).alias("na"), F.sum(b).alias("nb"), F.sum(a * log).alias("la"), F.sum(b * log).alias("lb"))
    x = s.select("feature", F.when((F.col("n") > 0) & (F.col("m") > 0), F.col("lb") / F.col("nb") - F.col("la") / F.col("na")).alias("psi"))
    names = both.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(x, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def categorical_counts(reference: DataFrame, target: DataFrame, columns: Sequence[str]) -> DataFrame:
    a = _long(reference, columns, "string").groupBy("feature", "value").agg(F.count("*").alias("a"))
    b = _long(target, columns, "string").groupBy("feature", "value").agg(F.count("*").alias("b"))
    return a.join(b, ["feature", "value"], "full_outer").fillna(0, ["a", "b"])


def categorical_psi(reference: DataFrame, target: DataFrame, columns: Sequence[str], epsilon: float = EPSILON) -> DataFrame:
    """Over the union of categories."""
    return _psi(categorical_counts(reference, target, columns), columns, epsilon)


def categorical_chi2(reference: DataFrame, target: DataFrame, columns: Sequence[str], epsilon: float = EPSILON) -> DataFrame:
    """D3: feature, statistic, dof of the 2 x k table (+ epsilon; Yates' correction when 2 x 2); one category or an empty side give 0 and 0."""
    a, b = F.col("a") + epsilon, F.col("b") + epsilon
    s = categorical_counts(reference, target, columns).groupBy("feature").agg(
        F.count("*").alias("k"), F.sum("a").alias("n"), F.sum("b").alias("m"), F.sum(a).alias("na"), F.sum(b).alias("nb"), F.sum(a * a / (a + b)).alias("sa"), F.sum(b * b / (a + b)).alias("sb"), F.sum(1 / (a + b)).alias("inverse")
    )
    total = F.col("na") + F.col("nb")
    plain = F.greatest(F.lit(0.0), total * (F.col("sa") / F.col("na") + F.col("sb") / F.col("nb") - 1))
    # In a 2 x 2 table every cell is as far from what is expected, which the correction brings nearer by a half at most.
    inverses = total * (1 / F.col("na") + 1 / F.col("nb")) * F.col("inverse")
    far = F.sqrt(plain / inverses)
    nearer = far - F.least(F.lit(0.5), far)
    ok = (F.col("k") > 1) & (F.col("n") > 0) & (F.col("m") > 0)
    statistic = F.when(ok, F.when(F.col("k") == 2, nearer * nearer * inverses).otherwise(plain)).otherwise(0.0)
    return s.select("feature", statistic.alias("statistic"), F.when(ok, F.col("k") - 1).otherwise(0).cast("long").alias("dof"))


def ks_statistic(reference: DataFrame, target: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature, statistic, n, m: the largest distance of the two distribution functions, over distinct values."""
    a = _long(reference, columns, "double").withColumn("src", F.lit(0))
    b = _long(target, columns, "double").withColumn("src", F.lit(1))
    c = a.union(b).groupBy("feature", "value").agg(F.count_if(F.col("src") == 0).alias("a"), F.count_if(F.col("src") == 1).alias("b"))
    n = c.groupBy("feature").agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    x = cumulative(c, "feature", "value", ["a", "b"]).join(n, "feature")
    d = F.abs(F.try_divide("cum_a", "n") - F.try_divide("cum_b", "m"))
    return x.groupBy("feature").agg(F.coalesce(F.max(d), F.lit(0.0)).alias("statistic"), F.max("n").alias("n"), F.max("m").alias("m"))


def report(reference: DataFrame, target: DataFrame, numerical: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Feature, type, psi, statistic, p_value, level, drifted. A feature drifts when its PSI is high or its test rejects."""
    spark = reference.sparkSession
    rows = []  # one row a feature
    if numerical:
        psi = {r["feature"]: r["psi"] for r in numerical_psi(reference, target, numerical).collect()}
        for r in ks_statistic(reference, target, numerical).collect():
            rows.append((r["feature"], "numerical", psi[r["feature"]], r["statistic"], stats.ks_p(r["statistic"], r["n"], r["m"])))
    if categorical:
        psi = {r["feature"]: r["psi"] for r in categorical_psi(reference, target, categorical).collect()}
        for r in categorical_chi2(reference, target, categorical).collect():
            rows.append((r["feature"], "categorical", psi[r["feature"]], r["statistic"], stats.chi2_p(r["statistic"], r["dof"])))
    df = spark.createDataFrame(rows, "feature string, type string, psi double, statistic double, p_value double")
    return levels(df)


def levels(df: DataFrame) -> DataFrame:
    """Drift level and flag from psi and p_value."""
    level = F.when(F.col("psi") >= PSI_HIGH, "high").when(F.col("psi") >= PSI_MEDIUM, "medium").otherwise("low")
    return df.withColumn("level", level).withColumn("drifted", (F.col("psi") >= PSI_HIGH) | (F.col("p_value") < P_LIMIT))


def overall(features: DataFrame) -> DataFrame:
    """None, moderate, high or critical (more than three in ten features) from the features' rows."""
    share = F.coalesce(F.try_divide(F.count_if("drifted"), F.count("*")), F.lit(0.0))
    level = F.when(share > 0.3, "critical").when(F.max((F.col("psi") >= PSI_HIGH).cast("int")) == 1, "high").when(F.max((F.col("psi") >= PSI_MEDIUM).cast("int")) == 1, "moderate").otherwise("none")
    return features.agg(F.count_if("drifted").alias("drifted_features"), F.count("*").alias("features"), share.alias("share"), level.alias("overall"))


def history_rows(features: DataFrame, dataset_id: str, run_at) -> DataFrame:
    """What is appended for a run: one row a feature."""
    return features.select(F.lit(dataset_id).alias("dataset_id"), F.lit(run_at).cast("timestamp").alias("created_at"), "*")


def latest_run(history: DataFrame) -> DataFrame:
    """The rows of each dataset's last run."""
    last = history.groupBy("dataset_id").agg(F.max("created_at").alias("created_at"))
    return history.join(last, ["dataset_id", "created_at"])


def dataset_drift(reference: DataFrame, landing: DataFrame, date: str, numerical: Sequence[str], categorical: Sequence[str], dataset_id: str = "d") -> DataFrame:
    """The reference against one day of the landing zone; rows for the history."""
    day = landing.where(F.col("date") == F.lit(date).cast("date"))
    return history_rows(report(reference, day, numerical, categorical), dataset_id, f"{date} 00:00:00")
