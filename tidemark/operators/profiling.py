"""Column profiles, target detection, leakage and group roles.

Three jobs profile a table: one wide aggregate for the moments (chunks of CHUNK columns keep it inside
code generation), one long aggregate of value counts, one of associations with the target. Profiles are a
small DataFrame, one row a column.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import keyed
from .cleaning import numbered

CHUNK = 200
# Date formats tried, role thresholds, target scores, recipes.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy")
EMAIL = r"^[\w.+-]+@[\w-]+\.[\w.-]+$"
URL = r"^(https?://|www\.)\S+$"
YES_LIKE = ("yes", "no", "y", "n", "true", "false", "t", "f", "1", "0")
KEYWORDS = ("target", "label", "churn", "class", "outcome", "status", "flag", "response", "default", "attrition", "exited", "fraud")
ENTROPY_BANDS = ((0.0, 0.5, 0.2), (0.5, 0.75, 0.6), (0.75, 0.95, 0.8))
RECIPES = {
    "NUMERIC": ("median", "standard"),
    "CATEGORICAL": ("most_frequent", "onehot"),
    "DATETIME": ("passthrough", "cyclical"),
    "TEXT": ("constant", "tfidf"),
    "ID": ("drop", "drop"),
    "IGNORE": ("drop", "drop"),
    "TARGET": ("drop", "drop"),
}
LEAKAGE, DUPLICATE, AUXILIARY = 0.95, 0.98, 0.5
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _kind(t: str) -> str:
    if t == "boolean":
        return "bool"
    if t in ("float", "double") or t.startswith("decimal"):
        return "float64"
    if t in NUMERIC:
        return "int64"
    return "datetime64" if t.startswith(("date", "timestamp")) else "object"


def column_profiles(df: DataFrame, entropy: bool = False) -> DataFrame:
    """One row a column: index, dtype, counts, null share, distinct values, moments, mean length,
    match rates; with ``entropy`` also T3.

    Moments are a plain aggregate of the rows. All else comes from the counts of distinct values, so a value
    is counted, matched and parsed once however often it occurs. A string column is a date column when one
    format reads all its values; only values of the format's shape are parsed.
    """
    types = df.dtypes
    rows = None
    for k in range(0, len(types), CHUNK):
        aggs, part = [F.count("*").alias("n")], list(enumerate(types))[k : k + CHUNK]
        for i, (c, t) in part:
            num = F.col(f"`{c}`").cast("double") if _kind(t) in ("int64", "float64") else F.lit(None).cast("double")
            moment = lambda f: F.coalesce(F.nanvl(f(num), F.lit(0.0)), F.lit(0.0))  # noqa: B023, E731
            aggs.append(F.struct(F.lit(i).alias("column_index"), F.lit(c).alias("column_name"), F.lit(_kind(t)).alias("kind"), moment(F.skewness).alias("skewness"), moment(F.kurtosis).alias("kurtosis")).alias(f"x{i}"))
        row = df.agg(*aggs).select("n", F.explode(F.array(*[F.col(f"x{i}") for i, _ in part])).alias("x")).select("n", "x.*")
        rows = row if rows is None else rows.union(row)
    texts = [c for c, t in types if t == "string"]
    text = F.when(F.col("of").isin(*texts), F.col("value")) if texts else F.lit(None).cast("string")
    share = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum(F.when(text.isNotNull(), F.col("n")))
    reads = lambda f: F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))).isNotNull()
    v = value_counts(df).withColumnRenamed("column_name", "of")
    found = v.groupBy("of").agg(
        F.sum("n").alias("non_null"),
        F.count("*").alias("unique_count"),
        F.try_divide(F.sum(F.length(text) * F.col("n")), F.sum(F.when(text.isNotNull(), F.col("n")))).alias("mean_length"),
        share(text.rlike(EMAIL)).alias("email_rate"),
        share(F.lower(text).rlike(URL)).alias("url_rate"),
        F.min(F.lower(text).isin(*YES_LIKE)).alias("yes_like"),
        F.greatest(*[F.min(reads(f)) for f in DATE_FORMATS]).alias("dated"),
        _entropy().alias("entropy"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = rows.join(found, rows.column_name == found.of, "left").withColumns({c: zero(c) for c in ("non_null", "unique_count")})
    dtype = F.when(F.col("non_null") == 0, "object").when((F.col("kind") == "object") & F.coalesce("dated", F.lit(False)), "datetime64").otherwise(F.col("kind"))
    return rows.select(
        "column_index",
        "column_name",
        dtype.alias("dtype"),
        F.col("n").alias("row_count"),
        "non_null",
        F.coalesce(F.try_divide(F.col("n") - F.col("non_null"), F.col("n")), F.lit(1.0)).alias("null_pct"),
        "unique_count",
        F.coalesce(F.try_divide("unique_count", "non_null"), F.lit(0.0)).alias("cardinality_ratio"),
        "skewness",
        "kurtosis",
        "mean_length",
        "email_rate",
        "url_rate",
        F.coalesce("yes_like", F.lit(False)).alias("yes_like"),
        *([F.coalesce("entropy", F.lit(0.0)).alias("entropy")] if entropy else []),
    )


def _shape(date_format: str) -> str:
    """What texts of a date format look like."""
    return "^" + re.sub("[yMdHms]+", lambda m: rf"\d{{{len(m[0])}}}", date_format) + "$"


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, value (as text), n: one long aggregate for all columns."""
    types = dict(df.dtypes)
    plain = lambda c: F.col(f"`{c}`") + F.lit(0).cast(types[c]) if types[c] in ("float", "double") else F.col(f"`{c}`")  # noqa: E731  -0.0 is 0.0
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), plain(c).cast("string").alias("value")) for c in columns or df.columns])
    return df.select(F.explode(pairs).alias("x")).where("x.value is not null").groupBy("x.column_name", "x.value").agg(F.count("*").alias("n"))


def _entropy():
    """Normalised entropy from the counts of a column's values, 0 with one value or none."""
    n = F.col("n")
    h = F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)
    return F.when(F.count("*") > 1, h / F.log(F.count("*"))).otherwise(0.0)


def entropies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Normalised entropy of each column's values."""
    return value_counts(df, columns).groupBy("column_name").agg(_entropy().alias("entropy"))


def base_roles(p: DataFrame) -> DataFrame:
    """T4: role and confidence from type and counts."""
    role = (
        F.when((F.col("non_null") == 0) | (F.col("unique_count") <= 1), "IGNORE")
        .when((F.col("cardinality_ratio") > 0.9) & F.col("dtype").isin("object", "int64"), "ID")
        .when(F.col("dtype") == "bool", "CATEGORICAL")
        .when(F.col("dtype").isin("int64", "float64"), F.when(F.col("unique_count") <= 15, "CATEGORICAL").otherwise("NUMERIC"))
        .when(F.col("dtype") == "datetime64", "DATETIME")
        .otherwise("CATEGORICAL")
    )
    confidence = (
        F.when((F.col("non_null") == 0) | (F.col("unique_count") <= 1), 1.0)
        .when((F.col("cardinality_ratio") > 0.9) & F.col("dtype").isin("object", "int64"), 0.9)
        .when(F.col("dtype") == "bool", 0.95)
        .when(F.col("dtype").isin("int64", "float64"), F.when(F.col("unique_count") <= 15, 0.6).otherwise(0.8))
        .when(F.col("dtype") == "datetime64", 0.9)
        .otherwise(0.4)
    )
    return p.withColumn("role", role).withColumn("confidence", confidence)


def semantic_roles(p: DataFrame) -> DataFrame:
    """E-mail and URL columns are ignored, long texts are TEXT, short ones with few values surer categories."""
    text = F.col("dtype") == "object"
    contact = text & ((F.col("email_rate") > 0.8) | (F.col("url_rate") > 0.8))
    long = text & (F.col("mean_length") > 50)
    few = text & (F.col("unique_count") <= 20) & ~F.col("role").isin("ID", "IGNORE")
    role = F.when(contact, "IGNORE").when(long, "TEXT").when(few, "CATEGORICAL").otherwise(F.col("role"))
    sure = F.when(contact, 0.9).when(long, 0.8).when(few, F.least(F.lit(1.0), F.col("confidence") + 0.3)).otherwise(F.col("confidence"))
    return p.withColumns({"role": role, "confidence": sure})


def recipes(p: DataFrame) -> DataFrame:
    """How a role is imputed and transformed (a table of seven rows)."""
    r = p.sparkSession.createDataFrame([(k, *v) for k, v in RECIPES.items()], "role string, impute string, transform string")
    return p.join(F.broadcast(r), "role", "left")


def target_scores(p: DataFrame) -> DataFrame:
    """How much each column looks like a target. ``p`` has entropy."""
    n = F.max("column_index").over(Window.partitionBy()) + 1  # one row a column
    name = F.lower("column_name")
    keyword = F.exists(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(name, k)) | (name == "y")
    h = F.col("entropy")
    band = F.lit(0.0)
    for lo, hi, score in ENTROPY_BANDS:
        band = F.when((h > lo) & (h <= hi), score).otherwise(band)
    score = (
        F.when(F.col("unique_count") == 2, 1.0).when(F.col("unique_count").between(3, 5), 0.5).otherwise(0.0)
        + band
        + F.when((F.col("unique_count") == 2) & F.col("yes_like"), 0.3).otherwise(0.0)
        + F.when(F.col("column_index") >= n - 2, 0.15).when(F.col("column_index") < 2, 0.05).otherwise(0.0)
        + F.when(keyword, 0.5).otherwise(0.0)
        + F.when(keyword & (h > 0) & (h <= 0.5), 0.2).otherwise(0.0)
    )
    fit = (F.col("unique_count") >= 2) & ~F.col("role").isin("IGNORE")
    return p.withColumn("target_score", F.when(fit, F.round(score, 6)).otherwise(0.0))


def ranked_candidates(scored: DataFrame, keep: int = 3, least: float = 1.0) -> DataFrame:
    """The best columns; the first is recommended when it reaches ``least``."""
    w = Window.orderBy(F.desc("target_score"), "column_index")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).withColumn("recommended", (F.col("rank") == 1) & (F.col("target_score") >= least))


def _codes(df: DataFrame, target: str) -> DataFrame:
    """The target as a number: itself, or its rank among its sorted values (which are few)."""
    if _kind(dict(df.dtypes)[target]) in ("int64", "float64"):
        return df.withColumn("__y", F.col(f"`{target}`").cast("double"))
    ranks = numbered(df.where(F.col(f"`{target}`").isNotNull()).select(F.col(f"`{target}`").alias("__v")).distinct(), ["__v"], "__r").select("__v", F.col("__r").cast("double").alias("__y"))
    return df.join(ranks, F.col(f"`{target}`") == F.col("__v"), "left").drop("__v")


def numeric_association(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Absolute correlation of each number column with the target's code over complete pairs, all in one pass; 0 if undefined."""
    d = _codes(df, target)
    pairs = lambda c: F.when(F.col("__y").isNotNull(), F.col(f"`{c}`").cast("double"))
    row = d.agg(*[F.abs(F.corr(pairs(c), F.when(F.col(f"`{c}`").isNotNull(), F.col("__y")))).alias(f"c{i}") for i, c in enumerate(columns)])
    each = [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.nanvl(F.col(f"c{i}"), F.lit(0.0)), F.lit(0.0)).alias("association")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def cramers_v(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Bias-corrected V of each column with the target, from the counts of value pairs only."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("x")) for c in columns])
    o = df.where(F.col(f"`{target}`").isNotNull()).select(F.col(f"`{target}`").cast("string").alias("y"), F.explode(pairs).alias("p")).where("p.x is not null").groupBy("p.column_name", "p.x", "y").agg(F.count("*").alias("o"))
    # Marginals are joined back; Spark can split the join where one value or class holds many pairs.
    rows, classes = (o.groupBy("column_name", k).agg(F.sum("o").alias(n)) for k, n in (("x", "r"), ("y", "c")))
    cells = o.join(rows, ["column_name", "x"]).join(classes, ["column_name", "y"])
    s = cells.groupBy("column_name").agg(F.sum(F.col("o") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("s"))
    a = s.join(rows.groupBy("column_name").agg(F.sum("r").alias("n"), F.count("*").alias("kr")), "column_name").join(classes.groupBy("column_name").agg(F.count("*").alias("kc")), "column_name")
    phi2 = F.greatest(F.lit(0.0), (F.col("s") - 1) - (F.col("kr") - 1) * (F.col("kc") - 1) / (F.col("n") - 1))
    rc, kc = F.col("kr") - (F.col("kr") - 1) * (F.col("kr") - 1) / (F.col("n") - 1), F.col("kc") - (F.col("kc") - 1) * (F.col("kc") - 1) / (F.col("n") - 1)
    low = F.least(rc, kc) - 1
    v = F.when((F.col("n") > 1) & (low > 0), F.sqrt(phi2 / low)).otherwise(0.0)
    return a.select("column_name", v.alias("association"))


def associations(df: DataFrame, profiles: DataFrame, target: str) -> DataFrame:
    """T10 for number columns with more than ten values, T11 for the others; texts and ids only when few values."""
    rows = profiles.where(F.col("column_name") != target).select("column_name", "dtype", "unique_count", "role").collect()
    num = [r[0] for r in rows if r[1] in ("int64", "float64") and r[2] > 10]
    cat = [r[0] for r in rows if r[0] not in num and r["role"] not in ("ID", "IGNORE", "TEXT")]
    out = [f(df, target, c) for f, c in ((numeric_association, num), (cramers_v, cat)) if c]
    if not out:
        return df.sparkSession.createDataFrame([], "column_name string, association double")
    return out[0] if len(out) == 1 else out[0].union(out[1])


def leaking(assoc: DataFrame, profiles: DataFrame, limit: float = LEAKAGE) -> DataFrame:
    """Columns, ids and ignored ones aside, that all but repeat the target."""
    return assoc.join(profiles.select("column_name", "role"), "column_name").where((F.col("association") > limit) & ~F.col("role").isin("ID", "IGNORE")).select("column_name", "association")


def group_roles(assoc: DataFrame, profiles: DataFrame) -> DataFrame:
    """DUPLICATE, LEAKAGE_SUSPECT or AUXILIARY columns of the target's group."""
    a = F.col("association")
    role = F.when(a > DUPLICATE, "DUPLICATE").when((a > LEAKAGE) & ~F.col("role").isin("ID", "IGNORE"), "LEAKAGE_SUSPECT").when(a >= AUXILIARY, "AUXILIARY")
    return assoc.join(profiles.select("column_name", "role"), "column_name").select("column_name", "association", role.alias("group_role")).where("group_role is not null")


def run_profiling(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles with roles, recipes, scores, association and leakage; ranked candidates)."""
    p = target_scores(semantic_roles(base_roles(column_profiles(df, entropy=True))))
    p = df.sparkSession.createDataFrame(p.collect(), p.schema)  # one row a column
    ranked = ranked_candidates(p)
    best = [r[0] for r in ranked.where("recommended").select("column_name").collect()]
    if best:
        p = with_target(df, p, best[0])
    return recipes(p), ranked


def with_target(df: DataFrame, profiles: DataFrame, target: str) -> DataFrame:
    """Roles for a confirmed target: its column is TARGET, another that was goes back to its base role, leaks are marked anew."""
    p = semantic_roles(base_roles(profiles.drop("association", "leakage", "role", "confidence", "impute", "transform")))
    a = associations(df, p, target)
    leaks = leaking(a, p).select("column_name", F.lit(True).alias("leakage"))
    p = p.join(a, "column_name", "left").join(leaks, "column_name", "left").withColumn("leakage", F.coalesce("leakage", F.lit(False)))
    return p.withColumn("role", F.when(F.col("column_name") == target, "TARGET").otherwise(F.col("role")))


def dropped_warnings(profiles: DataFrame) -> DataFrame:
    """A message for each column that is left out."""
    return profiles.where(F.col("role").isin("ID", "IGNORE")).select("column_name", F.format_string("Column '%s' is dropped: role %s", "column_name", "role").alias("message"))


def override_roles(profiles: DataFrame, roles: dict[str, str]) -> DataFrame:
    """F16: force the roles of named columns."""
    table = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    return profiles.withColumn("role", F.coalesce(F.try_element_at(table, F.col("column_name")), F.col("role")))


def store_profiles(profiles: DataFrame, path: str, dataset_id: str) -> None:
    """One JSON row a dataset in a keyed table, in the place of the one before."""
    row = profiles.agg(F.to_json(F.collect_list(F.struct("*"))).alias("profiles")).select(F.lit(dataset_id).alias("dataset_id"), "profiles", F.current_timestamp().alias("stored_at"))
    keyed.upsert(row, path, ["dataset_id"])


def load_profiles(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    stored = spark.read.parquet(path).where(F.col("dataset_id") == dataset_id).agg(F.max_by("profiles", "stored_at").alias("profiles"))
    schema = "array<struct<column_index:int,column_name:string,dtype:string,role:string,confidence:double,null_pct:double,unique_count:bigint,target_score:double,leakage:boolean>>"
    return stored.select(F.explode(F.from_json("profiles", schema)).alias("x")).select("x.*")


def detection_accuracy(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Dataset, target found and expected, whether they agree."""
    return expected.join(found, "dataset", "left").select("dataset", "expected", "detected", F.coalesce(F.col("expected") == F.col("detected"), F.lit(False)).alias("correct"))


def detect_target(df: DataFrame) -> str | None:
    """Name of the recommended target, if any."""
    r = run_profiling(df)[1].where("recommended").select("column_name").first()
    return r[0] if r else None
