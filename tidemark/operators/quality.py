"""Contracts, quality metrics, service levels and partition checks (V1-V16). One aggregate a check."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cleaning import resolve_column, to_number


@dataclass(frozen=True)
class Rule:
    """What a column has to be. Optional columns that are absent are not checked."""

    column: str
    type: str = "string"  # string, int, double, timestamp
    nullable: bool = True
    allowed: tuple = ()
    least: float | None = None
    unique: bool = False
    required: bool = True


# The contracts of raw and processed customer tables.
_YES_NO = ("Yes", "No")
RAW = (
    Rule("CustomerID", nullable=False, unique=True),
    Rule("Gender", allowed=("Male", "Female")),
    Rule("SeniorCitizen", "int", nullable=False),
    Rule("Partner", allowed=_YES_NO),
    Rule("Dependents", allowed=_YES_NO),
    Rule("tenure", "int", least=0),
    Rule("PhoneService", allowed=_YES_NO),
    Rule("InternetService", allowed=("No", "DSL", "Fiber Optic", "Cable")),
    Rule("MonthlyCharges", "double", least=0),
    Rule("TotalCharges", "double", least=0),
    Rule("Churn", "int", nullable=False),
)
PROCESSED = (
    *(Rule(c, "int", allowed=(0, 1)) for c in ("Gender", "SeniorCitizen", "Partner", "Dependents", "Churn")),
    Rule("MonthlyCharges", "double", least=0),
    Rule("TotalCharges", "double", least=0),
    *(Rule(c, required=False) for c in ("tenure_bin", "monthly_bin", "cltv_bin")),
)


def _typed(df: DataFrame, rule: Rule) -> Column:
    c = F.col(f"`{resolve_column(df, rule.column)}`")
    if rule.type == "string":
        return c.cast("string")
    if rule.type == "timestamp":
        return F.try_to_timestamp(c.cast("string"))
    return to_number(c)


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """V1, V2, V3: rule, column and number of rows against it, for every rule, in one pass over the table."""
    checks, missing = [], []
    for r in rules:
        if resolve_column(df, r.column) is None:
            if r.required:
                missing.append(r.column)
            continue
        raw, v = F.col(f"`{resolve_column(df, r.column)}`"), _typed(df, r)
        if r.type != "string":
            checks.append((r.column, "type", F.count_if(raw.isNotNull() & v.isNull() & (F.trim(raw.cast("string")) != ""))))
        if not r.nullable:
            checks.append((r.column, "not_null", F.count_if(v.isNull())))
        if r.allowed:
            checks.append((r.column, "allowed", F.count_if(v.isNotNull() & ~v.isin(*r.allowed))))
        if r.least is not None:
            checks.append((r.column, "least", F.count_if(v < r.least)))
        if r.unique:
            checks.append((r.column, "unique", F.count(v) - F.count_distinct(v)))
    row = df.agg(*[c.cast("long").alias(f"c{i}") for i, (_, _, c) in enumerate(checks)]) if checks else df.sparkSession.range(1)
    entries = [F.struct(F.lit(n).alias("column_name"), F.lit(k).alias("rule"), F.col(f"c{i}").alias("failures")) for i, (n, k, _) in enumerate(checks)]
    entries += [F.struct(F.lit(m).alias("column_name"), F.lit("present").alias("rule"), F.lit(1).cast("long").alias("failures")) for m in missing]
    return row.select(F.explode(F.array(*entries)).alias("x")).select("x.*")


def validate(df: DataFrame, rules: Sequence[Rule], warn: bool = False) -> list[str]:
    """V1, V2, V4: raise on any violation, or return the messages."""
    said = [f"{r['column_name']}: {r['rule']} fails in {r['failures']} rows" for r in violations(df, rules).where("failures > 0").collect()]
    if said and not warn:
        raise ValueError("; ".join(said))
    return said


def schema_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """V3: type, nulls, their share and distinct values of each column."""
    cols = list(columns or df.columns)
    types = dict(df.dtypes)
    row = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(cols)], *[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(cols)])
    each = [
        F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"), (F.col("n") - F.col(f"k{i}")).alias("null_count"), F.round(F.coalesce(F.try_divide(F.col("n") - F.col(f"k{i}"), F.col("n")), F.lit(0.0)), 6).alias("null_pct"), F.col(f"d{i}").alias("distinct_count"))
        for i, c in enumerate(cols)
    ]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


# Types of a contract made from profiles.
PROFILE_TYPES = {"NUMERIC": "double", "CATEGORICAL": "string", "TEXT": "string", "DATETIME": "timestamp"}


def contract_from_profiles(profiles: Sequence[dict], target: str | None = None) -> tuple[list[Rule], dict]:
    """V5: a rule for each feature column, and what was left out; ids, ignored, target and leaking columns are."""
    rules, skipped = [], {}
    for p in profiles:
        if p["role"] in ("ID", "IGNORE", "TARGET") or p["column_name"] == target:
            skipped[p["column_name"]] = p["role"]
        elif p.get("leakage"):
            skipped[p["column_name"]] = "leakage"
        else:
            rules.append(Rule(p["column_name"], PROFILE_TYPES.get(p["role"], "string")))
    return rules, {"target": target, "skipped": skipped}


def contract_type(rules: Sequence[Rule]) -> T.StructType:
    kinds = {"double": T.DoubleType(), "int": T.IntegerType(), "timestamp": T.TimestampType()}
    return T.StructType([T.StructField(r.column, kinds.get(r.type, T.StringType()), r.nullable) for r in rules])


def save_contract(spark: SparkSession, path: str, rules: Sequence[Rule], metadata: dict) -> None:
    """V6: one JSON row with the rules, the Spark schema and the metadata."""
    row = (json.dumps([asdict(r) for r in rules]), contract_type(rules).json(), json.dumps(metadata))
    spark.createDataFrame([row], "rules string, schema string, metadata string").write.mode("overwrite").json(path)


def load_contract(spark: SparkSession, path: str) -> tuple[list[Rule], dict]:
    r = spark.read.schema("rules string, schema string, metadata string").json(path).first()
    return [Rule(**{**x, "allowed": tuple(x["allowed"])}) for x in json.loads(r["rules"])], json.loads(r["metadata"])


def collect_metrics(df: DataFrame, table: str, key: str | None = None, elapsed: float | None = None) -> DataFrame:
    """V7: one row of counts: rows, columns, duplicates of the key beyond the first, nulls by column."""
    cols = df.columns
    dup = F.count("*") - F.count_distinct(F.col(f"`{key}`")) - F.max(F.col(f"`{key}`").isNull().cast("int")) if key else F.lit(0)
    row = df.agg(F.count("*").alias("n"), F.coalesce(dup, F.lit(0)).cast("long").alias("dup"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"k{i}") for i, c in enumerate(cols)])
    entries = [x for i, c in enumerate(cols) for x in (F.lit(c), F.col(f"k{i}"))]
    shares = [x for i, c in enumerate(cols) for x in (F.lit(c), F.coalesce(F.try_divide(F.col(f"k{i}") * 100.0, F.col("n")), F.lit(0.0)))]
    return row.select(
        F.lit(table).alias("table_name"),
        F.col("n").alias("row_count"),
        F.lit(len(cols)).cast("long").alias("column_count"),
        F.col("dup").alias("duplicate_count"),
        F.create_map(*entries).alias("null_counts"),
        F.create_map(*shares).alias("null_percentages"),
        F.array(*map(F.lit, cols)).alias("columns"),
        F.lit(elapsed).cast("double").alias("processing_time"),
    )


def append_metrics(metrics: DataFrame, path: str) -> None:
    """V8."""
    metrics.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(path)


def latest_metrics(history: DataFrame, table: str | None = None) -> DataFrame:
    """V8: the newest row of each table."""
    h = history.where(F.col("table_name") == table) if table else history
    rest = F.struct(*[c for c in h.columns if c != "table_name"])
    return h.groupBy("table_name").agg(F.max_by(rest, "timestamp").alias("x")).select("table_name", "x.*")


# Default service levels.
DEFAULT_SLA = {"min_rows": 100, "max_null_pct": {"DEFAULT": 10.0}, "max_duplicates": 0}


def sla_violations(metrics: DataFrame, sla: dict = DEFAULT_SLA) -> DataFrame:
    """Table, check, column, value and limit of each breach: rows below, null share above, duplicates above."""
    out = []
    limits = sla.get("max_null_pct")
    row = lambda m, check, column, value, limit: m.select("table_name", F.lit(check).alias("check"), column.cast("string").alias("column_name"), value.cast("double").alias("value"), limit.cast("double").alias("limit"))
    none = F.lit(None)
    if "min_rows" in sla:
        out.append(row(metrics.where(F.col("row_count") < sla["min_rows"]), "min_rows", none, F.col("row_count"), F.lit(sla["min_rows"])))
    if limits is not None:
        by = limits if isinstance(limits, dict) else {"DEFAULT": limits}
        table = F.create_map(*[F.lit(x) for c, v in by.items() for x in (c, float(v))])
        m = metrics.select("table_name", F.explode("null_percentages").alias("c", "v")).withColumn("l", F.coalesce(F.try_element_at(table, F.col("c")), F.try_element_at(table, F.lit("DEFAULT"))))
        out.append(row(m.where("v > l"), "max_null_pct", F.col("c"), F.col("v"), F.col("l")))
    if "max_duplicates" in sla:
        out.append(row(metrics.where(F.col("duplicate_count") > sla["max_duplicates"]), "max_duplicates", none, F.col("duplicate_count"), F.lit(sla["max_duplicates"])))
    first = out[0]
    for o in out[1:]:
        first = first.union(o)
    return first


def validate_sla(metrics: DataFrame, sla: dict = DEFAULT_SLA) -> None:
    """V9: raise when there is a breach."""
    said = [f"{r['check']} {r['column_name'] or ''}: {r['value']:g} against {r['limit']:g}" for r in sla_violations(metrics, sla).collect()]
    if said:
        raise ValueError("service levels broken: " + "; ".join(said))


def partition_layout(df: DataFrame, keys: Sequence[str] = ("year", "month", "day")) -> DataFrame:
    """For each key the number of values and the sorted values (of partition columns, so few)."""
    there = [k for k in keys if k in df.columns]
    row = df.agg(*[F.sort_array(F.collect_set(F.col(k).cast("string"))).alias(k) for k in there])
    each = [F.struct(F.lit(k).alias("key"), F.size(k).cast("long").alias("n_values"), F.array_join(k, ",").alias("values")) for k in there]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def partition_skew(df: DataFrame, threshold: float = 2.0, keys: Sequence[str] = ("year", "month", "day")) -> DataFrame:
    """Rows of each partition with their ratio to the mean, whether they are skewed, and max / (min + 1) over all."""
    n = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    w = Window.partitionBy()  # one row a partition
    avg = F.avg("rows").over(w)
    return n.select(*keys, "rows", (F.col("rows") / avg).alias("ratio"), ((F.col("rows") > avg * threshold) | (F.col("rows") < avg / threshold)).alias("skewed"), (F.max("rows").over(w) / (F.min("rows").over(w) + 1)).alias("skew_ratio"))


def missing_days(df: DataFrame, start: str, end: str, date_col: str = "date") -> DataFrame:
    """Days of the range without a partition."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(date_col))
    return days.join(df.select(F.col(date_col).cast("date").alias(date_col)).distinct(), date_col, "left_anti")


def partition_statistics(df: DataFrame, keys: Sequence[str] = ("year", "month", "day")) -> DataFrame:
    """V13."""
    n = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    return n.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"), F.count("*").alias("partitions"), F.coalesce(F.avg("rows"), F.lit(0.0)).alias("mean_rows"))


def guard_table(df: DataFrame, target: str | None = None) -> None:
    """Two columns at least, rows, the target, and two classes in it."""
    if len(df.columns) < 2:
        raise ValueError("a table needs two columns")
    if df.isEmpty():
        raise ValueError("the table is empty")
    if target is not None:
        if target not in df.columns:
            raise ValueError(f"no column {target}")
        if df.where(F.col(target).isNotNull()).select(target).distinct().limit(2).count() < 2:
            raise ValueError(f"{target} has fewer than two classes")


def step_summary(steps: Sequence[tuple[str, int, int]], spark: SparkSession) -> DataFrame:
    """Rows in and out of each step and the share that went."""
    df = spark.createDataFrame(list(steps), "step string, rows_in long, rows_out long")
    return df.withColumn("reduction_pct", F.coalesce(F.try_divide((F.col("rows_in") - F.col("rows_out")) * 100.0, F.col("rows_in")), F.lit(0.0)))
