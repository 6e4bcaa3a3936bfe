"""Analysis views over the driver's tables, each with the SQL definition that the oracles use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "2001-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_features(spark: SparkSession, sf_dir: str, snapshot: str = SNAPSHOT) -> DataFrame:
    """One row a customer: what was known before the snapshot, and whether no order followed."""
    orders = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    cut = F.lit(snapshot).cast("date")
    # One pass over orders: the aggregates before the snapshot and the flag after it.
    past = F.col("day") < cut
    per = orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count_if(past).alias("n"),
        F.round(F.sum(F.when(past, F.col("o_totalprice"))), 2).alias("spend"),
        F.min(F.when(past, F.col("day"))).alias("first"),
        F.max(F.when(past, F.col("day"))).alias("last"),
        F.max((~past).cast("int")).alias("back"),
    )
    c = table(spark, sf_dir, "customer")
    return c.join(per, c.c_custkey == per.k, "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"),
        F.coalesce("spend", F.lit(0.0)).alias("total_spend"),
        F.try_divide("spend", "n").alias("avg_value"),
        F.coalesce(F.floor(F.datediff(cut, "first") / 30), F.lit(0)).cast("int").alias("tenure_months"),
        F.datediff(cut, "last").alias("recency_days"),
        (1 - F.coalesce("back", F.lit(0))).cast("int").alias("churned"),
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same customers as an upload would hold them: text flags, blanks for missing numbers, spelling variants."""
    cf = customer_features(spark, sf_dir)
    i = F.col("customer_id")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (i % n + 1).cast("int"))
    return cf.select(
        F.concat(F.lit("C"), i.cast("string")).alias("Customer ID"),
        pick(2, "Male", "Female").alias("Gender"),
        pick(4, "Yes", "No", "No", "No").alias("Senior Citizen"),
        pick(3, "Yes", "No", "No").alias("Partner"),
        pick(5, "Yes", "No", "no answer", "No", "Yes").alias("Dependents"),
        F.col("tenure_months").alias("tenure"),
        pick(6, " dsl", "DSL", "fiber optic ", "Fiber Optic", "No", "satellite link").alias("Internet Service"),
        F.col("balance").alias("Monthly Charges"),
        F.when((i % 11 == 0) | (F.col("n_orders") == 0), " ").otherwise(F.col("total_spend").cast("long").cast("string")).alias("Total Charges"),
        F.when(F.col("churned") == 1, "Yes").otherwise("No").alias("Churn Label"),
        F.col("churned").alias("Churn Value"),
        F.col("segment").alias("City"),
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.experiments import assign

    return assign(customer_features(spark, sf_dir).select(F.col("customer_id").cast("string").alias("customer_id"), "segment", "churned", "n_orders", "total_spend"), "customer_id")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as a ledger of training jobs."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "training").otherwise("queued")
    started = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        (F.col("o_custkey") % 50).alias("dataset_id"),
        status.alias("status"),
        F.when(F.col("o_orderstatus") == "F", F.round(0.5 + F.col("o_totalprice") / 1200000, 4)).alias("roc_auc"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 != 0), F.round(0.2 + F.col("o_totalprice") / 1500000, 4)).alias("optimal_threshold"),
        F.col("o_orderpriority").alias("target_column"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("m"), (F.col("o_orderkey") % 7).cast("string"))).alias("prior_model_uri"),
        started.alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", F.timestamp_add("HOUR", (F.col("o_orderkey") % 36).cast("int"), started)).alias("finished_at"),
        (F.col("o_orderkey") % 97 == 5).alias("is_active"),
    )


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as exposures of customers; the group alternates, so first exposures matter."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.when((F.col("user_id") + F.col("event_id")) % 2 == 0, "A").otherwise("B").alias("ab_group"),
        F.col("event_type").alias("event"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value"),
    )


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a daily landing zone."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return e.select("event_id", "user_id", "event_type", "value", day.alias("date"), F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"))


CTES = {
    "cf": f"""cf AS (SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, c.c_mktsegment AS segment, c.c_nationkey AS nation, c.c_acctbal AS balance,
 coalesce(o.n, 0) AS n_orders, coalesce(o.spend, 0.0) AS total_spend, o.spend / o.n AS avg_value,
 CAST(coalesce(floor(date_diff('day', o.first, DATE '{SNAPSHOT}') / 30), 0) AS INTEGER) AS tenure_months,
 CAST(date_diff('day', o.last, DATE '{SNAPSHOT}') AS INTEGER) AS recency_days,
 CASE WHEN f.k IS NULL THEN 1 ELSE 0 END AS churned
 FROM customer c
 LEFT JOIN (SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS spend, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last
   FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '{SNAPSHOT}' GROUP BY 1) o ON o.k = c.c_custkey
 LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '{SNAPSHOT}') f ON f.k = c.c_custkey)""",
    "raw": """raw AS (SELECT 'C' || customer_id AS "Customer ID", ['Male','Female'][customer_id % 2 + 1] AS "Gender",
 ['Yes','No','No','No'][customer_id % 4 + 1] AS "Senior Citizen", ['Yes','No','No'][customer_id % 3 + 1] AS "Partner",
 ['Yes','No','no answer','No','Yes'][customer_id % 5 + 1] AS "Dependents", tenure_months AS tenure,
 [' dsl','DSL','fiber optic ','Fiber Optic','No','satellite link'][customer_id % 6 + 1] AS "Internet Service",
 balance AS "Monthly Charges",
 CASE WHEN customer_id % 11 = 0 OR n_orders = 0 THEN ' ' ELSE CAST(CAST(trunc(total_spend) AS BIGINT) AS VARCHAR) END AS "Total Charges",
 CASE WHEN churned = 1 THEN 'Yes' ELSE 'No' END AS "Churn Label", churned AS "Churn Value", segment AS "City" FROM cf)""",
    "asg": """asg AS (SELECT CAST(customer_id AS VARCHAR) AS customer_id, segment, churned, n_orders, total_spend,
 CASE WHEN (('0x' || substr(sha256(CAST(customer_id AS VARCHAR)), 1, 16))::UBIGINT % 1000000) / 1000000.0 < 0.5 THEN 'A' ELSE 'B' END AS ab_group FROM cf)""",
    "jobs": """jobs AS (SELECT o_orderkey AS job_id, o_custkey % 50 AS dataset_id,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'training' ELSE 'queued' END AS status,
 CASE WHEN o_orderstatus = 'F' THEN round(0.5 + o_totalprice / 1200000, 4) END AS roc_auc,
 CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN round(0.2 + o_totalprice / 1500000, 4) END AS optimal_threshold,
 o_orderpriority AS target_column, CASE WHEN o_orderkey % 4 = 0 THEN 'm' || (o_orderkey % 7) END AS prior_model_uri,
 o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours(o_orderkey % 36) END AS finished_at,
 o_orderkey % 97 = 5 AS is_active FROM orders)""",
    "exp": """exp AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS customer_id, CASE WHEN (user_id + event_id) % 2 = 0 THEN 'A' ELSE 'B' END AS ab_group,
 event_type AS event, ts, value FROM events)""",
    "land": """land AS (SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS date, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day FROM events)""",
}
