"""Queries of operators that write and read back: formats, landing zones, logs, contracts, models and streams."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import composite as K
from ..operators import drift as D
from ..operators import features as FT
from ..operators import incremental as I
from ..operators import modelling as M
from ..operators import profiling as T
from ..operators import quality as V
from ..operators import scoring as R
from ..session import shared_folder
from ..sources import io as S
from ..sources import keyed
from ..streaming import streams
from . import views
from .queries_analysis import _FEATURES, _NUM, _P, LINE, _halves, _shifted, line
from .queries_tables import CF, RAW, cf, r6, raw
from .registry import query

EXP = ("exp",)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def _customers(df: DataFrame) -> DataFrame:
    return df.select(F.col("Customer ID").alias("customer_id"), F.col("tenure").cast("int").alias("tenure"), F.col("City").alias("city"))


_CUSTOMERS = 'SELECT "Customer ID" AS customer_id, tenure, "City" AS city FROM raw'


def _csv(spark, sf, sep: str, name: str) -> str:
    path = f"{_folder(spark)}/{name}"
    raw(spark, sf).write.option("header", True).option("sep", sep).csv(path)
    return path


# Formats


@query(_CUSTOMERS, RAW)
def S1_csv_detected_separator(spark, sf):
    return _customers(S.read_csv(spark, _csv(spark, sf, ";", "customers.csv")))


@query(_CUSTOMERS, RAW)
def S2_tsv(spark, sf):
    return _customers(S.read_any(spark, _csv(spark, sf, "\t", "customers.tsv")).df)


@query(_CUSTOMERS, RAW)
def S4_json(spark, sf):
    path = f"{_folder(spark)}/customers.jsonl"
    raw(spark, sf).write.json(path)
    return _customers(S.read_json(spark, path, lines=True))


@query("SELECT f AS format, count(*) AS n, count(DISTINCT city) AS cities FROM (SELECT \"City\" AS city, unnest(['csv', 'json', 'parquet', 'tsv']) AS f FROM raw) GROUP BY 1", RAW)
def S5_read_any(spark, sf):
    at = _folder(spark)
    raw(spark, sf).write.json(f"{at}/c.jsonl")
    raw(spark, sf).write.parquet(f"{at}/c.parquet")
    out = None
    for path in (_csv(spark, sf, "|", "c.csv"), _csv(spark, sf, "\t", "c.tsv"), f"{at}/c.jsonl", f"{at}/c.parquet"):
        found = S.read_any(spark, path)
        rows = found.df.agg(F.lit(found.detected_format).alias("format"), F.count("*").alias("n"), F.count_distinct("City").alias("cities"))
        out = rows if out is None else out.union(rows)
    return out


@query("""SELECT "Customer ID" AS customer_id, CASE lower(trim("Internet Service")) WHEN 'no' THEN 'No' WHEN 'dsl' THEN 'DSL' WHEN 'fiber optic' THEN 'Fiber Optic' ELSE 'Satellite Link' END AS service, "Churn Value" AS churn FROM raw""", RAW)
def S6_load_customers(spark, sf):
    return S.load_customers(spark, _csv(spark, sf, ",", "customers.csv")).select(F.col("CustomerID").alias("customer_id"), F.col("InternetService").alias("service"), F.col("Churn").cast("int").alias("churn"))


@query("SELECT CAST(date AS VARCHAR) AS date, count(*) AS n, round(sum(value), 4) AS total FROM land GROUP BY 1", ("land",))
def S9_partitioned_save(spark, sf):
    path = f"{_folder(spark)}/landing"
    S.save_parquet(views.landing(spark, sf), path, "date")
    return spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT ab_group, count(*) AS n, count(DISTINCT customer_id) AS customers FROM exp GROUP BY 1", EXP)
def S11_exposure_log(spark, sf):
    """Every second line has the other spelling of the key; some lines are cut off and count for nothing."""
    e = views.exposures(spark, sf)
    parts = lambda key: F.to_json(F.struct(F.col("customer_id").alias(key), "ab_group", "event", F.unix_timestamp("ts").cast("double").alias("ts")))
    lines = e.select(F.when(F.col("id") % 2 == 0, parts("customer_id")).otherwise(parts("CustomerID")).alias("value"))
    path = f"{_folder(spark)}/log"
    lines.union(e.where("id % 10 = 0").select(F.substring(parts("customer_id"), 1, 20))).write.text(path)
    return S.read_exposure_log(spark, path).groupBy("ab_group").agg(F.count("*").alias("n"), F.count_distinct("customer_id").alias("customers"))


@query("SELECT ab_group, count(*) AS n, count(*) FILTER (id % 7 <> 0) AS timed FROM exp GROUP BY 1", EXP)
def S12_exposure_sink(spark, sf):
    """Two batches; a missing time becomes that of the write, which is later than any event's."""
    e = views.exposures(spark, sf).withColumn("ts", F.when(F.col("id") % 7 != 0, F.col("ts")))
    path = f"{_folder(spark)}/exposures"
    S.append_exposures(e.where("id % 2 = 0"), path)
    S.append_exposures(e.where("id % 2 = 1"), path)
    last = views.exposures(spark, sf).agg(F.max("ts").alias("last"))
    return spark.read.parquet(path).crossJoin(F.broadcast(last)).where("ts is not null").groupBy("ab_group").agg(F.count("*").alias("n"), F.count_if(F.col("ts") <= F.col("last")).alias("timed"))  # one row


@query("SELECT segment, count(*) AS n, round(sum(balance), 2) AS balance, 'a' AS dataset_id FROM cf WHERE customer_id % 2 = 0 GROUP BY 1", CF)
def S13_landing_write(spark, sf):
    path, c = f"{_folder(spark)}/landing", cf(spark, sf)
    S.write_landing(c.where("customer_id % 2 = 0"), path, "a", "2024-01-05", "churned")
    S.write_landing(c.where("customer_id % 2 = 1"), path, "a", "2024-01-06", "churned")
    S.write_landing(c, path, "b", "2024-01-05", "churned")
    day = S.read_landing(spark, path, "a", "2024-01-05")
    assert "churned" not in day.columns
    return day.groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"), F.first("dataset_id").alias("dataset_id"))


@query("SELECT 'customers' AS id, 'Churn Label' AS target, count(*) AS rows, count(DISTINCT \"Churn Label\") AS classes FROM raw", RAW)
def S17_catalog(spark, sf):
    path = _csv(spark, sf, ";", "customers.csv")
    rows = [("customers", "Customers", "customers.csv", ";", "Churn Label", "binary", "active", ["Customer ID"], 0), ("old", "Old", "old.csv", ",", "y", "binary", "retired", ["id"], 0)]
    entry = S.catalog(spark, rows).first()
    return S.read_catalogued(spark, entry, path.rsplit("/", 1)[0]).agg(F.lit(entry["id"]).alias("id"), F.lit(entry["target"]).alias("target"), F.count("*").alias("rows"), F.count_distinct(entry["target"]).alias("classes"))


@query("SELECT customer_id, ab_group FROM asg", ("cf", "asg"))
def S18_csv_sink(spark, sf):
    path = f"{_folder(spark)}/assignments"
    S.write_csv(views.assignments(spark, sf), path, ["customer_id", "ab_group"])
    return spark.read.option("header", True).schema("customer_id string, ab_group string").csv(path)


@query("SELECT 'd1' AS dataset_id, 'csv' AS format, count(*) AS rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM raw)) AS columns FROM raw", RAW)
def S20_upload(spark, sf):
    return S.upload(spark, _csv(spark, sf, ",", "customers.csv"), f"{_folder(spark)}/landed", "d1").select("dataset_id", "format", "rows", F.col("columns").cast("long").alias("columns"))


# Names and roles

_ASKED = ("CustomerID", "SeniorCitizen", "InternetService", "tenure", "Churn", "PhoneService")


@query("SELECT 'CustomerID' AS asked, 'Customer ID' AS found, count(\"Customer ID\") AS n FROM raw UNION ALL SELECT 'SeniorCitizen', 'Senior Citizen', count(\"Senior Citizen\") FROM raw UNION ALL SELECT 'InternetService', 'Internet Service', count(\"Internet Service\") FROM raw UNION ALL SELECT 'tenure', 'tenure', count(tenure) FROM raw UNION ALL SELECT 'Churn', 'Churn Value', count(\"Churn Value\") FROM raw UNION ALL SELECT 'PhoneService', NULL, 0 FROM (SELECT count(*) FROM raw)", RAW)
def P1_resolve_column(spark, sf):
    df = raw(spark, sf)
    found = {a: C.resolve_column(df, a) for a in _ASKED}
    row = df.agg(*[(F.count(F.col(f"`{f}`")) if f else F.lit(0).cast("long")).alias(a) for a, f in found.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("asked"), F.lit(f).cast("string").alias("found"), F.col(a).alias("n")) for a, f in found.items()])).alias("x")).select("x.*")


@query("SELECT column_name, n FROM (SELECT unnest(list_filter([c.column_name FOR c IN list], lambda c: NOT contains(lower(c), 'churn') AND c <> 'City')) AS column_name FROM (SELECT list(d) AS list FROM (DESCRIBE SELECT * FROM raw) d)), (SELECT count(*) AS n FROM raw)", RAW)
def P19_drop_target_like(spark, sf):
    left = C.drop_target_like(raw(spark, sf), "City")
    return left.agg(F.count("*").alias("n")).select(F.explode(F.array(*map(F.lit, left.columns))).alias("column_name"), "n")


@query(f"{_P} SELECT column_name FROM s WHERE role NOT IN ('ID', 'IGNORE') AND column_name <> 'l_linestatus'")
def P21_feature_columns(spark, sf):
    p = T.base_roles(T.column_profiles(line(spark, sf).select(*LINE)))
    return spark.createDataFrame([(c,) for c in C.feature_columns(p, target="l_linestatus")], "column_name string")


@query("SELECT customer_id, n_orders FROM cf", CF)
def F10_passthrough_or_drop(spark, sf):
    d = cf(spark, sf).select("customer_id", "n_orders", "balance")
    return FT.passthrough_or_drop(FT.passthrough_or_drop(d, ["n_orders"], "passthrough"), ["balance"], "drop")


@query(f"{_P} SELECT column_name, CASE column_name WHEN 'l_tax' THEN 'NUMERIC' WHEN 'l_partkey' THEN 'IGNORE' ELSE role END AS role FROM s")
def F16_override_roles(spark, sf):
    p = T.base_roles(T.column_profiles(line(spark, sf).select(*LINE)))
    return T.override_roles(p, {"l_tax": "NUMERIC", "l_partkey": "IGNORE"}).select("column_name", "role")


_BAL = "least(greatest(balance, lo), hi)"


@query(f"+ q AS (SELECT quantile_cont(balance, 0.01) AS lo, quantile_cont(balance, 0.99) AS hi FROM cf), m AS (SELECT avg({_BAL}) AS m, stddev_pop({_BAL}) AS s FROM cf, q) SELECT customer_id, round(({_BAL} - m) / s, 6) AS balance, CAST(1 AS DOUBLE) AS segments, CAST(nation AS DOUBLE) AS nation FROM cf, q, m", CF)
def F11_feature_pipeline(spark, sf):
    """The pipeline's vector: a clipped and scaled number, one of the segments, an auxiliary column as it is."""
    d = cf(spark, sf)
    roles = [{"column_name": "balance", "role": "NUMERIC"}, {"column_name": "segment", "role": "CATEGORICAL"}, {"column_name": "customer_name", "role": "ID"}]
    v = FT.feature_pipeline(d, roles, "churned", aux=["nation"]).fit(d).transform(d).select("customer_id", vector_to_array("features").alias("f"))
    middle = F.aggregate(F.slice("f", F.lit(2), F.size("f") - 2), F.lit(0.0), lambda a, x: a + x)
    return v.select("customer_id", F.round(F.get("f", F.lit(0)), 6).alias("balance"), middle.alias("segments"), F.element_at("f", -1).alias("nation"))


@query("SELECT unnest(CASE WHEN n < 500 THEN ['linear'] WHEN n < 1000 THEN ['linear', 'forest'] WHEN n <= 2000 THEN ['forest'] ELSE ['forest', 'boosted'] END) AS learner FROM (SELECT count(*) AS n FROM cf)", CF)
def M6_route_models(spark, sf):
    d = cf(spark, sf).select("balance", "n_orders", "segment")
    p = T.semantic_roles(T.base_roles(T.column_profiles(d))).collect()
    return spark.createDataFrame([(x,) for x in M.route_models(p[0]["row_count"], p)], "learner string")


# Contracts, metrics, profiles, watermarks, lineage


@query(f"{_P} SELECT column_name, CASE role WHEN 'NUMERIC' THEN 'double' WHEN 'DATETIME' THEN 'timestamp' ELSE 'string' END AS type FROM s WHERE role NOT IN ('ID', 'IGNORE') AND column_name <> 'l_linestatus'")
def V5_contract_from_profiles(spark, sf):
    p = T.base_roles(T.column_profiles(line(spark, sf).select(*LINE))).collect()
    rules, _ = V.contract_from_profiles([r.asDict() for r in p], "l_linestatus")
    return spark.createDataFrame([(r.column, r.type) for r in rules], "column_name string, type string")


@query("""SELECT 'Dependents' AS column_name, 'allowed' AS rule, count(*) FILTER ("Dependents" NOT IN ('Yes', 'No')) AS failures FROM raw UNION ALL SELECT 'MonthlyCharges', 'least', count(*) FILTER ("Monthly Charges" < 0) FROM raw""", RAW)
def V6_stored_contract(spark, sf):
    path = f"{_folder(spark)}/contract"
    V.save_contract(spark, path, V.RAW, {"table": "raw"})
    rules, _ = V.load_contract(spark, path)
    return V.violations(raw(spark, sf), rules).where("(column_name, rule) in (('Dependents', 'allowed'), ('MonthlyCharges', 'least'))")


@query("SELECT 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def V8_metrics_log(spark, sf):
    path = f"{_folder(spark)}/metrics"
    orders, events = (views.table(spark, sf, t) for t in ("orders", "events"))
    for df, name in ((orders.where("o_orderkey % 2 = 0"), "orders"), (events, "events"), (orders, "orders")):
        V.append_metrics(V.collect_metrics(df, name), path)
    return V.latest_metrics(spark.read.parquet(path)).select("table_name", "row_count")


@query("SELECT 'two classes' AS guarded, TRUE AS passes FROM (SELECT count(*) FROM orders) UNION ALL SELECT 'one class', count(DISTINCT o_orderstatus) > 1 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'no rows', count(*) > 0 FROM orders WHERE o_totalprice < 0")
def V14_table_guards(spark, sf):
    o = views.table(spark, sf, "orders")
    out = []
    for name, df in (("two classes", o), ("one class", o.where("o_orderstatus = 'F'")), ("no rows", o.where("o_totalprice < 0"))):
        try:
            V.guard_table(df, "o_orderstatus")
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "guarded string, passes boolean")


@query("SELECT 'events' AS table_name, strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS watermark FROM events UNION ALL SELECT 'orders', strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders")
def I1_watermarks(spark, sf):
    path = f"{_folder(spark)}/watermarks"
    last = {"events": views.table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0], "orders": views.table(spark, sf, "orders").agg(F.max(F.col("o_orderdate").cast("timestamp"))).first()[0]}
    I.set_watermark(spark, path, "events", "2020-01-01 00:00:00")
    for table, ts in last.items():
        I.set_watermark(spark, path, table, ts.replace(microsecond=0))
    h = keyed.read(spark, path)
    return spark.createDataFrame([(t, str(I.get_watermark(h, t))) for t in last], "table_name string, watermark string")


_DONE = """count(*) FILTER (TRY_CAST(trim("Total Charges") AS DOUBLE) IS NOT NULL)"""


@query(f"SELECT 'raw' AS source, 'convert_types' AS target, 'convert_types' AS transformation, count(*) AS rows_before, count(*) AS rows_after FROM raw UNION ALL SELECT 'convert_types', 'drop_invalid_rows', 'drop_invalid_rows', count(*), {_DONE} FROM raw UNION ALL SELECT 'drop_invalid_rows', 'map_booleans', 'map_booleans', {_DONE}, {_DONE} FROM raw UNION ALL SELECT 'map_booleans', 'processed', 'create_features', {_DONE}, {_DONE} FROM raw", RAW)
def G1_logged_edges(spark, sf):
    return I.run_pipeline(spark, raw(spark, sf), None, key="Customer ID", dry_run=True)["lineage"].select("source", "target", "transformation", "rows_before", "rows_after")


@query(f"{_P} SELECT column_name, role, u AS unique_count FROM s")
def T17_stored_profiles(spark, sf):
    path = f"{_folder(spark)}/profiles"
    d = line(spark, sf).select(*LINE)
    p = T.base_roles(T.column_profiles(d))
    T.store_profiles(p.where("role = 'ID'"), path, "lineitem")
    T.store_profiles(p, path, "lineitem")
    return T.load_profiles(spark, path, "lineitem").select("column_name", "role", "unique_count")


# Composite scores


def _group(spark, sf):
    a = T.numeric_association(cf(spark, sf), "churned", _NUM)
    return a.withColumn("group_role", F.when(F.col("column_name").isin("n_orders", "total_spend"), "AUXILIARY"))


@query("SELECT count(*) AS n, TRUE AS attached, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, TRUE AS same FROM cf", CF)
def K4_synthesized_score(spark, sf):
    """The score runs from 0 to 1 over its own table, and is the same from its fitted parameters (K6)."""
    d = cf(spark, sf)
    f = K.synthesize(d, _group(spark, sf), "churned")
    both = K.attach_if_expected(d, [K.SCORE], f).withColumn("again", f.column())
    return both.agg(F.count(K.SCORE).alias("n"), F.lit(bool(f.attach)).alias("attached"), F.round(F.min(K.SCORE), 9).alias("low"), F.round(F.max(K.SCORE), 9).alias("high"), F.min(F.col(K.SCORE) == F.col("again")).alias("same"))


@query("SELECT customer_id, round((s - lo) / (hi - lo), 6) AS score FROM (SELECT *, (n_orders - nlo) / (nhi - nlo) AS s, (0 - nlo) / (nhi - nlo) AS z FROM cf, (SELECT min(n_orders) AS nlo, max(n_orders) AS nhi FROM cf)), (SELECT 0.0 AS lo, 1.0 AS hi)", CF)
def K6_score_time_synthesis(spark, sf):
    """Fitted on all customers, applied to tables that lack the score, part by part."""
    d = cf(spark, sf)
    f = K.weighted_score(d, [K.Weight("n_orders", 1.0)])
    parts = [K.attach_if_expected(d.where(f"customer_id % 3 = {k}"), [K.SCORE], f) for k in range(3)]
    return parts[0].union(parts[1]).union(parts[2]).select("customer_id", F.round(K.SCORE, 6).alias("score"))


# Models and streams


def _fitted(spark, sf):
    from pyspark.ml import Pipeline

    d = cf(spark, sf).withColumn("label", F.col("churned"))
    stages = [VectorAssembler(inputCols=["n_orders", "tenure_months"], outputCol="features"), LogisticRegression(maxIter=10)]
    return d, M.slim(Pipeline(stages=stages).fit(d))


@query("SELECT count(*) AS n, TRUE AS same FROM cf", CF)
def M20_persisted_model(spark, sf):
    d, m = _fitted(spark, sf)
    path = f"{_folder(spark)}/model"
    M.save_model(m, path, spark, 0.5, ["n_orders", "tenure_months"], {"auc": 0.5})
    p = lambda x: x.select("customer_id", vector_to_array("probability")[1].alias("p"))
    both = p(m.transform(d)).join(p(M.load_model(path).transform(d)).withColumnRenamed("p", "q"), "customer_id")
    return both.agg(F.count("*").alias("n"), F.min(F.abs(F.col("p") - F.col("q")) < 1e-12).alias("same"))


@query("SELECT count(*) AS n, TRUE AS same FROM cf", CF)
def R6_record_scoring(spark, sf):
    """Records scored in micro-batches are scored as the batch scores them."""
    d, m = _fitted(spark, sf)
    at = _folder(spark)
    d.write.parquet(f"{at}/in")
    streams.score_stream(spark.readStream.schema(d.schema).parquet(f"{at}/in"), m, "customer_id", 0.5, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    both = R.predict_batch(m, d, "customer_id", 0.5).join(spark.read.parquet(f"{at}/out").select("customer_id", F.col("probability").alias("q"), F.col("risk").alias("r")), "customer_id")
    return both.agg(F.count("*").alias("n"), F.min((F.abs(F.col("probability") - F.col("q")) < 1e-12) & (F.col("risk") == F.col("r"))).alias("same"))


@query()
def M18_driver_ranking(spark, sf):
    _, m = _fitted(spark, sf)
    return M.importances(m.stages[-1], ["n_orders", "tenure_months"], spark)


@query("SELECT ab_group, count(*) AS n FROM exp GROUP BY 1", EXP)
def A2_exposure_stream(spark, sf):
    at = _folder(spark)
    views.exposures(spark, sf).select("id", "customer_id", "ab_group", "event", "ts").write.json(f"{at}/in")
    streams.log_exposures(streams.read_exposures(spark, f"{at}/in"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("ab_group").agg(F.count("*").alias("n"))


@query("SELECT customer_id, arg_min(ab_group, (ts, id)) AS ab_group FROM exp GROUP BY 1", EXP)
def A3_first_exposure_stream(spark, sf):
    """Three batches, the latest exposures first: each customer's first one is found however late it comes."""
    at = _folder(spark)
    e = views.exposures(spark, sf).select("id", "customer_id", "ab_group", "event", "ts")
    for k in (2, 1, 0):
        e.where(F.dayofmonth("ts") % 3 == k).coalesce(1).write.mode("append").json(f"{at}/in")
        streams.first_exposures(streams.read_exposures(spark, f"{at}/in"), f"{at}/first", f"{at}/checkpoint").awaitTermination()
    return keyed.read(spark, f"{at}/first").select("customer_id", "ab_group")


_LATEST = "SELECT user_id, max(event_id) AS event_id, CAST(arg_max(date, event_id) AS VARCHAR) AS date FROM land GROUP BY 1"


@query(_LATEST, ("land",))
def I3_partition_merge(spark, sf):
    """A table by date into which later and earlier events are merged: the latest event of each user."""
    path = f"{_folder(spark)}/latest"
    e = views.landing(spark, sf).select("user_id", "event_id", "date")
    for part in ("event_id % 3 = 0", "event_id % 3 = 2", "event_id % 3 > 0", "event_id % 3 = 2"):
        I.merge_partitions(e.where(part), path, "user_id", "event_id", "date")
    return spark.read.parquet(path).select("user_id", "event_id", F.col("date").cast("string").alias("date"))


@query("SELECT user_id, max(event_id) AS event_id, CAST(arg_max(date, event_id) AS VARCHAR) AS date FROM land WHERE event_id % 7 > 0 GROUP BY 1", ("land",))
def I6_incremental_load(spark, sf):
    """Files that arrive in three runs of a stream, cleaned and merged into the partitions that change."""
    at = _folder(spark)
    e = views.landing(spark, sf).select("user_id", "event_id", "date")
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).coalesce(2).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        streams.incremental_load(stream, f"{at}/latest", f"{at}/checkpoint", "user_id", "event_id", "date", lambda df: df.where("event_id % 7 > 0")).awaitTermination()
    return spark.read.parquet(f"{at}/latest").select("user_id", "event_id", F.col("date").cast("string").alias("date"))


@query(f"+ {_FEATURES} SELECT 'd' AS dataset_id, feature, round(psi, 6) AS psi FROM f")
def D7_drift_history(spark, sf):
    """Two runs are appended; the last one's rows come back."""
    path = f"{_folder(spark)}/history"
    D.history_rows(D.report(*_halves(spark, sf), ["value"], []), "d", "2024-02-01 00:00:00").write.parquet(path)
    D.history_rows(D.report(*_shifted(spark, sf), ["value"], ["event_type"]), "d", "2024-02-02 00:00:00").write.mode("append").parquet(path)
    return D.latest_run(spark.read.parquet(path)).select("dataset_id", "feature", r6("psi"))


@query(f"+ {_FEATURES} SELECT 'd' AS dataset_id, feature, round(psi, 6) AS psi, CAST((SELECT count(*) FILTER (drifted) > 0 FROM g) AS BIGINT) AS requests FROM f")
def D8_drift_loop(spark, sf):
    """One micro-batch of shifted rows against the reference: its features in the history, and the requests to retrain."""
    a, b = _shifted(spark, sf)
    at = _folder(spark)
    b.coalesce(1).write.parquet(f"{at}/in")
    streams.drift_loop(spark.readStream.schema(b.schema).parquet(f"{at}/in"), a, ["value"], ["event_type"], f"{at}/history", f"{at}/requests", f"{at}/checkpoint").awaitTermination()
    n = spark.read.parquet(f"{at}/requests").groupBy("dataset_id").agg(F.count("*").alias("requests")) if keyed.exists(spark, f"{at}/requests") else spark.createDataFrame([("d", 0)], "dataset_id string, requests long")
    return spark.read.parquet(f"{at}/history").select("dataset_id", "feature", r6("psi")).join(n, "dataset_id")
