"""Queries of profiling, composite scores, features, modelling, scoring, drift, experiments, exploration, ledger and coresets."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import composite as K
from ..operators import coreset as CS
from ..operators import drift as D
from ..operators import experiments as A
from ..operators import explore as E
from ..operators import features as FT
from ..operators import ledger as L
from ..operators import modelling as M
from ..operators import profiling as T
from ..operators import scoring as R
from ..operators import search as SE
from ..session import released, written
from . import views
from .queries_tables import CF, bin_of, cf, quantile_sql, r6
from .registry import query

JOBS, ASG, EXP = ("jobs",), ("cf", "asg"), ("exp",)
NOW = "2001-07-31 12:00:00"


def line(spark, sf):
    return views.table(spark, sf, "lineitem")


def events(spark, sf):
    return views.table(spark, sf, "events")


# Profiling on lineitem, whose answer is known: the line status is the best target.

LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_KIND = dict(zip(LINE, ("int64",) * 4 + ("float64",) * 4 + ("object", "object", "datetime64")))


def _profile_sql() -> str:
    each = " UNION ALL ".join(
        f"SELECT {i} AS column_index, '{c}' AS column_name, '{_KIND[c]}' AS dtype, count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS u, (SELECT CASE WHEN count(*) > 1 THEN (ln(sum(m)) - sum(m * ln(m)) / sum(m)) / ln(count(*)) ELSE 0 END FROM (SELECT count(*) AS m FROM lineitem GROUP BY {c})) AS entropy FROM lineitem"
        for i, c in enumerate(LINE)
    )
    role = "CASE WHEN u <= 1 THEN 'IGNORE' WHEN u / k > 0.9 AND dtype IN ('object', 'int64') THEN 'ID' WHEN dtype IN ('int64', 'float64') THEN CASE WHEN u <= 15 THEN 'CATEGORICAL' ELSE 'NUMERIC' END WHEN dtype = 'datetime64' THEN 'DATETIME' ELSE 'CATEGORICAL' END"
    keyword = "(" + " OR ".join(f"contains(column_name, '{w}')" for w in T.KEYWORDS) + ")"
    score = f"""CASE WHEN u < 2 OR role = 'IGNORE' THEN 0 ELSE round((CASE WHEN u = 2 THEN 1.0 WHEN u BETWEEN 3 AND 5 THEN 0.5 ELSE 0 END)
      + CASE WHEN entropy > 0 AND entropy <= 0.5 THEN 0.2 WHEN entropy > 0.5 AND entropy <= 0.75 THEN 0.6 WHEN entropy > 0.75 AND entropy <= 0.95 THEN 0.8 ELSE 0 END
      + CASE WHEN column_index >= 9 THEN 0.15 WHEN column_index < 2 THEN 0.05 ELSE 0 END + CASE WHEN {keyword} THEN 0.5 ELSE 0 END
      + CASE WHEN {keyword} AND entropy > 0 AND entropy <= 0.5 THEN 0.2 ELSE 0 END, 6) END"""
    return f"+ p AS ({each}), q AS (SELECT *, {role} AS role FROM p), s AS (SELECT *, CAST({score} AS DOUBLE) AS target_score FROM q)"


_P = _profile_sql()


def _profiles(spark, sf):
    df = line(spark, sf).select(*LINE)
    p = T.base_roles(T.column_profiles(df))
    return T.target_scores(p.join(T.entropies(df), "column_name", "left"))


@query(f"{_P} SELECT column_name, dtype, k AS non_null FROM s")
def T1_dtypes(spark, sf):
    return T.column_profiles(line(spark, sf).select(*LINE)).select("column_name", "dtype", "non_null")


@query(f"{_P} SELECT column_name, round((n - k) / n, 6) AS null_pct, u AS unique_count, round(u / k, 6) AS cardinality_ratio FROM s")
def T2_cardinality(spark, sf):
    return T.column_profiles(line(spark, sf).select(*LINE)).select("column_name", r6("null_pct"), "unique_count", r6("cardinality_ratio"))


@query(f"{_P} SELECT column_name, round(entropy, 6) AS entropy FROM s")
def T3_entropy(spark, sf):
    return T.entropies(line(spark, sf), LINE).select("column_name", r6("entropy"))


@query(f"{_P} SELECT column_name, role FROM s")
def T4_base_roles(spark, sf):
    return T.base_roles(T.column_profiles(line(spark, sf).select(*LINE))).select("column_name", "role")


_MOMENTS = ("l_quantity", "l_extendedprice", "l_discount")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5), 4) AS skewness, round(avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3, 4) AS kurtosis FROM (SELECT {c} AS x, avg({c}) OVER () AS m FROM lineitem)" for c in _MOMENTS))
def T5_moments(spark, sf):
    return T.column_profiles(line(spark, sf).select(*_MOMENTS)).select("column_name", F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"))


@query(
    """SELECT 'url' AS column_name, round(avg(length(url)), 6) AS mean_length, round(avg(CASE WHEN regexp_matches(lower(url), '^(https?://|www\\.)\\S+$') THEN 1.0 ELSE 0 END), 6) AS url_rate, 'IGNORE' AS role FROM pages
    UNION ALL SELECT 'html', round(avg(length(html)), 6), round(avg(CASE WHEN regexp_matches(lower(html), '^(https?://|www\\.)\\S+$') THEN 1.0 ELSE 0 END), 6), 'TEXT' FROM pages"""
)
def T6_semantic_roles(spark, sf):
    p = T.semantic_roles(T.base_roles(T.column_profiles(views.table(spark, sf, "pages").select("url", "html"))))
    return p.select("column_name", r6("mean_length"), r6("url_rate"), "role")


@query(f"{_P} SELECT column_name, role, CASE role WHEN 'NUMERIC' THEN 'median' WHEN 'CATEGORICAL' THEN 'most_frequent' WHEN 'DATETIME' THEN 'passthrough' ELSE 'drop' END AS impute, CASE role WHEN 'NUMERIC' THEN 'standard' WHEN 'CATEGORICAL' THEN 'onehot' WHEN 'DATETIME' THEN 'cyclical' ELSE 'drop' END AS transform FROM s")
def T7_recipes(spark, sf):
    return T.recipes(T.base_roles(T.column_profiles(line(spark, sf).select(*LINE)))).select("column_name", "role", "impute", "transform")


@query(f"{_P} SELECT column_name, round(target_score, 6) AS target_score FROM s")
def T8_target_scores(spark, sf):
    return _profiles(spark, sf).select("column_name", r6("target_score"))


@query(f"{_P} SELECT column_name, rank, target_score >= 1 AND rank = 1 AS recommended FROM (SELECT *, CAST(row_number() OVER (ORDER BY target_score DESC, column_index) AS INTEGER) AS rank FROM s) WHERE rank <= 3")
def T9_ranked_candidates(spark, sf):
    return T.ranked_candidates(_profiles(spark, sf)).select("column_name", "rank", "recommended")


_NUM = ("n_orders", "total_spend", "avg_value", "recency_days", "balance")
_ASSOC = " UNION ALL ".join(f"SELECT '{c}' AS column_name, coalesce(abs(corr(churned, {c})), 0) AS association FROM cf" for c in _NUM)


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(coalesce(abs(corr(churned, {c})), 0), 6) AS association FROM cf" for c in _NUM), CF)
def T10_numeric_association(spark, sf):
    return T.numeric_association(cf(spark, sf), "churned", _NUM).select("column_name", r6("association"))


def _cramers(x: str, y: str, table: str) -> str:
    return f"""SELECT '{x}' AS column_name, CASE WHEN least(kr - pow(kr - 1, 2) / (n - 1), kc - pow(kc - 1, 2) / (n - 1)) - 1 > 0 THEN sqrt(greatest(0, s - 1 - (kr - 1) * (kc - 1) / (n - 1)) / (least(kr - pow(kr - 1, 2) / (n - 1), kc - pow(kc - 1, 2) / (n - 1)) - 1)) ELSE 0 END AS v
    FROM (SELECT sum(o * o / (CAST(r AS DOUBLE) * c)) AS s, max(n) AS n, count(DISTINCT x) AS kr, count(DISTINCT y) AS kc FROM (SELECT x, y, o, sum(o) OVER (PARTITION BY x) AS r, sum(o) OVER (PARTITION BY y) AS c, sum(o) OVER () AS n FROM (SELECT {x} AS x, {y} AS y, count(*) AS o FROM {table} GROUP BY 1, 2)))"""


_CATS = ("l_returnflag", "l_linenumber", "l_tax")


@query("SELECT column_name, round(v, 6) AS association FROM (" + " UNION ALL ".join(_cramers(x, "l_linestatus", "lineitem") for x in _CATS) + ")")
def T11_cramers_v(spark, sf):
    return T.cramers_v(line(spark, sf), "l_linestatus", _CATS).select("column_name", r6("association"))


# A copy of the target in other words, and one that is nearly it.
def _leaky(spark, sf):
    s = F.col("l_linestatus")
    return line(spark, sf).select("l_linestatus", "l_returnflag", F.when(s == "O", "open").otherwise("filled").alias("status_copy"), F.when(F.col("l_orderkey") % 10 < 4, "unknown").when(s == "O", "open").otherwise("filled").alias("status_part"), F.when((F.col("l_orderkey") % 65) == 0, "open").when(s == "O", "open").otherwise("filled").alias("status_near"))


_LEAKY = """leaky AS (SELECT l_linestatus, l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'filled' END AS status_copy, CASE WHEN l_orderkey % 10 < 4 THEN 'unknown' WHEN l_linestatus = 'O' THEN 'open' ELSE 'filled' END AS status_part,
 CASE WHEN l_orderkey % 65 = 0 THEN 'open' WHEN l_linestatus = 'O' THEN 'open' ELSE 'filled' END AS status_near FROM lineitem), a AS (""" + " UNION ALL ".join(_cramers(x, "l_linestatus", "leaky") for x in ("l_returnflag", "status_copy", "status_part", "status_near")) + ")"


def _leaky_assoc(spark, sf):
    df = _leaky(spark, sf)
    p = T.semantic_roles(T.base_roles(T.column_profiles(df)))
    return T.associations(df, p, "l_linestatus"), p


@query(f"+ {_LEAKY} SELECT column_name, round(v, 6) AS association FROM a WHERE v > 0.95")
def T12_leakage(spark, sf):
    return T.leaking(*_leaky_assoc(spark, sf)).select("column_name", r6("association"))


@query(f"+ {_LEAKY} SELECT column_name, CASE WHEN v > 0.98 THEN 'DUPLICATE' WHEN v > 0.95 THEN 'LEAKAGE_SUSPECT' ELSE 'AUXILIARY' END AS group_role FROM a WHERE v >= 0.5")
def T13_group_roles(spark, sf):
    return T.group_roles(*_leaky_assoc(spark, sf)).select("column_name", "group_role")


@query()
def T14_run_profiling(spark, sf):
    return T.run_profiling(line(spark, sf))[0]


@query()
def T15_confirmed_target(spark, sf):
    df = _leaky(spark, sf)
    return T.recipes(T.with_target(df, T.target_scores(T.semantic_roles(T.base_roles(T.column_profiles(df))).join(T.entropies(df), "column_name", "left")), "l_linestatus"))


_DROPPED = " UNION ALL ".join(f"SELECT '{n}' AS c, count(DISTINCT {x}) AS u, count({x}) AS k, {whole} AS countable FROM orders" for n, x, whole in (("o_orderkey", "o_orderkey", True), ("o_orderstatus", "o_orderstatus", True), ("o_totalprice", "o_totalprice", False), ("l_const", "'x'", True)))


@query(f"+ p AS ({_DROPPED}), r AS (SELECT c, CASE WHEN u <= 1 THEN 'IGNORE' WHEN u / k > 0.9 AND countable THEN 'ID' END AS role FROM p) SELECT c AS column_name, 'Column ''' || c || ''' is dropped: role ' || role AS message FROM r WHERE role IS NOT NULL")
def T16_dropped_warnings(spark, sf):
    df = views.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit("x").alias("l_const"))
    return T.dropped_warnings(T.base_roles(T.column_profiles(df)))


@query()
def T18_detection_accuracy(spark, sf):
    tables = {"lineitem": (line(spark, sf).select(*LINE), "l_linestatus"), "customers": (cf(spark, sf), "churned"), "orders": (views.table(spark, sf, "orders"), "o_orderstatus")}
    found = spark.createDataFrame([(k, T.detect_target(df)) for k, (df, _) in tables.items()], "dataset string, detected string")
    return T.detection_accuracy(found, spark.createDataFrame([(k, t) for k, (_, t) in tables.items()], "dataset string, expected string"))


# Composite scores


@query()
def K1_pca_score(spark, sf):
    df = cf(spark, sf)
    f = K.pca_score(df, ["n_orders", "total_spend", "tenure_months"], "churned")
    return df.select("customer_id", F.round(f.column(), 6).alias("score"))


@query(
    """+ w AS (SELECT *, (0.5 * (n_orders - nlo) / (nhi - nlo) - 0.3 * (balance - bm) / bs + 0.2 * (CASE segment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END) / 4.0) / 1.0 AS s
      FROM cf, (SELECT min(n_orders) AS nlo, max(n_orders) AS nhi, avg(balance) AS bm, stddev_pop(balance) AS bs FROM cf))
    SELECT customer_id, round((s - lo) / (hi - lo), 6) AS score FROM w, (SELECT min(s) AS lo, max(s) AS hi FROM w)""",
    CF,
)
def K2_weighted_score(spark, sf):
    df = cf(spark, sf)
    f = K.weighted_score(df, [K.Weight("n_orders", 0.5), K.Weight("balance", -0.3, "zscore"), K.Weight("segment", 0.2, "binary_encode"), K.Weight("missing", 1.0)])
    return df.select("customer_id", F.round(f.column(), 6).alias("score"))


@query("SELECT 'minmax' AS method, column_name, round(association, 6) AS weight FROM (" + _ASSOC + ")", CF)
def K3_auto_weights(spark, sf):
    w = K.auto_weights(T.numeric_association(cf(spark, sf), "churned", _NUM), _NUM)
    return spark.createDataFrame([(x.method, x.column, x.weight) for x in w], "method string, column_name string, weight double").select("method", "column_name", r6("weight"))


@query()
def K5_confirmed_score(spark, sf):
    df = cf(spark, sf)
    group = spark.createDataFrame([(c, 0.6, "AUXILIARY") for c in ("n_orders", "total_spend")], "column_name string, association double, group_role string")
    return K.confirm(df, group, "churned")[0]


# Features


@query("SELECT customer_id, round(coalesce(avg_value, (SELECT median(avg_value) FROM cf)), 6) AS avg_value, coalesce(seg, (SELECT seg FROM (SELECT CASE WHEN customer_id % 7 > 0 THEN segment END AS seg FROM cf) WHERE seg IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, seg LIMIT 1)) AS seg FROM (SELECT *, CASE WHEN customer_id % 7 > 0 THEN segment END AS seg FROM cf)", CF)
def F1_impute(spark, sf):
    df = cf(spark, sf).withColumn("seg", F.when(F.col("customer_id") % 7 > 0, F.col("segment")))
    return FT.impute(FT.impute(df, ["avg_value"], "median"), ["seg"], "most_frequent").select("customer_id", r6("avg_value"), "seg")


@query("SELECT customer_id, round(least(greatest(balance, lo), hi), 6) AS balance FROM cf, (SELECT quantile_cont(balance, 0.01) AS lo, quantile_cont(balance, 0.99) AS hi FROM cf)", CF)
def F2_winsorize(spark, sf):
    return FT.winsorize(cf(spark, sf), "balance").select("customer_id", r6("balance"))


@query("SELECT customer_id, round((balance - (SELECT avg(balance) FROM cf)) / (SELECT stddev_pop(balance) FROM cf), 6) AS balance FROM cf", CF)
def F3_standard_scale(spark, sf):
    return FT.standard_scale(cf(spark, sf), "balance").select("customer_id", r6("balance"))


@query("SELECT customer_id, round(ln(1 + n_orders), 6) AS log_orders FROM cf", CF)
def F4_log(spark, sf):
    return cf(spark, sf).select("customer_id", F.round(C.log_transform("n_orders"), 6).alias("log_orders"))


@query()
def F5_power(spark, sf):
    return FT.power_transform(cf(spark, sf), "total_spend", "power").select("customer_id", r6("power"))


@query("+ c AS (SELECT nation AS v, count(*) AS n FROM cf GROUP BY 1), k AS (SELECT list(CAST(v AS VARCHAR)) AS kept FROM (SELECT v FROM c WHERE n >= 0.01 * (SELECT count(*) FROM cf) ORDER BY n DESC, CAST(v AS VARCHAR) LIMIT 9)) SELECT customer_id, CASE WHEN list_contains(kept, CAST(nation AS VARCHAR)) THEN 0 ELSE 1 END AS nation_infrequent FROM cf, k", CF)
def F6_onehot(spark, sf):
    return FT.onehot(cf(spark, sf), "nation").select("customer_id", "nation_infrequent")


@query("SELECT customer_id, CASE segment WHEN 'AUTOMOBILE' THEN -1 ELSE CAST(dense_rank() OVER (ORDER BY CASE WHEN segment = 'AUTOMOBILE' THEN '' ELSE segment END) - 2 AS INTEGER) END AS code FROM cf", CF)
def F7_ordinal(spark, sf):
    df = cf(spark, sf)
    return FT.ordinal(df.where("segment <> 'AUTOMOBILE'"), df, "segment", "code").select("customer_id", "code")


_STOP = "[" + ", ".join(f"'{w}'" for w in FT.STOP_WORDS) + "]"


@query(
    f"""+ w AS (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}'), lambda t: NOT list_contains({_STOP}, t))) AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
    v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 100), x AS (SELECT item_id, term, tf * idf AS w FROM tf JOIN v USING (term))
    SELECT item_id AS ident, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM x"""
)
def F8_tfidf(spark, sf):
    return FT.tfidf(views.table(spark, sf, "benchmark"), "item_id", "text").select("ident", "term", r6("weight"))


@query("SELECT event_id, round(sin(month(ts) * 2 * pi() / 12), 6) AS month_sin, round(cos((isodow(ts) - 1) * 2 * pi() / 7), 6) AS weekday_cos, round(sin(hour(ts) * 2 * pi() / 24), 6) AS hour_sin FROM events")
def F9_cyclical(spark, sf):
    c = FT.cyclical("ts")
    return events(spark, sf).select("event_id", *[F.round(c[f"ts_{n}"], 6).alias(n) for n in ("month_sin", "weekday_cos", "hour_sin")])


@query("SELECT customer_id, round(balance / (tenure_months + 1), 6) AS charge_per_tenure, round(total_spend / (balance * tenure_months + 1), 6) AS total_to_expected FROM cf", CF)
def F12_telco_features(spark, sf):
    return FT.telco_features(cf(spark, sf), "balance", "total_spend", "tenure_months").select("customer_id", r6("charge_per_tenure"), r6("total_to_expected"))


@query("SELECT customer_id, round(balance / (total_spend + 1), 6) AS balance_to_salary, round(n_orders / (tenure_months + 1), 6) AS products_per_tenure, round(avg_value / (nation + 1), 4) AS score_to_age, churned * nation AS active_by_age FROM cf", CF)
def F13_bank_features(spark, sf):
    return FT.bank_features(cf(spark, sf), "balance", "total_spend", "n_orders", "tenure_months", "avg_value", "nation", "churned").select("customer_id", r6("balance_to_salary"), r6("products_per_tenure"), F.round("score_to_age", 4).alias("score_to_age"), "active_by_age")


@query("SELECT customer_id, round(ln(1 + abs(n_orders)), 6) AS n_orders_log, round(ln(1 + abs(recency_days)), 6) AS recency_days_log FROM cf", CF)
def F14_generic_features(spark, sf):
    return FT.generic_features(cf(spark, sf), _NUM, "churned").select("customer_id", r6("n_orders_log"), r6("recency_days_log"))


@query()
def F15_table_hash(spark, sf):
    return FT.table_hash(line(spark, sf))


# Modelling


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label FROM lineitem")
def M1_label_encode(spark, sf):
    return M.label_encode(line(spark, sf), "l_linestatus").select("l_orderkey", "l_linenumber", "label")


def _unit_sql(ident: str, seed: int) -> str:
    return f"(('0x' || substr(sha256(CAST({ident} AS VARCHAR) || ':{seed}'), 1, 13))::UBIGINT / {16**13}.0::DOUBLE)"


@query(f"+ h AS (SELECT customer_id, churned, {_unit_sql('customer_id', 42)} AS h FROM cf), q AS (SELECT churned, quantile_cont(h, 0.2) AS cut FROM h GROUP BY 1) SELECT customer_id, h.churned, h < cut AS is_test FROM h JOIN q USING (churned)", CF)
def M2_stratified_split(spark, sf):
    return M.stratified_split(cf(spark, sf), "customer_id", "churned").select("customer_id", "churned", "is_test")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p / n BETWEEN 0.25 AND 0.75 THEN 1.0 ELSE round(n / (2 * CASE WHEN y = 1 THEN p ELSE n - p END), 6) END AS weight FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS y FROM lineitem), (SELECT count(*) AS n, count(*) FILTER (l_linenumber = 7) AS p FROM lineitem)")
def M3_class_weights(spark, sf):
    d = line(spark, sf).select("l_orderkey", "l_linenumber", (F.col("l_linenumber") == 7).cast("int").alias("y"))
    return M.class_weights(d, "y").select("l_orderkey", "l_linenumber", r6("weight"))


def _rare(spark, sf):
    return cf(spark, sf).withColumn("y", (F.col("n_orders") >= 14).cast("int"))


@query()
def M4_oversample(spark, sf):
    return M.oversample(_rare(spark, sf), "customer_id", "y")


@query()
def M5_smote(spark, sf):
    return M.smote(_rare(spark, sf), "customer_id", ["balance", "total_spend"], "y", ["segment"])


def _vector(spark, sf, customers=None):
    """Customers as feature vectors: what was bought before the snapshot, to predict churn."""
    cols = ["balance", "n_orders", "total_spend", "tenure_months"]
    d = (customers or cf(spark, sf)).withColumns({c: F.col(c).cast("double") for c in cols}).withColumn("label", F.col("churned"))
    s = d.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    d = d.withColumns({f"z_{c}": (F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] or 1.0) for c in cols})
    return VectorAssembler(inputCols=[f"z_{c}" for c in cols], outputCol="features").transform(d)


_LEARNERS = ("linear", "forest", "boosted")


def _searched(spark, sf):
    """The customers, written once, the table with folds, and the search of its whole budget over three learners in five folds."""
    customers = written(cf(spark, sf).select("customer_id", "balance", "n_orders", "total_spend", "tenure_months", "churned"))
    d = M.folds(_vector(spark, sf, customers), "customer_id", "label").select("customer_id", "features", "label", "fold")
    return customers, d, SE.search(d, "customer_id", _LEARNERS, M.trial_budget(d.count()))


@query()
def M7_search(spark, sf):
    customers, _, found = _searched(spark, sf)
    released(customers)
    return found.table(spark)


@query()
def M8_stack(spark, sf):
    """The best of three stackings of the three best trials' scores without each row's fold."""
    customers, d, found = _searched(spark, sf)
    best = found.ranked()[:3]
    oof = written(found.scores(d, best, "fold"))
    rows = [("stack", float(M.stack(oof, [t.number for t in best])[1])), *[(f"{t.learner} {t.number}", t.auc) for t in best]]
    released(customers, oof)
    return spark.createDataFrame(rows, "model string, auc double")


def _scored(spark, sf):
    d = _vector(spark, sf)
    m = M.slim(LogisticRegression(maxIter=20).fit(d))
    return d, m, m.transform(d).withColumn("score", vector_to_array("probability")[1])


@query()
def M9_calibrate(spark, sf):
    d = M.stratified_split(_scored(spark, sf)[2].select("customer_id", "score", "label"), "customer_id", "label", 0.5)
    return M.calibrate(d.where("is_test"), d.where("not is_test"), "score")[2].select("customer_id", "score", "calibrated")


# A score without a model for the exact checks: how long ago the last order was.
_CURVE = "SELECT coalesce(recency_days, 0) % 400 AS score, churned AS y, customer_id FROM cf"


def _curve(spark, sf):
    return cf(spark, sf).select("customer_id", (F.coalesce("recency_days", F.lit(0)) % 400).alias("score"), F.col("churned").alias("y"))


@query(f"+ c AS ({_CURVE}), g AS (SELECT score, sum(y) AS p, count(*) AS n FROM c GROUP BY 1), k AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER () AS ap FROM g), f AS (SELECT score, round(2.0 * (cp / cn) * (cp / ap) / ((cp / cn) + (cp / ap) + 1e-9), 12) AS f1 FROM k) SELECT score AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, score LIMIT 1", CF)
def M10_best_threshold(spark, sf):
    return M.best_threshold(_curve(spark, sf), "score", "y").select("threshold", r6("f1"))


@query(f"+ c AS ({_CURVE}), r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM c) SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * CAST(count(*) FILTER (y = 0) AS DOUBLE)), 6) AS auc FROM r", CF)
def M11_roc_auc(spark, sf):
    return M.roc_auc(_curve(spark, sf), "score", "y").select(r6("auc"))


_TOP = f"c AS ({_CURVE}), t AS (SELECT * FROM c ORDER BY score DESC, customer_id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) FROM c)), m AS (SELECT count(*) AS k, avg(CAST(y AS DOUBLE)) AS p FROM t)"


@query(f"+ {_TOP} SELECT k, round(p, 6) AS precision_at_k FROM m", CF)
def M12_precision_at_k(spark, sf):
    return M.precision_at_k(_curve(spark, sf), "score", "y", "customer_id").select("k", r6("precision_at_k"))


@query(f"+ {_TOP}, v AS (SELECT avg(total_spend) AS v FROM cf) SELECT k, round(p * k * 0.3 * v, 4) AS benefit, k * 5.0::DOUBLE AS cost, round((p * k * 0.3 * v - k * 5.0) / greatest(1, k * 5.0), 4) AS roi FROM m, v", CF)
def M13_campaign_roi(spark, sf):
    v = cf(spark, sf).agg(F.avg("total_spend")).first()[0]
    return M.campaign_roi(M.precision_at_k(_curve(spark, sf), "score", "y", "customer_id"), v).select("k", F.round("benefit", 4).alias("benefit"), "cost", F.round("roi", 4).alias("roi"))


@query()
def M14_offline_evaluation(spark, sf):
    df = cf(spark, sf)
    roles = [("balance", "NUMERIC"), ("n_orders", "NUMERIC"), ("total_spend", "NUMERIC"), ("segment", "CATEGORICAL")]
    pipe = FT.feature_pipeline(df, [{"column_name": c, "role": r} for c, r in roles], "churned")
    return M.roc_auc(M.evaluate_logistic(df, pipe, "customer_id", "churned")[1], "score", "churned")


@query()
def M15_importances(spark, sf):
    d, m, _ = _scored(spark, sf)
    return M.importances(m, M.vector_names(d), spark)


@query()
def M16_permutation_importance(spark, sf):
    d, m, _ = _scored(spark, sf)
    cols = ["z_balance", "z_n_orders"]
    from pyspark.ml import PipelineModel

    va = VectorAssembler(inputCols=["z_balance", "z_n_orders", "z_total_spend", "z_tenure_months"], outputCol="features")
    return M.permutation_importance(PipelineModel(stages=[va, m]), d.drop("features"), cols, "customer_id", "label")


@query()
def M17_two_target(spark, sf):
    d = _vector(spark, sf)
    return M.two_target(C.min_max(d, "avg_value", "cpi").fillna(0.0, ["cpi"]).drop("prediction"), "label", "cpi")[2]


@query("SELECT o_orderpriority AS scenario, round(avg((a - b) / a), 6) AS mean_rate, round(stddev_pop((a - b) / a), 6) AS std_rate, count(*) AS seeds FROM (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS a, avg(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS b FROM orders GROUP BY 1, 2) GROUP BY 1")
def M19_forgetting(spark, sf):
    o = views.table(spark, sf, "orders")
    old = F.to_date("o_orderdate") < F.lit("1998-01-01").cast("date")
    runs = o.groupBy(F.col("o_orderpriority").alias("scenario"), "o_orderstatus").agg(F.avg(F.when(old, F.col("o_totalprice"))).alias("before"), F.avg(F.when(~old, F.col("o_totalprice"))).alias("after"))
    return M.forgetting(runs).select("scenario", r6("mean_rate"), r6("std_rate"), "seeds")


# Scoring


@query()
def R1_predict_batch(spark, sf):
    d, m, _ = _scored(spark, sf)
    return R.predict_batch(m, d, "customer_id", 0.5)


_RISK = "CASE WHEN p >= least(0.4::DOUBLE * 1.5::DOUBLE, 0.85::DOUBLE) THEN 'High' WHEN p >= 0.4::DOUBLE THEN 'Medium' ELSE 'Low' END"


def _risky(spark, sf):
    return cf(spark, sf).select("customer_id", (F.col("customer_id") % 101 / 100.0).alias("p")).withColumn("risk", R.classify_risk("p", 0.4))


@query(f"SELECT customer_id, {_RISK} AS risk FROM (SELECT customer_id, customer_id % 101 / 100.0::DOUBLE AS p FROM cf)", CF)
def R2_classify_risk(spark, sf):
    return _risky(spark, sf).select("customer_id", "risk")


@query(f"SELECT count(*) AS total, count(*) FILTER (r = 'High') AS high, count(*) FILTER (r = 'Medium') AS medium, count(*) FILTER (r = 'Low') AS low, 0.4::DOUBLE AS threshold, 'ledger' AS source FROM (SELECT {_RISK} AS r FROM (SELECT customer_id % 101 / 100.0::DOUBLE AS p FROM cf))", CF)
def R3_risk_summary(spark, sf):
    return R.risk_summary(_risky(spark, sf), 0.4, "ledger")


@query("SELECT job_id, coalesce(optimal_threshold, 0.5) AS threshold, CASE WHEN optimal_threshold IS NOT NULL THEN 'ledger' ELSE 'default' END AS threshold_source FROM jobs", JOBS)
def R4_optimal_threshold(spark, sf):
    return R.optimal_threshold(views.jobs(spark, sf)).select("job_id", "threshold", "threshold_source")


@query("SELECT dataset_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY is_active DESC, roc_auc DESC NULLS LAST, job_id) AS rn FROM jobs WHERE status = 'completed') WHERE rn = 1", JOBS)
def R5_active_models(spark, sf):
    return R.active_models(views.jobs(spark, sf)).select("dataset_id", "job_id")


# Drift: the first against the last ten days of events


def _halves(spark, sf):
    e = events(spark, sf).withColumn("d", F.to_date("ts"))
    return e.where("d < date'2024-01-11'"), e.where("d >= date'2024-01-21'")


_W = "a AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-11'), b AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-21')"
_PSI_SUM = "sum(((b + 1e-4) / (nb + 1e-4 * k) - (a + 1e-4) / (na + 1e-4 * k)) * ln(((b + 1e-4) / (nb + 1e-4 * k)) / ((a + 1e-4) / (na + 1e-4 * k))))"


def _psi_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, {_PSI_SUM} AS psi FROM (SELECT i.i, count(*) FILTER (s = 0 AND x IS NOT NULL) AS a, count(*) FILTER (s = 1 AND x IS NOT NULL) AS b, sum(count(*) FILTER (s = 0)) OVER () AS na, sum(count(*) FILTER (s = 1)) OVER () AS nb, count(*) OVER () AS k
      FROM (SELECT unnest(range(len(e) - 1)) AS i FROM (SELECT list_distinct(quantile_cont({c}, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1])) AS e FROM a)) i
      LEFT JOIN (SELECT s, x, len(list_filter(list_sort(e)[2:-2], lambda v: v <= x)) AS bin FROM (SELECT 0 AS s, {c} AS x FROM a UNION ALL SELECT 1, {c} FROM b), (SELECT list_distinct(quantile_cont({c}, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1])) AS e FROM a)) v ON v.bin = i.i GROUP BY i.i)"""


@query(f"+ {_W} SELECT feature, round(psi, 6) AS psi FROM ({_psi_sql('value')} UNION ALL {_psi_sql('user_id')})")
def D1_numerical_psi(spark, sf):
    return D.numerical_psi(*_halves(spark, sf), ["value", "user_id"]).select("feature", r6("psi"))


_CAT = "c AS (SELECT coalesce(x.v, y.v) AS v, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT event_type AS v, count(*) AS a FROM a GROUP BY 1) x FULL JOIN (SELECT event_type AS v, count(*) AS b FROM b GROUP BY 1) y ON x.v = y.v), t AS (SELECT *, sum(a) OVER () AS na, sum(b) OVER () AS nb, count(*) OVER () AS k FROM c)"


@query(f"+ {_W}, {_CAT} SELECT 'event_type' AS feature, round({_PSI_SUM}, 6) AS psi FROM t")
def D2_categorical_psi(spark, sf):
    return D.categorical_psi(*_halves(spark, sf), ["event_type"]).select("feature", r6("psi"))


_CHI = "sum(pow(o - e, 2) / e)"


@query(f"+ {_W}, {_CAT}, o AS (SELECT a + 1e-4 AS o, (na + 1e-4 * k) * (a + b + 2e-4) / (na + nb + 2e-4 * k) AS e FROM t UNION ALL SELECT b + 1e-4, (nb + 1e-4 * k) * (a + b + 2e-4) / (na + nb + 2e-4 * k) FROM t) SELECT 'event_type' AS feature, round({_CHI}, 6) AS statistic, count(*) // 2 - 1 AS dof FROM o")
def D3_categorical_chi2(spark, sf):
    return D.categorical_chi2(*_halves(spark, sf), ["event_type"]).select("feature", r6("statistic"), "dof")


_KS = f"{_W}, v AS (SELECT value AS x, 0 AS s FROM a UNION ALL SELECT value, 1 FROM b), f AS (SELECT x, sum(count(*) FILTER (s = 0)) OVER (ORDER BY x) / sum(count(*) FILTER (s = 0)) OVER () AS fa, sum(count(*) FILTER (s = 1)) OVER (ORDER BY x) / sum(count(*) FILTER (s = 1)) OVER () AS fb FROM v GROUP BY x)"


@query(f"+ {_KS} SELECT 'value' AS feature, round(max(abs(fa - fb)), 6) AS statistic, (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM b) AS m FROM f")
def D4_ks(spark, sf):
    return D.ks_statistic(*_halves(spark, sf), ["value"]).select("feature", r6("statistic"), "n", "m")


def _shifted(spark, sf):
    a, b = _halves(spark, sf)
    return a, b.withColumn("value", F.col("value") * 3).withColumn("event_type", F.when(F.col("event_id") % 2 == 0, "other").otherwise(F.col("event_type")))


#: A high stability index is a drift by itself, whatever the tests say.
_FEATURES = f"""a AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-11'), b AS (SELECT * REPLACE (value * 3 AS value, CASE WHEN event_id % 2 = 0 THEN 'other' ELSE event_type END AS event_type) FROM events WHERE ts >= TIMESTAMP '2024-01-21'), {_CAT},
    f AS (SELECT feature, 'numerical' AS type, psi FROM ({_psi_sql('value')}) UNION ALL SELECT 'event_type', 'categorical', {_PSI_SUM} FROM t),
    g AS (SELECT feature, type, CASE WHEN psi >= 0.2 THEN 'high' WHEN psi >= 0.1 THEN 'medium' ELSE 'low' END AS level, psi >= 0.2 AS drifted FROM f)"""


@query(f"+ {_FEATURES} SELECT feature, type, level, drifted FROM g")
def D5_report(spark, sf):
    return D.report(*_shifted(spark, sf), ["value"], ["event_type"]).select("feature", "type", "level", "drifted")


@query()
def D6_dataset_drift(spark, sf):
    ref, _ = _halves(spark, sf)
    return D.dataset_drift(ref, views.landing(spark, sf), "2024-01-25", ["value"], ["event_type"])


@query(f"+ {_FEATURES} SELECT count(*) FILTER (drifted) AS drifted_features, count(*) AS features, CASE WHEN count(*) FILTER (drifted) > 0.3 * count(*) THEN 'critical' WHEN bool_or(level = 'high') THEN 'high' WHEN bool_or(level = 'medium') THEN 'moderate' ELSE 'none' END AS overall FROM g")
def D9_overall(spark, sf):
    return D.overall(D.report(*_shifted(spark, sf), ["value"], ["event_type"])).select("drifted_features", "features", "overall")


# Experiments


@query("SELECT customer_id, ab_group FROM asg", ASG)
def A1_assign(spark, sf):
    return views.assignments(spark, sf).select("customer_id", "ab_group")


@query("SELECT customer_id, arg_min(ab_group, (ts, id)) AS ab_group FROM exp GROUP BY 1", EXP)
def A3_first_exposure(spark, sf):
    return A.first_exposure(views.exposures(spark, sf)).select("customer_id", "ab_group")


_GROUPS = "g AS (SELECT ab_group, count(*) AS n, CAST(sum(CASE WHEN n_orders > 0 THEN churned ELSE 0 END) AS BIGINT) AS successes, avg(CASE WHEN n_orders > 0 THEN churned ELSE 0 END) AS rate FROM asg GROUP BY 1)"


def _groups(spark, sf):
    a = views.assignments(spark, sf)
    return A.analyze(a.select("customer_id", "ab_group"), a.where("n_orders > 0").select("customer_id", F.col("churned").alias("churn")))


@query(f"+ {_GROUPS} SELECT ab_group, n, successes, round(rate, 6) AS rate FROM g", ASG)
def A4_analyze(spark, sf):
    return _groups(spark, sf).select("ab_group", "n", "successes", r6("rate"))


@query(f"+ {_GROUPS}, p AS (SELECT a.n AS na, b.n AS nb, a.rate AS ra, b.rate AS rb, (a.successes + b.successes) / (a.n + b.n) AS p FROM g a, g b WHERE a.ab_group = 'A' AND b.ab_group = 'B') SELECT round(rb - ra, 6) AS delta, round((rb - ra) / sqrt(p * (1 - p) * (1.0 / na + 1.0 / nb)), 6) AS z FROM p", ASG)
def A5_z_statistic(spark, sf):
    return A.z_statistic(_groups(spark, sf)).select(r6("delta"), r6("z"))


@query("SELECT segment, CAST(ceil(7.848879734349091 * 2 / pow(2 * asin(sqrt(least(1, rate + 0.02))) - 2 * asin(sqrt(rate)), 2)) AS BIGINT) AS n_a FROM (SELECT segment, avg(churned) AS rate FROM cf GROUP BY 1) WHERE rate < 0.97", CF)
def A6_sample_sizes(spark, sf):
    rates = E.segment_rate(cf(spark, sf), "segment", "churned").where("rate < 0.97")
    return A.sample_sizes(rates, 0.02).select("segment", "n_a")


@query("SELECT segment AS ab_group, count(*) AS n, CASE WHEN count(*) < 100000 THEN 'small' END AS problem FROM cf GROUP BY 1 HAVING count(*) < 100000", CF)
def A7_sanity(spark, sf):
    g = E.segment_rate(cf(spark, sf), "segment", "churned").select(F.col("segment").alias("ab_group"), "n", F.lit(0).alias("successes"))
    return A.sanity(g, 100_000)


# Exploration


@query("SELECT count(*) AS rows, (SELECT count(*) FROM (DESCRIBE lineitem)) AS columns FROM lineitem")
def E1_shape(spark, sf):
    return E.shape(line(spark, sf))


_DESC = ("l_quantity", "l_extendedprice")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM lineitem" for c in _DESC))
def E1_describe(spark, sf):
    return E.describe(line(spark, sf), _DESC).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM cf" for c in ("customer_id", "avg_value", "recency_days")), CF)
def E2_null_counts(spark, sf):
    return E.null_counts(cf(spark, sf).select("customer_id", "avg_value", "recency_days"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 20")
def E3_top_values(spark, sf):
    return E.top_values(line(spark, sf), "l_suppkey")


@query("SELECT l_returnflag, l_linestatus, n, round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS row_share FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def E4_crosstab(spark, sf):
    return E.crosstab(line(spark, sf), "l_returnflag", "l_linestatus").select("l_returnflag", "l_linestatus", "n", r6("row_share"))


@query("+ o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), x AS (SELECT o, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS c, sum(o) OVER () AS n FROM o) SELECT round(sum(pow(o - CAST(r AS DOUBLE) * c / n, 2) / (CAST(r AS DOUBLE) * c / n)), 4) AS statistic, CAST(2 AS BIGINT) AS dof FROM x")
def E5_chi2(spark, sf):
    return E.chi2(line(spark, sf), "l_returnflag", "l_linestatus").select(F.round("statistic", 4).alias("statistic"), F.col("dof").cast("long").alias("dof"))


@query("SELECT l_returnflag, count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean, median(l_extendedprice) AS median, round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem GROUP BY 1")
def E6_grouped_stats(spark, sf):
    return E.grouped_stats(line(spark, sf), "l_returnflag", "l_extendedprice").withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("+ m AS (SELECT count(x) FILTER (s = 'F') AS na, count(x) FILTER (s = 'O') AS nb, avg(x) FILTER (s = 'F') AS ma, avg(x) FILTER (s = 'O') AS mb, var_samp(x) FILTER (s = 'F') / count(x) FILTER (s = 'F') AS ea, var_samp(x) FILTER (s = 'O') / count(x) FILTER (s = 'O') AS eb FROM (SELECT o_totalprice AS x, o_orderstatus AS s FROM orders)) SELECT na, nb, round((ma - mb) / sqrt(ea + eb), 6) AS t, round(pow(ea + eb, 2) / (ea * ea / (na - 1) + eb * eb / (nb - 1)), 4) AS dof FROM m")
def E7_welch(spark, sf):
    return E.welch_t(views.table(spark, sf, "orders"), "o_orderstatus", "o_totalprice", "F", "O").select("na", "nb", r6("t"), F.round("dof", 4).alias("dof"))


@query("+ d AS (SELECT event_type AS g, value AS x FROM events WHERE event_type IN ('click', 'view')), r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM d), s AS (SELECT sum(rk) FILTER (g = 'click') AS ra, CAST(count(*) FILTER (g = 'click') AS DOUBLE) AS na, CAST(count(*) AS DOUBLE) AS n FROM r), t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM d GROUP BY x)) SELECT ra - na * (na + 1) / 2 AS u, round((ra - na * (na + 1) / 2 - na * (n - na) / 2) / sqrt(na * (n - na) / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM s, t")
def E8_mann_whitney(spark, sf):
    return E.mann_whitney(events(spark, sf), "event_type", "value", "click", "view").select(F.col("u").cast("double").alias("u"), r6("z"))


_PAIRS = [("balance", "n_orders"), ("balance", "total_spend"), ("balance", "avg_value"), ("n_orders", "total_spend"), ("n_orders", "avg_value"), ("total_spend", "avg_value")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM cf" for a, b in _PAIRS), CF)
def E9_correlations(spark, sf):
    return E.correlation_matrix(cf(spark, sf), ["balance", "n_orders", "total_spend", "avg_value"]).select("a", "b", r6("r"))


@query("SELECT o_orderstatus, CAST(least(floor((o_totalprice - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1, 2")
def E10_histogram(spark, sf):
    return E.histogram(views.table(spark, sf, "orders"), "o_totalprice", by="o_orderstatus")


@query("+ q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM events JOIN q USING (event_type) GROUP BY 1, q1, median, q3")
def E11_box_plot(spark, sf):
    return E.box_plot(events(spark, sf), "event_type", "value").select("event_type", r6("q1"), r6("median"), r6("q3"), "low", "high", "outliers")


_CELL = 100.0 / 512


@query(f"+ s AS (SELECT event_type, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h FROM events GROUP BY 1), c AS (SELECT event_type, floor(value / {_CELL}) AS cell, count(*) AS c FROM events GROUP BY 1, 2), g AS (SELECT unnest(range(50)) AS point) SELECT event_type, CAST(point AS INTEGER) AS point, round(sum(c * exp(-0.5 * pow((point * {100.0 / 49!r} - (cell + 0.5) * {_CELL}) / h, 2)) / (n * h * sqrt(2 * pi()))), 8) AS density FROM c JOIN s USING (event_type), g GROUP BY 1, 2")
def E12_density(spark, sf):
    return E.density(events(spark, sf), "event_type", "value", 0.0, 100.0).select("event_type", "point", F.round("density", 8).alias("density"))


_TEN = "CASE WHEN tenure_months <= 24 THEN 0 WHEN tenure_months <= 48 THEN 1 WHEN tenure_months <= 60 THEN 2 WHEN tenure_months <= 66 THEN 3 WHEN tenure_months <= 999 THEN 4 END"
_TEN_EDGES = (-1, 24, 48, 60, 66, 999)


def _tenure_and_spend(spark, sf):
    return C.quantile_bins(cf(spark, sf).withColumn("tenure_bin", C.fixed_bins("tenure_months", _TEN_EDGES)), "total_spend", "spend_bin")


@query(f"+ {quantile_sql('total_spend', 4)}, b AS (SELECT {_TEN} AS tenure_bin, {bin_of('total_spend', 4)} AS spend_bin, churned FROM cf, edges) SELECT tenure_bin, spend_bin, count(*) AS n, round(avg(churned), 6) AS rate FROM b WHERE tenure_bin IS NOT NULL AND spend_bin IS NOT NULL GROUP BY 1, 2", CF)
def E13_rate_pivot(spark, sf):
    return E.rate_pivot(_tenure_and_spend(spark, sf), "tenure_bin", "spend_bin", "churned").select("tenure_bin", "spend_bin", "n", r6("rate"))


@query(f"+ {quantile_sql('total_spend', 5)} SELECT {bin_of('total_spend', 5)} AS spend_bin, count(*) AS n, round(avg(churned), 6) AS rate FROM cf, edges GROUP BY 1", CF)
def E14_segment_rate(spark, sf):
    return E.segment_rate(C.quantile_bins(cf(spark, sf), "total_spend", "spend_bin", q=5, fill="median"), "spend_bin", "churned").select("spend_bin", "n", r6("rate"))


@query(f"+ {quantile_sql('total_spend', 4)}, b AS (SELECT segment, {bin_of('total_spend', 4)} AS spend_bin FROM cf, edges) SELECT segment, spend_bin, count(*) AS n FROM b GROUP BY 1, 2", CF)
def E15_reason_crosstab(spark, sf):
    return E.crosstab(C.quantile_bins(cf(spark, sf), "total_spend", "spend_bin", fill=0.0), "segment", "spend_bin").select("segment", "spend_bin", "n")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem")
def E16_trend(spark, sf):
    return E.trend(line(spark, sf), "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query("SELECT o_orderkey FROM orders ORDER BY sha256(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 1000")
def E17_seeded_sample(spark, sf):
    return E.seeded_sample(views.table(spark, sf, "orders"), "o_orderkey").select("o_orderkey")


@query("SELECT 'segment' AS column_name, segment AS value, count(*) AS n, round(avg(churned), 6) AS rate FROM cf GROUP BY 2 UNION ALL SELECT 'nation', CAST(nation AS VARCHAR), count(*), round(avg(churned), 6) FROM cf GROUP BY 2", CF)
def E18_rates_by_category(spark, sf):
    return E.rates_by_category(cf(spark, sf), ["segment", "nation"], "churned").select("column_name", "value", "n", r6("rate"))


# Ledger


@query(f"SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'training') AS running, count(*) FILTER (status = 'completed' AND finished_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS completed_24h, CAST(0 AS BIGINT) AS failed_24h, count(*) AS total FROM jobs", JOBS)
def L1_metrics(spark, sf):
    return L.metrics(views.jobs(spark, sf), NOW)


@query(f"+ j AS (SELECT * FROM jobs WHERE started_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'training') AS training, count(*) FILTER (status = 'queued') AS queued, (SELECT job_id FROM j WHERE roc_auc IS NOT NULL ORDER BY roc_auc DESC, job_id LIMIT 1) AS best_job_id, max(roc_auc) AS best_auc FROM j", JOBS)
def L2_summary(spark, sf):
    return L.summary(views.jobs(spark, sf), NOW)


@query("SELECT job_id, roc_auc FROM jobs WHERE dataset_id = 7 AND status = 'completed'", JOBS)
def L3_models(spark, sf):
    return L.models(views.jobs(spark, sf), 7).select("job_id", "roc_auc")


@query("SELECT job_id, CASE WHEN dataset_id = 7 THEN job_id = 5 ELSE is_active END AS is_active FROM jobs", JOBS)
def L4_promote(spark, sf):
    return L.promote(views.jobs(spark, sf), 7, 5)[0].select("job_id", "is_active")


@query("SELECT x.job_id AS job_a, y.job_id AS job_b, round(y.roc_auc - x.roc_auc, 4) AS delta, CASE WHEN abs(round(y.roc_auc - x.roc_auc, 4)) < 0.005 THEN 'tie' WHEN y.roc_auc > x.roc_auc THEN 'b' ELSE 'a' END AS winner FROM jobs x, jobs y WHERE x.job_id = 1 AND y.job_id = (SELECT max(job_id) FROM jobs WHERE status = 'completed')", JOBS)
def L5_compare(spark, sf):
    j = views.jobs(spark, sf)
    last = j.where("status = 'completed'").agg(F.max("job_id")).first()[0]
    return L.compare(j, 1, last).select("job_a", "job_b", "delta", "winner")


@query("SELECT job_id FROM jobs r WHERE status = 'queued' AND EXISTS (SELECT 1 FROM jobs d WHERE d.status = 'completed' AND d.roc_auc > 0.65 AND d.dataset_id = r.dataset_id AND d.target_column = r.target_column AND d.prior_model_uri IS NOT DISTINCT FROM r.prior_model_uri)", JOBS)
def L6_already_trained(spark, sf):
    j = views.jobs(spark, sf)
    return L.already_trained(j.where("status = 'queued'"), j).select("job_id")


@query("SELECT DISTINCT dataset_id FROM jobs WHERE status = 'completed'", JOBS)
def L7_trained_datasets(spark, sf):
    return L.trained_datasets(views.jobs(spark, sf))


@query("SELECT job_id, dataset_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY started_at DESC, job_id DESC) AS rn FROM jobs) WHERE rn > 5", JOBS)
def L8_surplus_runs(spark, sf):
    return L.surplus_runs(views.jobs(spark, sf)).select("job_id", "dataset_id")


@query("+ s AS (SELECT list_sort(list(value)) AS v, count(value) AS n, median(value) AS p50, avg(value) AS mean, sum(value) AS total FROM events) SELECT n, round(p50, 6) AS p50, v[least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1] AS p95, v[least(CAST(floor(n * 0.99) AS BIGINT), n - 1) + 1] AS p99, round(mean, 6) AS mean, round(n / (total / 1000), 4) AS rate FROM s")
def L9_latency(spark, sf):
    return L.latency(events(spark, sf), "value").select("n", r6("p50"), "p95", "p99", r6("mean"), F.round("rate", 4).alias("rate"))


@query("SELECT job_id, status, roc_auc, optimal_threshold FROM jobs WHERE job_id = 1", JOBS)
def L10_status(spark, sf):
    return L.status(views.jobs(spark, sf), 1).select("job_id", "status", "roc_auc", "optimal_threshold")


# Replay buffers, coresets, spectra


def _quota_sql(source: str, size: str, ident: str, target: str) -> str:
    return f"""n AS (SELECT {target} AS t, count(*) AS n, sum(count(*)) OVER () AS total FROM {source} GROUP BY 1), q AS (SELECT *, floor(n * {size} / total) AS q, n * {size} / total - floor(n * {size} / total) AS f FROM n),
    q2 AS (SELECT t, CASE WHEN total <= {size} THEN n ELSE q + CASE WHEN row_number() OVER (ORDER BY f DESC, t) <= {size} - sum(q) OVER () THEN 1 ELSE 0 END END AS quota FROM q),
    r AS (SELECT {ident}, {target}, row_number() OVER (PARTITION BY {target} ORDER BY sha256(CAST({ident} AS VARCHAR) || ':42'), {ident}) AS rn FROM {source})"""


@query(f"+ {_quota_sql('cf', '137', 'customer_id', 'segment')} SELECT customer_id, segment FROM r JOIN q2 ON segment = t WHERE rn <= quota", CF)
def C1_replay_buffer(spark, sf):
    d = cf(spark, sf)
    return CS.update_buffer(d.where("customer_id % 2 = 0"), d.where("customer_id % 2 = 1"), "customer_id", "segment", 137).select("customer_id", "segment")


@query(f"+ src AS (SELECT * FROM cf WHERE customer_id % 10 = 0), k AS (SELECT least((SELECT count(*) FROM src), greatest(10, CAST(floor(count(*) * 0.05 / (1 - 0.05)) AS BIGINT))) AS k FROM cf WHERE customer_id % 10 > 0), {_quota_sql('src', '(SELECT k FROM k)', 'customer_id', 'segment')} SELECT customer_id FROM cf WHERE customer_id % 10 > 0 UNION ALL SELECT customer_id FROM r JOIN q2 ON segment = t WHERE rn <= quota", CF)
def C2_replay_mix(spark, sf):
    d = cf(spark, sf)
    return CS.replay_mix(d.where("customer_id % 10 > 0"), d.where("customer_id % 10 = 0"), "customer_id", "segment", 0.05).select("customer_id")


@query()
def C3_herding(spark, sf):
    return CS.herding(views.table(spark, sf, "embeddings"), "vec_id", "embedding", 100, by="label").select("vec_id", "label")


@query()
def C4_k_center(spark, sf):
    return CS.k_center(views.table(spark, sf, "embeddings"), "vec_id", "embedding", 50).select("vec_id", "label")


@query("+ a AS (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings WHERE label = 1), b AS (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings) SELECT round(sqrt(sum(pow(x.m - y.m, 2))), 6) AS mean_shift FROM (SELECT i, avg(CAST(v AS DOUBLE)) AS m FROM a GROUP BY 1) x JOIN (SELECT i, avg(CAST(v AS DOUBLE)) AS m FROM b GROUP BY 1) y USING (i)")
def C5_mean_shift(spark, sf):
    e = views.table(spark, sf, "embeddings")
    return CS.mean_shift(e.where("label = 1"), e, "embedding").select(r6("mean_shift"))


@query()
def C6_effective_rank(spark, sf):
    r = CS.effective_rank(views.table(spark, sf, "embeddings"), "embedding")
    return spark.createDataFrame([(r,)], "effective_rank double")


@query()
def C7_singular_values(spark, sf):
    return CS.singular_value_distribution(views.table(spark, sf, "embeddings"), "embedding")


@query("+ k AS (SELECT greatest(1, CAST(ceil(count(*) * 0.1) AS BIGINT)) AS k FROM orders), t AS (SELECT sum(o_totalprice) AS top FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT (SELECT k FROM k))) SELECT round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS max, round(max(o_totalprice) / min(o_totalprice), 6) AS ratio, round(exp(ln(sum(o_totalprice)) - sum(o_totalprice * ln(o_totalprice)) / sum(o_totalprice)), 3) AS entropy_rank, round(max(t.top) / sum(o_totalprice), 6) AS top_share FROM orders, t")
def C8_concentration(spark, sf):
    return CS.concentration(views.table(spark, sf, "orders"), "o_totalprice").select(F.round("total", 2).alias("total"), "max", r6("ratio"), F.round("entropy_rank", 3).alias("entropy_rank"), r6("top_share"))


@query("SELECT pos, round(avg(pow((p - churned) * x, 2)), 6) AS fisher FROM (SELECT churned, customer_id % 101 / 100.0::DOUBLE AS p, unnest([0, 1]) AS pos, unnest([balance / 1000, CAST(n_orders AS DOUBLE)]) AS x FROM cf) GROUP BY 1", CF)
def C9_fisher(spark, sf):
    d = cf(spark, sf).select("customer_id", "churned", (F.col("customer_id") % 101 / 100.0).alias("p"), F.array(F.col("balance") / 1000, F.col("n_orders").cast("double")).alias("x"))
    return CS.fisher(d, "x", "p", "churned", "customer_id").select("pos", r6("fisher"))


@query()
def C10_feature_vectors(spark, sf):
    return CS.feature_vectors(cf(spark, sf), ["balance", "avg_value"]).select("customer_id", vector_to_array("features").alias("features"))


TAU = 2 * math.pi
