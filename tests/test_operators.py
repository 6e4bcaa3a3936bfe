"""Behaviour on small literal tables, and properties."""

import datetime
import hashlib
import json
import math
import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import cleaning as C
from tidemark.operators import composite as K
from tidemark.operators import coreset as CS
from tidemark.operators import drift as D
from tidemark.operators import experiments as A
from tidemark.operators import explore as E
from tidemark.operators import features as FT
from tidemark.operators import incremental as I
from tidemark.operators import ledger as L
from tidemark.operators import lineage as G
from tidemark.operators import modelling as M
from tidemark.operators import profiling as T
from tidemark.operators import quality as V
from tidemark.operators import quantiles as Q
from tidemark.operators import scoring as R
from tidemark.sources import io as S
from tidemark.sources import keyed
from tidemark.streaming import streams

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def test_separators_and_formats(spark, tmp_path):
    for sep, name in ((",", "a.csv"), (";", "b.csv"), ("|", "c.csv"), ("\t", "d.tsv")):
        (tmp_path / name).write_text(f"id{sep}x\n1{sep}2.5\n2{sep}\n")
        p = S.read_any(spark, str(tmp_path / name))
        assert p.detected_separator == sep and p.df.columns == ["id", "x"] and p.df.count() == 2
        assert p.df.where("x is null").count() == 1
    (tmp_path / "e.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert S.read_any(spark, str(tmp_path / "e.json")).df.count() == 2
    with pytest.raises(ValueError):
        S.read_any(spark, str(tmp_path / "f.docx"))
    (tmp_path / "g.parquet").write_text("no parquet")
    with pytest.raises(ValueError):
        S.read_any(spark, str(tmp_path / "g.parquet")).df.count()


def test_save_and_landing(spark, tmp_path):
    df = spark.createDataFrame([(1, "2020-01-01"), (2, "2020-01-01"), (3, "2020-01-02")], "a long, event_date string")
    S.save_parquet(df, str(tmp_path / "p"), "event_date")
    back = spark.read.parquet(str(tmp_path / "p"))
    assert {(r["event_date"].isoformat(), r["count"]) for r in back.groupBy("event_date").count().collect()} == {("2020-01-01", 2), ("2020-01-02", 1)}
    with pytest.raises(Exception):
        S.save_parquet(df.withColumn("event_date", F.lit("01.02.2020")), str(tmp_path / "q"), "event_date")
    S.write_landing(df.withColumn("Churn Label", F.lit("x")), str(tmp_path / "l"), "d1", "2024-03-01")
    day = S.read_landing(spark, str(tmp_path / "l"), "d1", "2024-03-01")
    assert day.count() == 3 and "Churn Label" not in day.columns
    assert S.list_files(spark, str(tmp_path / "l")).count() >= 1
    up = S.upload(spark, _csv(tmp_path), str(tmp_path / "u"), "d2").first()
    assert (up["rows"], up["columns"]) == (2, 2)


def _csv(tmp_path):
    (tmp_path / "up.csv").write_text("a,b\n1,2\n3,4\n")
    return str(tmp_path / "up.csv")


def test_exposure_log(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"customer_id": "a", "ab_group": "A", "event": "x", "ts": 1.0}\nbroken\n{"CustomerID": "b", "ab_group": "B", "event": "x", "ts": 2.0}\n')
    assert [r["customer_id"] for r in S.read_exposure_log(spark, str(tmp_path / "e.jsonl")).orderBy("ts").collect()] == ["a", "b"]


def test_catalog(spark):
    rows = [("1", "one", "f.csv", ",", "y", "binary", "active", ["id"], 3), ("2", "two", "g.csv", ";", "y", "binary", "planned", [], 0)]
    assert [r["id"] for r in S.catalog(spark, rows).collect()] == ["1"]


def test_cleaning(spark):
    df = spark.createDataFrame([("100.0", "Yes"), ("bad", "No"), ("200", None)], "`Total Charges` string, Partner string")
    assert C.resolve_column(df, "TotalCharges") == "Total Charges" and C.resolve_column(df, "nothing") is None
    got = C.convert_types(df)
    assert [r[0] for r in got.collect()] == [100.0, None, 200.0]
    assert C.drop_invalid_rows(got).count() == 2
    assert [r[1] for r in C.map_booleans(df).collect()] == [1, 0, None]
    assert df.columns == ["Total Charges", "Partner"]
    with pytest.raises(ValueError):
        C.normalised_names(spark.createDataFrame([(1, 2)], "`A b` int, ab int"))
    flat = spark.createDataFrame([(5.0,)] * 3, "MonthlyCharges double")
    assert {r[0] for r in C.quantile_bins(flat, "MonthlyCharges", "b").select("b").collect()} == {None}
    edges = spark.createDataFrame([(-1,), (6,), (7,), (96,), (97,)], "tenure int")
    assert [r[0] for r in edges.select(C.fixed_bins("tenure")).collect()] == [0, 0, 1, 4, None]
    assert C.drop_target_like(spark.createDataFrame([(1, 2, 3)], "a int, Churn_x int, y int"), "y").columns == ["a"]
    assert C.id_column(spark.createDataFrame([(1, 2)], "x int, UUID int"))[1] == "UUID"
    with pytest.raises(ValueError):
        C.id_column(spark.createDataFrame([(1,)], "x int"))


def test_quality(spark, tmp_path):
    df = spark.createDataFrame([("C1", 1.0), ("C2", None), ("C1", 2.0)], "CustomerID string, total double")
    m = V.collect_metrics(df, "t", "CustomerID")
    sla = {"min_rows": 5, "max_null_pct": {"DEFAULT": 10.0}, "max_duplicates": 0}
    assert V.sla_violations(m, sla).count() == 3
    with pytest.raises(ValueError):
        V.validate_sla(m, sla)
    V.append_metrics(m, str(tmp_path / "m"))
    V.append_metrics(V.collect_metrics(df.limit(2), "t"), str(tmp_path / "m"))
    assert V.latest_metrics(spark.read.parquet(str(tmp_path / "m")), "t").first()["row_count"] == 2
    rules, meta = V.contract_from_profiles([{"column_name": "a", "role": "NUMERIC"}, {"column_name": "id", "role": "ID"}, {"column_name": "b", "role": "CATEGORICAL", "leakage": True}], "y")
    assert [r.column for r in rules] == ["a"] and meta["skipped"] == {"id": "ID", "b": "leakage"}
    V.save_contract(spark, str(tmp_path / "c"), rules, meta)
    assert V.load_contract(spark, str(tmp_path / "c")) == (rules, meta)
    with pytest.raises(ValueError):
        V.validate(df, [V.Rule("CustomerID", unique=True)])
    for bad, target in ((df.select("total"), None), (df.limit(0), None), (df, "none"), (df.withColumn("y", F.lit(1)), "y")):
        with pytest.raises(ValueError):
            V.guard_table(bad, target)
    empty = spark.createDataFrame([], "year int, month int, day int")
    assert V.partition_statistics(empty).first()["total_rows"] == 0 and V.partition_skew(empty).count() == 0


def test_incremental(spark, tmp_path):
    a, b = spark.createDataFrame([("A", 1), ("B", 1)], "k string, v int"), spark.createDataFrame([("A", 1), ("B", 2), ("C", 1)], "k string, v int")
    assert {(r.k, r.change_type) for r in I.changed_records(a, b, "k").collect()} == {("A", "UPDATED"), ("B", "UPDATED"), ("C", "NEW")}
    assert {(r.k, r.change_type) for r in I.changed_records(b, a, "k", strict=True).collect()} == {("B", "UPDATED"), ("C", "DELETED")}
    I.set_watermark(spark, str(tmp_path / "w"), "t", "2024-01-01")
    I.set_watermark(spark, str(tmp_path / "w"), "t", "2024-02-01")
    h = keyed.read(spark, str(tmp_path / "w"))
    assert str(I.get_watermark(h, "t")).startswith("2024-02-01") and I.get_watermark(h, "u") is None
    old = spark.createDataFrame([("A", "2024-01-01", 1), ("B", "2024-01-05", 1)], "k string, d string, v int")
    new = spark.createDataFrame([("A", "2024-01-01", 2), ("B", "2024-01-04", 2)], "k string, d string, v int")
    assert {(r.k, r.v) for r in I.merge_latest(old, new, "k", "d").collect()} == {("A", 2), ("B", 1)}


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_merge_rewrites_only_what_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame([(k, n, datetime.date.fromisoformat(d) if d else None, v) for k, n, d, v in rows], "k string, n int, d date, v int")
    table = lambda: sorted((str(r["k"]), r["n"], str(r["d"]), r["v"]) for r in spark.read.parquet(path).collect())
    told = lambda df: {str(r["partition"]): (r["rows_before"], r["rows_after"], r["action"]) for r in df.collect()}
    first = make([("a", 1, "2024-01-01", 1), ("b", 1, "2024-01-01", 1), ("c", 1, "2024-01-02", 1), ("e", 1, "2024-01-03", 1), (None, 1, "2024-01-04", 1), ("f", 1, None, 1)])
    assert {v[2] for v in told(I.merge_partitions(first, path, "k", "n", "d")).values()} == {"written"}
    before = _files(path)
    # c moves away from the second of January, b gets a new value, e is older than what is there.
    new = make([("c", 2, "2024-01-05", 2), ("b", 2, "2024-01-01", 2), ("e", 0, "2024-01-03", 0), (None, 2, "2024-01-04", 2), ("c", 1, "2024-01-06", 9)])
    done = told(I.merge_partitions(new, path, "k", "n", "d"))
    assert done == {"2024-01-01": (2, 2, "written"), "2024-01-02": (1, 0, "deleted"), "2024-01-03": (1, 1, "unchanged"), "2024-01-04": (1, 1, "written"), "2024-01-05": (0, 1, "written"), "2024-01-06": (0, 0, "unchanged")}
    assert table() == sorted([("a", 1, "2024-01-01", 1), ("b", 2, "2024-01-01", 2), ("c", 2, "2024-01-05", 2), ("e", 1, "2024-01-03", 1), ("None", 2, "2024-01-04", 2), ("f", 1, "None", 1)])
    after = _files(path)
    kept = {f for f in before if after.get(f) == before[f]}
    assert {f.split("d=")[1].split("/")[0] for f in kept} == {"2024-01-03", "__HIVE_DEFAULT_PARTITION__"}
    assert {v[2] for v in told(I.merge_partitions(new, path, "k", "n", "d")).values()} == {"unchanged"} and _files(path) == after
    I.merge_partitions(new.limit(0), path, "k", "n", "d")
    assert _files(path) == after


def test_keyed_tables_stay_as_large_as_their_keys(spark, tmp_path):
    path = str(tmp_path / "w")
    for day in range(1, 13):
        I.set_watermark(spark, path, f"t{day % 2}", f"2024-01-{day:02d}")
    I.set_watermark(spark, path, "t0", "no date")
    assert keyed.read(spark, path).count() == 2 and len(_files(path)) <= 2
    assert str(I.get_watermark(keyed.read(spark, path), "t0")).startswith("2024-01-12")


def test_incremental_runs_into_a_table(spark, tmp_path):
    cols = "CustomerID string, Gender string, Partner string, TotalCharges string, MonthlyCharges double, tenure int, load_date date"
    day = lambda d: datetime.date(2024, 1, d)
    rows = lambda d, total: spark.createDataFrame([(f"C{i}", "Male", "Yes", total if i else "bad", 20.0 + i, i, day(d)) for i in range(8)], cols)
    out = str(tmp_path / "o")
    I.run_pipeline(spark, rows(1, "10.5"), out, mode="incremental")
    got = I.run_pipeline(spark, rows(2, "11.5"), out, mode="incremental")["result"]
    assert got.count() == 7 and {str(r["load_date"]) for r in got.collect()} == {"2024-01-02"}


def test_pipeline_and_lineage(spark, tmp_path):
    rows = [(f"C{i}", "Male", "Yes", "10.5" if i else "bad", 20.0 + i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "CustomerID string, Gender string, Partner string, TotalCharges string, MonthlyCharges double, tenure int")
    out = I.run_pipeline(spark, df, str(tmp_path / "o"))
    assert out["result"].count() == 19 and out["lineage"].count() == 4
    assert {r["transformation"]: r["loss_pct"] for r in out["lineage"].collect()}["drop_invalid_rows"] == 5.0
    assert G.edge(spark, "a", "b", "t", {}, {}, 100, 98).first()["loss_pct"] == 2.0
    assert G.edge(spark, "a", "b", "t", {}, {}, 0, 0).first()["loss_pct"] == 0.0
    chain = G.chain(out["lineage"], "processed").orderBy("step").collect()
    assert [r["transformation"] for r in chain] == ["create_features", "map_booleans", "drop_invalid_rows", "convert_types"]
    assert G.impact(out["lineage"], "raw").where("impact = 'direct'").count() == 1
    assert json.loads(G.graph_json(out["lineage"]).first()[0])["nodes"]


def test_walks_of_any_length(spark):
    """A chain of 300 edges by doubling, with branches; a deep walk downstream with a cycle; nothing at all."""
    n = 300
    rows = [(10 * i, f"t{i}", f"t{i + 1}", "x", {"c": "int"} if i != 290 else {}, {"c": "int"} if i != 290 else {}, 1, 1) for i in range(n)]
    rows += [(10 * i + 1, "other", f"t{i + 1}", "y", {}, {}, 1, 1) for i in range(0, n, 50)] + [(99_999, "t300", "t300", "loop", {}, {}, 1, 1)]
    e = G.edges(spark, rows)
    by_target = {}
    for r in rows:
        by_target.setdefault(r[2], []).append(r)
    want, at = [], max(by_target["t300"])
    while at:
        want.append((len(want), at[0], at[1]))
        at = max((r for r in by_target.get(at[1], []) if r[0] < at[0]), default=None)
    assert sorted((r["step"], r["edge_id"], r["source"]) for r in G.chain(e, "t300").collect()) == want
    assert len(want) == 51 and G.chain(e, "t300", "c").count() == 9 and G.chain(e, "nowhere").count() == 0
    plain = G.edges(spark, rows[:n])
    assert [r["step"] for r in G.chain(plain, "t300").orderBy("step").collect()] == list(range(n))
    down = G.edges(spark, [(i, f"t{i}", f"t{i + 1}", "x", {}, {}, 1, 1) for i in range(12)] + [(50, "t5", "t0", "back", {}, {}, 1, 1), (51, "t0", "t3", "short", {}, {}, 1, 1)])
    got = {r["table_name"]: (r["depth"], r["impact"]) for r in G.impact(down, "t0").collect()}
    assert got == {f"t{i}": (d, "direct" if d == 1 else "indirect") for i, d in zip(range(1, 13), [1, 2, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10])}
    assert G.impact(down, "t12").count() == 0


def _profile(df):
    return {r["column_name"]: r for r in T.run_profiling(df)[0].collect()}


def test_profiles(spark, tmp_path):
    rows = [(f"u{i}@mail.org", None, "A" if i % 3 else None, f"ID{i:03d}", "word " * 20 + str(i % 5), i % 2, 1.5 * i, f"2024-01-{i % 28 + 1:02d}", ("2024-01-01", "01/02/2024", "x")[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "mail string, empty string, constant string, code string, text string, churn_target int, amount double, day string, mixed string")
    p = _profile(df)
    assert p["mail"]["role"] == "IGNORE" and p["empty"]["role"] == "IGNORE" and p["constant"]["role"] == "IGNORE"
    assert p["code"]["role"] == "ID" and p["text"]["role"] == "TEXT" and p["day"]["role"] == "DATETIME" and p["mixed"]["dtype"] == "object"
    assert p["churn_target"]["role"] == "TARGET" and T.detect_target(df) == "churn_target"
    leaky = df.select("churn_target", "amount", F.when(F.col("churn_target") == 1, "b").otherwise("a").alias("copy"))
    q = _profile(leaky)
    assert q["copy"]["leakage"] and q["copy"]["association"] > 0.95
    T.store_profiles(T.run_profiling(leaky)[0], str(tmp_path / "p"), "d")
    assert T.load_profiles(spark, str(tmp_path / "p"), "d").count() == 3


@QUICK
@given(st.lists(st.tuples(st.floats(-100, 100), st.integers(0, 5), st.sampled_from(["A", "B", "C", None])), min_size=5, max_size=30), st.lists(st.floats(-1, 1), min_size=3, max_size=3))
def test_weighted_score_stays_in_range(spark, rows, w):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b int, c string")
    f = K.weighted_score(df, [K.Weight("a", w[0]), K.Weight("b", w[1], "zscore"), K.Weight("c", w[2], "binary_encode")])
    got = [r[0] for r in df.select(f.column()).collect()]
    assert all(g is None or -1e-9 <= g <= 1 + 1e-9 for g in got)


def test_composite(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + (i % 3), i % 2, float(i > 10)) for i in range(20)], "a double, b double, c int, y double")
    f = K.pca_score(df, ["a", "b"], "y")
    s = [r[0] for r in df.select(f.column()).collect()]
    assert f.explained > 0.8 and min(s) == 0 and max(s) == 1 and np.corrcoef(s, range(20))[0, 1] > 0.9
    with pytest.raises(ValueError):
        K.weighted_score(df, [K.Weight("a", 1, "other")])
    none = spark.createDataFrame([], "column_name string, association double, group_role string")
    assert K.synthesize(df, none, "y").strategy == "NONE"
    group = spark.createDataFrame([("a", 0.6, "AUXILIARY"), ("b", 0.7, "AUXILIARY")], none.schema)
    assert K.synthesize(df, group, "y").strategy == "PCA" and K.synthesize(df, group, "y").attach
    assert "cpi_score" in K.attach_if_expected(df, ["cpi_score"], f).columns


def test_features(spark):
    df = spark.createDataFrame([(i, float(i % 7), "abc"[i % 3], i % 2) for i in range(60)], "id int, x double, c string, y int")
    assert abs(FT.fit_power(spark.createDataFrame([(float(np.exp(v)) - 1,) for v in np.random.default_rng(0).normal(1, 0.2, 500)], "v double"), "v")) < 1.5
    roles = [{"column_name": "id", "role": "ID"}, {"column_name": "x", "role": "NUMERIC"}, {"column_name": "c", "role": "CATEGORICAL"}]
    pipe = FT.feature_pipeline(df, roles, "y")
    out = pipe.fit(df).transform(df.withColumn("c", F.lit("new")))
    assert out.select("features").first()[0].size == 5
    with pytest.raises(ValueError):
        FT.feature_pipeline(df, roles[:1], "y")
    assert FT.table_hash(df).first() == FT.table_hash(df.orderBy(F.desc("id")).repartition(3)).first()
    t = FT.tfidf(spark.createDataFrame([(1, "the cat sat"), (2, "cat dog"), (3, None)], "i int, t string"), "i", "t")
    assert {r["ident"] for r in t.collect()} == {1, 2} and math.isclose(sum(r["weight"] ** 2 for r in t.where("ident = 1").collect()), 1)


def test_modelling(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(i % 5 == 0, 1, 2)), "xyz"[i % 3], int(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c string, label int")
    sp = M.stratified_split(df, "id", "label")
    assert {(r["label"], r["is_test"]): r["count"] for r in sp.groupBy("label", "is_test").count().collect()}[(1, True)] == 16
    over = {r["label"]: r["count"] for r in M.oversample(df, "id", "label").groupBy("label").count().collect()}
    assert abs(over[1] - over[0]) < 40
    sm = M.smote(df, "id", ["a", "b"], "label", ["c"])
    assert sm.where("label = 1").count() == 320 and sm.columns == df.columns
    assert M.smote(df.limit(50), "id", ["a"], "label").count() == 50
    assert M.route_models(100, [{"role": "NUMERIC", "unique_count": 50}]) == ["linear"]
    assert M.route_models(5000, [{"role": "NUMERIC", "unique_count": 50}]) == ["forest", "boosted"]
    assert M.route_models(5000, [{"role": "TEXT", "unique_count": 50}]) == ["linear", "boosted"]
    assert (M.trial_budget(500, 99), M.trial_budget(5000, 50), M.trial_budget(50_000, 50)) == (30, 50, 150)
    pipe = FT.feature_pipeline(df, [{"column_name": "a", "role": "NUMERIC"}, {"column_name": "b", "role": "NUMERIC"}, {"column_name": "c", "role": "CATEGORICAL"}], "label")
    m, scored = M.evaluate_logistic(df, pipe, "id", "label")
    auc = M.roc_auc(scored, "score", "label").first()[0]
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    assert auc > 0.6 and abs(auc - BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(scored)) < 1e-6
    t = M.best_threshold(scored, "score", "label").first()
    assert 0 < t["threshold"] < 1 and 0 < t["f1"] <= 1
    M.save_model(m, str(tmp_path / "m"), spark, t["threshold"], ["a", "b", "c"], {"auc": auc})
    again = R.predict_batch(M.load_model(str(tmp_path / "m")), df, "id", t["threshold"])
    assert again.count() == 400 and {r[0] for r in again.select("risk").distinct().collect()} <= {"High", "Medium", "Low"}
    q = df.select("id", "a", "b", "c", "label")
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    streams.score_stream(stream, m, "id", 0.5, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400


def test_drift(spark, tmp_path):
    ref = spark.createDataFrame([(float(i), "AB"[i % 2]) for i in range(1, 11)], "feat_num double, feat_cat string")
    same = D.report(ref, ref, ["feat_num"], ["feat_cat"]).collect()
    assert all(not r["drifted"] and r["level"] == "low" for r in same)
    far = spark.createDataFrame([(100.0 + i, "XYZ"[i % 3]) for i in range(10)], ref.schema)
    assert all(r["drifted"] and r["level"] == "high" for r in D.report(ref, far, ["feat_num"], ["feat_cat"]).collect())
    flat = spark.createDataFrame([(1.0, "A")] * 5, ref.schema)
    assert D.numerical_psi(flat, far, ["feat_num"]).first()["psi"] == 0 and D.numerical_psi(ref, far.limit(0), ["feat_num"]).first()["psi"] == 0
    far.write.parquet(str(tmp_path / "land"))
    q = streams.drift_loop(spark.readStream.schema(ref.schema).parquet(str(tmp_path / "land")), ref, ["feat_num"], ["feat_cat"], str(tmp_path / "h"), str(tmp_path / "r"), str(tmp_path / "ck"), lambda: ("j1", "y"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2 and spark.read.parquet(str(tmp_path / "r")).first()["prior_job"] == "j1"
    assert D.latest_run(spark.read.parquet(str(tmp_path / "h"))).count() == 2


def test_drift_loop_repeats_a_failed_batch_and_drops_old_days(spark, tmp_path):
    ref = spark.createDataFrame([(float(i), "AB"[i % 2]) for i in range(1, 11)], "feat_num double, feat_cat string")
    far = spark.createDataFrame([(100.0 + i, "X") for i in range(10)], ref.schema)
    zone, h, r = (str(tmp_path / x) for x in ("zone", "h", "r"))
    for day in ("2024-01-01", "2024-02-01"):
        far.withColumn("date", F.lit(day)).write.mode("append").partitionBy("date").parquet(zone)
    far.write.parquet(str(tmp_path / "in"))
    calls = []

    def job():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("the ledger is away")
        return "j1", "y"

    loop = lambda: streams.drift_loop(spark.readStream.schema(ref.schema).parquet(str(tmp_path / "in")), ref, ["feat_num"], ["feat_cat"], h, r, str(tmp_path / "ck"), job, zone=zone, as_of="2024-02-10")
    with pytest.raises(Exception, match="the ledger is away"):
        loop().awaitTermination()
    assert spark.read.parquet(h).count() == 2 and os.path.isdir(f"{zone}/date=2024-01-01")
    loop().awaitTermination()
    loop().awaitTermination()
    assert spark.read.parquet(h).count() == 2 and [x["prior_job"] for x in spark.read.parquet(r).collect()] == ["j1"]
    assert os.listdir(zone).count("date=2024-02-01") == 1 and not os.path.exists(f"{zone}/date=2024-01-01")


def test_experiments(spark, tmp_path):
    ids = spark.createDataFrame([(str(i),) for i in range(1000)], "customer_id string")
    a = A.assign(ids, "customer_id")
    import hashlib

    for r in a.limit(50).collect():
        b = int(hashlib.sha256(r["customer_id"].encode()).hexdigest()[:16], 16) % 1_000_000 / 1_000_000
        assert r["ab_group"] == ("A" if b < 0.5 else "B")
    with pytest.raises(ValueError):
        A.z_test(A.analyze(a.where("ab_group = 'A'"), ids.withColumn("churn", F.lit(1))))
    assert A.sample_sizes(spark.createDataFrame([(0.2,)], "rate double"), 0.05).first()["n_a"] > 500
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "customer_id": "a", "ab_group": "A", "event": "x", "ts": "2024-01-01T00:00:00Z"}\n{"id": 2, "customer_id": "b", "ab_group": "B", "event": "x"}\n')
    streams.log_exposures(streams.read_exposures(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).where("ts is not null").count() == 2
    first = lambda: streams.first_exposures(streams.read_exposures(spark, str(tmp_path / "in")), str(tmp_path / "first"), str(tmp_path / "ck2")).awaitTermination()
    first()
    late = '{"id": 3, "customer_id": "a", "ab_group": "B", "event": "x", "ts": "2023-06-01T00:00:00Z"}\n{"id": 4, "customer_id": "c", "ab_group": "B", "event": "x", "ts": "2026-01-01T00:00:00Z"}\n{"id": 5, "customer_id": "c", "ab_group": "A", "event": "x", "ts": "2027-01-01T00:00:00Z"}\n'
    (tmp_path / "in" / "b.json").write_text(late)
    first()
    first()
    assert {(r["customer_id"], r["ab_group"]) for r in keyed.read(spark, str(tmp_path / "first")).collect()} == {("a", "B"), ("b", "B"), ("c", "B")}


def test_tails():
    assert math.isclose(stats.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.chi2_p(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.t_two_sided(2.2281388519649385, 10), 0.05, rel_tol=1e-8)
    assert math.isclose(stats.normal_quantile(0.975), 1.959963984540054, rel_tol=1e-9)


def test_ledger(spark):
    rows = [(1, "d", "completed", 0.8, True), (2, "d", "completed", 0.803, False), (3, "e", "queued", None, False)]
    j = spark.createDataFrame(rows, "job_id int, dataset_id string, status string, roc_auc double, is_active boolean")
    new, before = L.promote(j, "d", 2)
    assert [r[0] for r in before.collect()] == [1] and [r[0] for r in new.where("is_active").select("job_id").collect()] == [2]
    assert L.compare(j, 1, 2).first()["winner"] == "tie"
    assert [r["job_id"] for r in R.active_models(j).collect()] == [1]


def test_coresets(spark):
    d = spark.createDataFrame([(i, int(i < 20), [float(i % 10), float(i // 10)]) for i in range(100)], "id int, y int, v array<double>")
    got = {r["y"]: r["count"] for r in CS.stratified_sample(d, "id", "y", 10).groupBy("y").count().collect()}
    assert got == {0: 8, 1: 2}
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (250, 10)), rng.normal(5, 1, (250, 10))])
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    shift = lambda s: CS.mean_shift(s, e, "v").first()[0]
    herd = CS.herding(e, "id", "v", 50)
    assert herd.count() == 50 and shift(herd) <= np.mean([shift(e.orderBy(F.xxhash64("id", F.lit(s))).limit(50)) for s in range(3)])
    assert CS.k_center(e, "id", "v", 20).count() == 20
    x = {r["id"]: np.array(r["v"], float) for r in e.collect()}
    mean, took, total = np.mean(list(x.values()), 0), [], 0
    for k in range(50):
        took.append(min((i for i in x if i not in took), key=lambda i: (round(((mean - (total + x[i]) / (k + 1)) ** 2).sum(), 12), i)))
        total = total + x[took[-1]]
    assert {r["id"] for r in herd.collect()} == set(took)
    far = [r["id"] for r in CS.k_center(e, "id", "v", 20).collect()]
    cover = lambda ids: max(min(((x[i] - x[j]) ** 2).sum() for j in ids) for i in x)
    assert cover(far) <= np.mean([cover(list(x)[s::15][:20]) for s in range(3)])
    one = spark.createDataFrame([(i, (np.ones(32) * i).tolist()) for i in range(100)], "id int, v array<double>")
    assert 1 <= CS.effective_rank(one, "v") < 1.5
    g = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (100, 32)))], "id int, v array<double>")
    assert 15 < CS.effective_rank(g, "v") <= 32


@pytest.mark.parametrize("held", [1, 3, None])
def test_greedy_picks_by_carried_bounds(spark, held):
    """The same picks however few candidates a pass brings; ties, repeated vectors, null classes and text ids."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(150, 2)) * 64) / 64  # exact squares, so that ties are ties
    x[40:60] = x[:20]
    rows = [(f"i{k:03d}", "ab"[k % 2] if k % 5 else None, v.tolist()) for k, v in enumerate(x)] + [("n", "a", None), (None, "a", [0.0, 0.0])]
    d = spark.createDataFrame(rows, "id string, c string, v array<double>").repartition(5)
    for by in (None, "c"):
        groups = {}
        for i, c, v in rows:
            if i is not None and v is not None:
                groups.setdefault(c if by else "", {})[i] = np.array(v)
        size = {c: max(1, round(len(g) * 24 / 150)) if by else 24 for c, g in groups.items()}
        herd, far = set(), set()
        for c, g in groups.items():
            mean, took = np.mean(list(g.values()), 0), []
            start = min(g, key=lambda i: (hashlib.sha256(f"{i}:42".encode()).hexdigest(), i))
            cover = [min(g, key=lambda i: (round(((g[i] - g[start]) ** 2).sum(), 9), i))]
            while len(took) < size[c]:
                goal = (len(took) + 1) * mean - sum((g[i] for i in took), np.zeros(2))
                took.append(min((i for i in g if i not in took), key=lambda i: (round(((g[i] - goal) ** 2).sum(), 9), i)))
            while len(cover) < size[c]:
                cover.append(min((i for i in g if i not in cover), key=lambda i: (-round(min(((g[i] - g[j]) ** 2).sum() for j in cover), 9), i)))
            herd |= set(took)
            far |= set(cover)
        passes = []
        assert {r["id"] for r in CS.k_center(d, "id", "v", 24, by=by, held=held, passes=passes).collect()} == far
        assert held or len(passes) <= 2
        assert {r["id"] for r in CS.herding(d, "id", "v", 24, by=by, held=held).collect()} == herd
    assert CS.herding(d.limit(0), "id", "v", 5).count() == 0


def test_entry_without_llm(sf):
    """The entry module imports, and keeps its other queries, when the training-data modules are gone."""
    import importlib.util
    import os
    import shutil
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not importlib.util.find_spec("tidemark"):
        pytest.skip("no package")
    to = tempfile.mkdtemp()
    shutil.copytree(os.path.join(root, "tidemark"), os.path.join(to, "tidemark"), ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), to)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'E13_rate_pivot' in q and not any(k.startswith('op') for k in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=to, env=os.environ | {"PYTHONPATH": to}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_scoring_after_observed_metrics_and_a_pipeline_run(spark, sf):
    """A session that observes metrics can't be shipped; fitted models must not hold it."""
    from pyspark.sql import Observation

    from tidemark.plans import catalog

    seen = Observation("rows")
    spark.range(5).observe(seen, F.count("*").alias("n")).collect()
    assert catalog.QUERIES["I6_pipeline"](spark, sf).count() > 0
    for name in ("R1_predict_batch", "M7_search", "M8_stack", "M14_offline_evaluation", "M16_permutation_importance", "M17_two_target"):
        assert catalog.QUERIES[name](spark, sf).count() > 0, name


def test_exact_quantiles_by_range_buckets(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=300), np.repeat(1.5, 200), [-0.0, 0.0, 1e300, -1e300]])
    rows = [(i, "ab"[i % 2] if i % 5 else None, float(v), int(i % 7)) for i, v in enumerate(x)] + [(900, "c", None, None), (901, "c", float("nan"), 3)]
    d = spark.createDataFrame(rows, "i int, g string, x double, k int")
    points = (0, 0.01, 0.25, 0.5, 0.99, 1)
    got = {(r["g"], r["column_name"]): (r["q"], r["n"], r["distinct"]) for r in Q.quantiles(d, ["x", "k"], points, "g").collect()}
    assert set(got) == {(g, c) for g in ("a", "b", None) for c in "xk"} | {("c", "k")}
    for (g, c), (q, n, distinct) in got.items():
        v = [r[2 if c == "x" else 3] for r in rows if r[1] == g and r[2 if c == "x" else 3] is not None and r[2 if c == "x" else 3] == r[2 if c == "x" else 3]]
        assert n == len(v) and distinct == len(set(v)) and np.allclose(q, np.quantile(v, points), rtol=1e-12)
    assert Q.medians(d.where("g = 'c'"), ["x"]) == {} and Q.quantiles(d.limit(0), ["x"], points).count() == 0
    run = Q.cumulative(d.where("x is not null and not isnan(x)").groupBy(F.lit(0).alias("z"), "x").agg(F.count("*").alias("n")), "z", "x", ["n"]).orderBy("x").collect()
    assert [r["cum_n"] for r in run] == np.cumsum([r["n"] for r in run]).tolist() and run[-1]["cum_n"] == len(x)


def test_selection_of_the_least_rows(spark):
    """As many rows as asked for, in order, through ties, nulls, repeated rows and ids of any type."""
    rng = np.random.default_rng(5)
    rows = [(f"k{int(rng.integers(40)):02d}-long-name-{i % 7}" if i % 9 else None, int(rng.integers(-3, 3)) * 2**40 + int(rng.integers(5)), "ab"[i % 2] if i % 5 else None, float(rng.integers(4))) for i in range(300)] + [("same", 1, "c", 0.0)] * 7
    d = spark.createDataFrame(rows, "s string, n long, c string, x double")
    low = lambda v: (v is not None, v)
    for k in (0, 1, 17, 150, 400):
        got = Q.least(d, [F.col("x"), *Q.order_levels(d, "n"), *Q.order_levels(d, "s")], k).collect()
        want = sorted(rows, key=lambda r: (r[3], r[1], low(r[0]) if r[0] is not None else (False, "")))[:k]
        assert sorted((r["x"], r["n"], str(r["s"])) for r in got) == sorted((r[3], r[1], str(r[0])) for r in want)
    quota = spark.createDataFrame([("a", 11), (None, 4), ("c", 3), ("z", 5)], "c string, q long")
    got = Counter(r["c"] for r in Q.least(d, list(Q.order_levels(d, "s")), quota, "c").collect())
    assert got == {"a": 11, None: 4, "c": 3}
    plan = M.precision_at_k(d.withColumn("y", F.lit(1)), "x", "y", "n")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan
    assert M.precision_at_k(d.withColumn("y", (F.col("x") == 3).cast("int")), "x", "y", "n").first()["k"] == 30
    assert FT.modes(d, ["s", "c"])["c"] in ("a", "b") and FT.modes(d.limit(0), ["s"]) == {}


def test_correlations_of_a_wide_table(spark):
    """Sixty columns with holes, offsets, constants and repeats of each other against single correlations over complete pairs."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 60)) * rng.uniform(0.01, 50, 60) + rng.uniform(-1e6, 1e6, 60)
    x[:, 7], x[:, 8], x[:, 9] = 3.1, x[:, 2] * -2, np.nan
    x[rng.random(x.shape) < 0.2] = np.nan
    cols = [f"c{i}" for i in range(60)]
    d = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in cols)).repartition(3)
    got = {(r["a"], r["b"]): r["r"] for r in E.correlation_matrix(d, cols).collect()}
    assert len(got) == 60 * 59 // 2
    for i in range(60):
        for j in range(i + 1, 60):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if both.sum() < 2 or {i, j} & {7, 9}:
                assert got[f"c{i}", f"c{j}"] is None
            else:
                assert math.isclose(got[f"c{i}", f"c{j}"], np.corrcoef(x[both, i], x[both, j])[0, 1], abs_tol=1e-7)
    assert all(r["r"] is None for r in E.correlation_matrix(d.limit(0), cols[:3]).collect())


def test_category_statistics_have_no_window(spark):
    a = spark.createDataFrame([(f"v{i % 400}", "ab"[i % 2], i % 3) for i in range(3_000)], "v string, two string, y int")
    b = spark.createDataFrame([(f"v{i % 300}", "ab"[i % 7 > 2], i % 3) for i in range(2_000)], "v string, two string, y int")
    for df in (D.categorical_psi(a, b, ["v", "two"]), D.categorical_chi2(a, b, ["v", "two"]), T.cramers_v(a, "y", ["v", "two"])):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    chi = {r["feature"]: r for r in D.categorical_chi2(a, b, ["v", "two"]).collect()}
    count = lambda d, c: Counter(r[0] for r in d.select(c).collect())
    for c in ("v", "two"):
        x, y = count(a, c), count(b, c)
        keys = sorted(set(x) | set(y))
        o = np.array([[x[k] for k in keys], [y[k] for k in keys]]) + D.EPSILON
        e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
        gap = np.abs(o - e)
        gap = gap - np.minimum(0.5 if len(keys) == 2 else 0.0, gap)
        assert math.isclose(chi[c]["statistic"], (gap**2 / e).sum(), rel_tol=1e-8) and chi[c]["dof"] == len(keys) - 1
        p, q = o / o.sum(1, keepdims=True)
        psi = {r["feature"]: r["psi"] for r in D.categorical_psi(a, b, ["v", "two"]).collect()}
        assert math.isclose(psi[c], ((q - p) * np.log(q / p)).sum(), rel_tol=1e-8)


def test_profiles_of_awkward_columns(spark):
    rows = [("2024-01-05", "a@b.io", None, [1], True, 0.0), ("2024-02-30", "c@d.org", None, [2], False, -0.0), (None, "x", None, None, None, float("nan"))]
    p = {r["column_name"]: r for r in T.column_profiles(spark.createDataFrame(rows, "d string, m string, n string, l array<int>, b boolean, f double"), entropy=True).collect()}
    assert {c: r["dtype"] for c, r in p.items()} == {"d": "object", "m": "object", "n": "object", "l": "object", "b": "bool", "f": "float64"}
    assert p["n"]["unique_count"] == 0 and p["n"]["null_pct"] == 1 and p["m"]["email_rate"] == 2 / 3 and p["f"]["unique_count"] == 2 and math.isclose(p["b"]["entropy"], 1)
    good = spark.createDataFrame([("2024-01-05",), ("2024-02-28",), (None,)], "d string")
    assert T.column_profiles(good).first()["dtype"] == "datetime64" and T.column_profiles(good.limit(0)).first()["non_null"] == 0


def test_nearest_rows_block_by_block(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([np.round(rng.normal(size=(400, 3)) * 8) / 8, np.zeros((40, 3))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>")
    got, asked = {}, []
    assert M.nearest(d.limit(0), "i", "x", 3).count() == 0 and M.nearest(d.limit(1), "i", "x", 3).count() == 0
    near = M.nearest(d, "i", "x", 3, block=20, asked=asked).collect()
    assert asked[0] < 0.4 * asked[1]
    for r in near:
        got.setdefault(r["__a"], []).append((r["rn"], r["__b"]))
    for i, v in enumerate(x):
        near = sorted((round(((v - w) ** 2).sum(), 12), j) for j, w in enumerate(x) if j != i)[:3]
        assert [b for _, b in sorted(got[i])] == [j for _, j in near]
