"""P17 where a blank stands in the numbers: the small given tables have no balance of 0."""

import duckdb
from pyspark.sql import functions as F

from tidemark.operators import cleaning as C
from tidemark.plans import catalog


def test_zero_and_missing_balances_get_the_median_of_all(spark, sf, tmp_path):
    c, k = spark.read.parquet(f"{sf}/customer.parquet"), F.col("c_custkey")
    balance = F.when(k % 7 == 0, 0.0).when(k == 5, -0.0).when(k % 11 == 3, None).otherwise(F.col("c_acctbal"))
    c.withColumn("c_acctbal", balance).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{sf}/orders.parquet").where("o_custkey % 10 > 0").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    for t in ("customer", "orders"):
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(duck.execute(f"select customer_id, balance, segment, avg_value from ({catalog.ORACLE_SQL['P17_fill_nulls']})").fetchall())
    got = sorted(tuple(r) for r in catalog.QUERIES["P17_fill_nulls"](spark, str(tmp_path)).select("customer_id", "balance", "segment", "avg_value").collect())
    assert got == want and not any(r[1] in (0.0, None) for r in got)


def test_blanks_count_in_the_median(spark):
    d = spark.createDataFrame([(1, 0.0, None), (2, 0.0, None), (3, 5.0, None), (4, 7.0, None), (5, None, None)], "id int, x double, y double")
    got = {r["id"]: (r["x"], r["y"]) for r in C.fill_nulls(d, ["x", "y"], blanks={"x": 0.0}).collect()}
    assert got == {1: (2.5, None), 2: (2.5, None), 3: (5.0, None), 4: (7.0, None), 5: (2.5, None)}
