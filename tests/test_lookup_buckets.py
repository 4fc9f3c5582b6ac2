"""Lookup of single customers, and tables bucketed for joins without exchange."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.operators import retrieval as R
from offerlens.plans import retrieval as RP
from offerlens.plans.subscriber import build_subscribers, lookup_subscribers
from offerlens.sources import bucketed as B
from offerlens.sources.tables import Tables


# ------------------------------------------------------------------ lookup
def test_looked_up_rows_equal_those_of_the_whole_build(spark, sf_small):
    t = Tables(spark, sf_small)
    every = {r.customer_id: r for r in build_subscribers(spark, sf_small).collect()}
    without = [r.c_custkey for r in t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").limit(2).collect()]
    keys = [*sorted(every)[:3], *without, max(every), 10 ** 9]
    got = {r.customer_id: r for r in lookup_subscribers(t, keys).collect()}
    assert got == {k: every[k] for k in keys if k in every}
    assert lookup_subscribers(t, []).collect() == []


def test_a_lookup_scans_each_table_once_with_the_key_pushed(spark, sf_small):
    from offerlens.plans.catalog import QUERIES
    assert [r.customer_id for r in QUERIES["flt_key_lookup"](spark, sf_small, key=7).collect()] == [7]
    df = lookup_subscribers(Tables(spark, sf_small), [7])
    plan = df._jdf.queryExecution().executedPlan().toString()
    for name, col in (("customer", "c_custkey"), ("events", "user_id"), ("conversations", "conv_id"), ("lineitem", None), ("orders", None)):
        scans = [x for x in re.findall(r"FileScan parquet[^\n]*", plan) if f"/{name}.parquet" in x]
        assert len(scans) == (0 if name == "orders" else 1)  # the key's orders come from their own table
        assert all(re.search(rf"PushedFilters: \[[^\]]*(In|EqualTo)\({col},", x) for x in scans if col)
    written = spark.read.parquet(re.search(r"\[file:(\S*key-orders-\w+)\]", plan)[1])
    assert {r.o_custkey for r in written.collect()} == {7}


# ------------------------------------------------------------------ buckets
@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    owner = [1] * 400 + [2 + i % 90 for i in range(800)] + [500]  # customer 1 holds a third, customer 500 one row
    data = [(i, o, "call", "2024-01-01", rng.normal(size=4).tolist()) for i, o in enumerate(owner)]
    path = str(tmp_path_factory.mktemp("rows") / "r")
    spark.createDataFrame(data, "interaction_id long, customer_id long, channel string, date string, embedding array<double>").write.parquet(path)
    return spark.read.parquet(path).withColumn("embedding", F.col("embedding").cast("array<float>"))


def test_bucketed_join_has_no_exchange_and_every_customer(spark, rows, tmp_path):
    vectors, queries = RP.persist_scoped(rows, str(tmp_path / "v"), rows_a_salt=50, buckets=6)
    joined = RP.scoped_scores(vectors, queries)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
        hits = R.exact_topk(joined, 3)
        top = hits._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in top[top.index("SortMergeJoin"):]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = R.scoped_topk(rows, R.own_queries(rows), 3).select("customer_id", "rank", "interaction_id", "similarity").collect()
    assert sorted(hits.select("customer_id", "rank", "interaction_id", "similarity").collect()) == sorted(want)
    assert joined.count() == rows.count() - rows.select("customer_id").distinct().count()


def test_a_hot_customer_fills_several_buckets(spark, rows, tmp_path):
    vectors, queries = RP.persist_scoped(rows, str(tmp_path / "v"), rows_a_salt=10, buckets=6)
    salts = {r.customer_id: r.n for r in vectors.groupBy("customer_id").agg(F.count_distinct("salt").alias("n")).collect()}
    assert salts[1] == 40 and max(n for k, n in salts.items() if k != 1) == 1
    assert {r.customer_id: r.n for r in queries.groupBy("customer_id").agg(F.count_distinct("salt").alias("n")).collect()} == salts
    files = vectors.where("customer_id = 1").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 2 and max(r["count"] for r in files) < 250


def test_a_bucketed_table_is_opened_again_without_its_entry(spark, rows, tmp_path):
    path = str(tmp_path / "b")
    B.write_bucketed(rows.select("customer_id", "interaction_id"), path, ["customer_id"], ["interaction_id"], 4)
    name = B.table_name(path)
    spark.sql(f"DROP TABLE {name}")  # as in a new session: the files stay
    t = B.open_bucketed(spark, path, "customer_id bigint, interaction_id bigint", ["customer_id"], ["interaction_id"], 4)
    assert t.count() == rows.count()
    plan = t.groupBy("customer_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
