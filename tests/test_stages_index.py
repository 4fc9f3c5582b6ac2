"""Stages with manifests and the inverted-list index."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.operators import inverted as INV
from offerlens.operators import retrieval as R
from offerlens.sources import stages as ST

SF = "/root/testdata/sf0.1"


# ------------------------------------------------------------------ stages
def test_a_rewritten_file_is_computed_again(spark, tmp_path):
    src, stage = str(tmp_path / "in"), str(tmp_path / "stage")
    calls = []

    def compute():
        calls.append(1)
        return spark.read.parquet(src).selectExpr("id * 10 AS x")

    def values():
        return sorted(r.x for r in ST.resume_or_compute(spark, stage, compute).collect())

    spark.createDataFrame([(1,), (2,)], "id long").coalesce(1).write.parquet(src)
    assert values() == values() == [10, 20]
    first = ST.read_manifest(spark, stage)
    part = next(f for f in os.listdir(src) if f.endswith(".parquet"))
    other = str(tmp_path / "other")
    spark.createDataFrame([(7,), (8,)], "id long").coalesce(1).write.parquet(other)
    new = next(f for f in os.listdir(other) if f.endswith(".parquet"))
    with open(os.path.join(other, new), "rb") as f, open(os.path.join(src, part), "wb") as g:
        g.write(f.read())  # other rows under the old name, of the same schema
    crc = os.path.join(src, f".{part}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    assert values() == [70, 80]
    second = ST.read_manifest(spark, stage)
    assert first["key"] != second["key"] and first["data"] != second["data"]
    assert ST.forget_old(spark, stage) == 1 and values() == [70, 80] and ST.read_manifest(spark, stage) == second


def test_plan_schema_and_version_belong_to_the_key(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(5).write.parquet(src)
    read = lambda: spark.read.parquet(src)
    key = ST.stage_key(read().where("id > 1"))
    assert key == ST.stage_key(read().where("id > 1"))
    odd = lambda: read().withColumn("a", F.transform(F.array("id", "id"), lambda x: x + 1)).where(F.exists("a", lambda y: y > 2))
    assert ST.stage_key(odd()) == ST.stage_key(odd())
    keys = [key, ST.stage_key(read().where("id > 2")), ST.stage_key(read().where("id > 1"), "2"), ST.stage_key(read()),
            ST.stage_key(read().selectExpr("id AS x").where("x > 1")), ST.stage_key(odd())]
    assert len(set(keys)) == len(keys)
    inner = spark.read.parquet(src).agg(F.max("id").alias("m"))
    assert len(ST.input_files(read().where(F.col("id") == inner.select("m").scalar()))) == len(ST.input_files(read()))
    rows = [ST.stage_key(spark.createDataFrame([(i,)], "id long")) for i in (1, 1, 2)]
    assert rows[0] is None or (rows[0] == rows[1] != rows[2])


def test_half_written_stages_are_never_read(spark, tmp_path):
    src, stage = str(tmp_path / "in"), str(tmp_path / "stage")
    spark.range(3).write.parquet(src)
    key = ST.stage_key(spark.read.parquet(src))

    def broken(folder):
        spark.range(1).write.parquet(folder)
        raise RuntimeError("lost before the manifest")

    with pytest.raises(RuntimeError):
        ST.resume(spark, stage, key, broken)
    assert ST.read_manifest(spark, stage) is None
    got = ST.resume_or_compute(spark, stage, lambda: spark.read.parquet(src))
    assert sorted(r.id for r in got.collect()) == [0, 1, 2]
    with open(os.path.join(stage, ST.MANIFEST), "w") as f:
        f.write('{"key": "abc", "da')  # cut off
    crc = os.path.join(stage, f".{ST.MANIFEST}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    assert ST.read_manifest(spark, stage) is None
    assert sorted(r.id for r in ST.resume_or_compute(spark, stage, lambda: spark.read.parquet(src)).collect()) == [0, 1, 2]
    assert ST.forget_old(spark, stage) == 2


# ------------------------------------------------------------------ inverted lists
def table(spark, vectors, customers):
    rows = [(i, int(c), "call", "2024-01-01", [float(x) for x in v]) for i, (v, c) in enumerate(zip(vectors, customers))]
    return spark.createDataFrame(rows, "interaction_id long, customer_id long, channel string, date string, embedding array<float>")


def stored(spark, df, folder):
    df.write.parquet(folder + "-rows")
    return spark.read.parquet(folder + "-rows")


def unit(spark, v):
    v = np.asarray(v, float) / np.linalg.norm(v)
    return spark.createDataFrame([(v.tolist(),)], "q array<double>").select("q").scalar()


def test_fewer_than_half_the_rows_are_scanned_at_nine_of_ten_hits(spark):
    from offerlens.plans.catalog import QUERIES, RP, Tables, _index
    index, t = _index(spark, SF), Tables(spark, SF)
    total = index["rows"].count()
    assert total == RP.corpus(t).count()
    got = {(r.customer_id, r.interaction_id) for r in QUERIES["ret_ann_topk"](spark, SF).collect()}
    exact = {(r.customer_id, r.interaction_id) for r in QUERIES["ret_exact_topk"](spark, SF).collect()}
    assert len(got & exact) >= 0.9 * len(exact) and len(got) == len(exact)
    for query in (RP.anchor_query(t), RP.probe_query(t)):
        probed = INV.probed_rows(index, query)
        probed.collect()
        assert probed.count() * 2 < total
        plan = probed._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning", plan)  # the other cells' files are not opened


def test_every_customer_with_k_rows_gets_k(spark, tmp_path):
    rng = np.random.default_rng(4)
    side = np.concatenate([rng.normal(size=(400, 8)) + 6, rng.normal(size=(12, 8)) - 6])  # customers 7 and 8 lie on the far side
    customers = [i % 5 for i in range(400)] + [7] * 10 + [8, 8]
    df = stored(spark, table(spark, side, customers), str(tmp_path / "c"))
    index = INV.index_of(df, str(tmp_path / "ix"), k=3, recall=0.2)  # a small share
    query = unit(spark, np.ones(8))
    assert INV.probed_rows(index, query).where("customer_id >= 7").count() < 3
    hits = INV.search(index, query, 3).collect()
    per = {c: sorted(r["rank"] for r in hits if r.customer_id == c) for c in set(customers)}
    assert per == {**{c: [1, 2, 3] for c in (0, 1, 2, 3, 4, 7)}, 8: [1, 2]}
    exact = R.exact_topk(R.score(df, query), 3).where("customer_id >= 7").collect()
    assert {(r.customer_id, r.interaction_id) for r in exact} == {(r.customer_id, r.interaction_id) for r in hits if r.customer_id >= 7}


def test_hot_vectors_odd_vectors_and_empty_corpora(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([np.tile([1.0, 2, 3, 4], (300, 1)), rng.normal(size=(200, 4))])
    df = table(spark, vectors, [i % 3 for i in range(500)])
    odd = spark.createDataFrame([(900, 0, "call", "", [1.0]), (901, 0, "call", "", None)], df.schema)
    df = stored(spark, df.unionByName(odd), str(tmp_path / "c"))
    index = INV.index_of(df, str(tmp_path / "ix"))
    assert index["rows"].count() == 500 and index["cells"].agg(F.sum("n_rows")).first()[0] == 500
    files = index["rows"].groupBy("cell", F.input_file_name().alias("f")).count().collect()
    hot = max(files, key=lambda r: r["count"]).cell
    assert len([r for r in files if r.cell == hot]) > 1  # the cell of the common vector is several files
    hits = INV.search(index, unit(spark, [1, 2, 3, 4]), 3).collect()
    assert sorted((r.customer_id, r.interaction_id) for r in hits) == sorted((i % 3, i) for i in range(9))
    none = stored(spark, df.limit(0), str(tmp_path / "n"))
    assert INV.search(INV.index_of(none, str(tmp_path / "ixn")), unit(spark, [1, 2, 3, 4]), 3).collect() == []


def test_the_index_is_built_once(spark, tmp_path, monkeypatch):
    df = stored(spark, table(spark, np.eye(4), [0, 0, 1, 1]), str(tmp_path / "c"))
    INV.index_of(df, str(tmp_path / "ix"))
    monkeypatch.setattr(INV, "build", None)
    assert INV.index_of(spark.read.parquet(str(tmp_path / "c-rows")), str(tmp_path / "ix"))["rows"].count() == 4
    with pytest.raises(TypeError):
        INV.index_of(df, str(tmp_path / "ix"), k=2)


# ------------------------------------------------------------------ vectors of the histories, and the trees
def test_histories_are_embedded_once_by_a_trained_model(spark, sf_small, monkeypatch):
    from offerlens.plans import catalog
    first = catalog.QUERIES["emb_embed_batch"](spark, sf_small)
    norms = first.select(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("n")).collect()
    assert norms and all(abs(r.n - 1) < 1e-4 or r.n == 0 for r in norms) and sum(r.n > 0 for r in norms) > 0.9 * len(norms)
    monkeypatch.setattr(catalog.ML, "embed", None)  # nothing is embedded a second time
    assert catalog.QUERIES["emb_embed_batch"](spark, sf_small).count() == len(norms)
    modes = {r.retrieval_mode for r in catalog.QUERIES["ret_bulk_context"](spark, sf_small).collect()}
    assert modes >= {"vector_top3", "full_dump"}


def test_texts_with_common_words_are_near(spark):
    from offerlens.operators import ml as ML
    rows = [f"the network is slow and calls drop again {i % 3}" for i in range(40)] + [f"please send a new bundle of music and games {i % 3}" for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, "", "unheard"])], "i long, text string")
    v = {r.i: np.array(r.embedding) for r in ML.embed(ML.fit_trained(df, dim=16), df).collect()}
    assert len(v[0]) == 16 and np.allclose(v[80], 0) and np.allclose(v[81], 0)
    assert v[0] @ v[5] > v[0] @ v[45]


def test_a_walk_over_the_node_table_scores_alike(spark, sf_small):
    from pyspark.ml.functions import vector_to_array

    from offerlens.operators import ml as ML
    from offerlens.plans.subscriber import build_subscribers
    rows = build_subscribers(spark, sf_small).withColumn("accept_ind", (F.xxhash64("customer_id") % 3 != 0).cast("int"))  # hard to fit: deep trees
    model = ML.fit_propensity(rows, max_iter=6)
    nodes = ML.node_table(model)
    assert nodes.where("left_categories is not null").count() and nodes.where("threshold is not null").count()
    pairs = ML.score_pairs(model, rows, nodes).collect()
    assert len(pairs) == 10 * rows.count() and all(abs(r.score - r.walked) < 1e-12 for r in pairs) and len({r.score for r in pairs}) > 20
    fitted = model.transform(rows).select(F.col("accept_ind").alias("y"), ML.positive_probability(None).alias("p"), vector_to_array("features").alias("x"))
    loss = fitted.select(ML.log_loss(F.col("p"), F.col("y"))).first()[0]
    share = sum(r.y for r in fitted.collect()) / rows.count()
    assert loss < -(share * np.log(share) + (1 - share) * np.log(1 - share))
