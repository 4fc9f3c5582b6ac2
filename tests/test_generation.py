"""Prompts completed once, within deadlines and rates; empty corpora that fail by name."""

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from offerlens.operators import generation as G
from offerlens.plans import retrieval as RP


def calls(folder):
    return [open(os.path.join(folder, f)).read() for f in os.listdir(folder)]


def responder(folder, hang="", refuse=""):
    def load():
        def answer(prompts):
            for p in prompts:
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                    f.write(p)
            if hang and any(hang in p for p in prompts):
                time.sleep(600)
            if refuse and any(refuse in p for p in prompts):
                raise ValueError("refused")
            return [p.upper() for p in prompts]
        return answer
    return load


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls")


def test_each_prompt_is_sent_once_for_all_rows_and_runs(spark, folder, tmp_path):
    df = spark.createDataFrame([(i, None if i == 39 else f"p{i % 10}") for i in range(40)], "i int, prompt string").repartition(4)
    store = str(tmp_path / "store")
    for rows in (df, df, df.where("i < 5")):
        got = {r.i: r.response for r in G.complete(rows, "prompt", responder(folder), store).collect()}
        assert all(got[i] == (None if i == 39 else f"P{i % 10}") for i in got)
    assert sorted(calls(folder)) == sorted(f"p{i}" for i in range(10))
    more = spark.createDataFrame([(1, "p1"), (2, "new")], "i int, prompt string")
    assert {r.response for r in G.complete(more, "prompt", responder(folder), store).collect()} == {"P1", "NEW"}
    assert len(calls(folder)) == 11


def test_a_hung_call_becomes_null_in_time(spark, folder, tmp_path):
    df = spark.createDataFrame([(i, "hang" if i == 3 else f"p{i}") for i in range(12)], "i int, prompt string").coalesce(1)
    start = time.monotonic()
    limits = G.Limits(batch=4, deadline_s=1.0, retries=3)
    got = {r.i: r.response for r in G.complete(df, "prompt", responder(folder, hang="hang"), str(tmp_path / "s"), limits=limits, workers=1).collect()}
    assert got == {i: None if i == 3 else f"P{i}" for i in range(12)} and time.monotonic() - start < 60
    errors = G.responses(spark, str(tmp_path / "s")).where("response is null").collect()
    assert len(errors) == 1 and "within 1.0 s" in errors[0].error


def test_failures_are_retried_and_given_up(spark, folder, tmp_path):
    df = spark.createDataFrame([(0, "bad"), (1, "good")], "i int, prompt string").coalesce(1)
    store, limits = str(tmp_path / "s"), G.Limits(batch=1, retries=2)
    for _ in range(4):
        got = {r.i: r.response for r in G.complete(df, "prompt", responder(folder, refuse="bad"), store, limits=limits, attempts=2).collect()}
        assert got == {0: None, 1: "GOOD"}
    assert sorted(calls(folder)) == ["bad"] * 6 + ["good"]  # three tries in each of two runs


def test_the_rate_is_kept(spark, folder):
    caller = G._Caller(responder(folder)(), G.Limits(batch=1, calls_per_s=20))
    start = time.monotonic()
    for i in range(11):
        caller.tried([f"p{i}"])
    assert 0.45 < time.monotonic() - start < 5
    with pytest.raises(ValueError):
        G.Limits(calls_per_s=0)


def test_an_empty_corpus_fails_by_name(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.range(5).selectExpr("id", "cast(id as string) text", "array(1.0) v").write.parquet(path)
    full = spark.read.parquet(path)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "no job")
    checked, empty = RP.not_empty(full, "interactions"), RP.not_empty(full.where("id > 99"), "interactions of nobody")
    assert list(tracker.getJobIdsForGroup("plan")) == []
    spark.sparkContext.setJobGroup("other", "")
    assert sorted(r.id for r in checked.collect()) == [0, 1, 2, 3, 4] and checked.schema.fieldNames() == full.schema.fieldNames()
    with pytest.raises(Exception, match="interactions of nobody: the corpus is empty"):
        empty.collect()
    with pytest.raises(Exception, match="of nobody"):
        empty.write.parquet(str(tmp_path / "out"))
    assert checked.where(F.col("id") == 3).count() == 1
