"""Rows are never lost, and plans run no job while they are built."""

import json
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.functions.core import zero_pad
from offerlens.functions.text import is_blank_or_sentinel, strip, tokens
from offerlens.operators import ml as ML
from offerlens.operators.generation import generate_with
from offerlens.operators import retrieval as R
from offerlens.operators import rules
from offerlens.sources import files as FS

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


def test_zero_pad_never_cuts(spark):
    df = spark.createDataFrame([(n,) for n in (0, 7, 99, 100, 1234)], "n int")
    assert [r[0] for r in df.select(zero_pad(F.col("n"), 2)).collect()] == ["00", "07", "99", "100", "1234"]


def test_ids_of_long_histories_are_unique(spark):
    from offerlens.plans.interactions import sequenced
    rows = [(1, t, "user", "x") for t in range(120)]
    ids = [r.interaction_id for r in sequenced(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert len(set(ids)) == 120


@pytest.mark.parametrize("text", ["", SPACES, f"{SPACES}a b{SPACES}", "a", f"a{SPACES}b", "a\n"])
def test_strip_and_split_as_in_python(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(strip(F.col("t")), tokens(F.col("t")), is_blank_or_sentinel(F.col("t"))).first()
    assert (row[0], row[1], row[2]) == (text.strip(), text.lower().split(), not text.strip())


def test_blank_message_is_not_accepted(spark):
    names = sorted({x for x in ("overage", "days_renewal", "data_pct", "value_qar", "data_used_gb", "data_cap_gb", "arpu", "voice_min", "nps",
                                "tenure_m", "dl_speed", "latency_ms", "net_complaints")})
    df = spark.createDataFrame([(json.dumps({"rationale": "why", "message": "\n\t "}), "SMS")], "response string, channel string")
    df = df.select("*", *[F.lit(1.0).alias(x) for x in names])
    got = df.select(rules.adjudicate(F.col("response"), F.lit("rule why"), F.lit("rule how")).alias("g")).first().g
    assert (got.rationale, got.message, got.gen_source) == ("rule why", "rule how", "offline")


def corpus(spark, vectors):
    rows = [(i, i % 2, v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "interaction_id long, customer_id long, embedding array<float>")


def test_mixed_lengths_and_missing_query(spark):
    df = corpus(spark, [[1.0, 0.0], [0.5, 0.5], [1.0, 1.0, 1.0], [0.0, 1.0]])
    hits = R.exact_topk(R.score(df.where("interaction_id > 0"), R.query_vector(df, 0)), 3)
    assert {r.interaction_id for r in hits.collect()} == {1, 3}
    assert R.exact_topk(R.score(df, R.query_vector(df, 99)), 3).collect() == []
    assert R.exact_topk(R.score(df.limit(0), R.query_vector(df.limit(0), 0)), 3).collect() == []


def test_own_queries_keep_every_customer(spark):
    df = corpus(spark, [[1.0, 0.0], [0.0, 1.0], [0.9, 0.1], [0.1, 0.9], [0.5, 0.5], [0.4, 0.6]])
    hits = R.scoped_topk(df, R.own_queries(df), 1).collect()
    assert {(r.customer_id, r.interaction_id) for r in hits} == {(0, 2), (1, 3)}


def test_building_retrieval_plans_runs_no_job(spark, sf_small):
    from offerlens.plans.catalog import QUERIES
    names = ["ret_exact_topk", "ret_evaluate", "join_customer_scope", "ext_multi_query", "agg_misses_fps"]
    for n in names:
        QUERIES[n](spark, sf_small)  # reads the schemas
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans only")
    for n in names:
        QUERIES[n](spark, sf_small)
    jobs = tracker.getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("other", "")
    assert list(jobs) == []


def test_ret_evaluate_reads_few_tables(spark, sf_small):
    from offerlens.plans.catalog import QUERIES
    plan = QUERIES["ret_evaluate"](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    scans = re.findall(r"Relation \[(\w+)", plan)
    # documents once, labels at most twice; embeddings for the corpus, the hits and the (shared) query row
    assert scans.count("doc_id") <= 3 and plan.count("text#") and len(re.findall(r"Relation \[doc_id\S*,text", plan)) == 1
    assert len([x for x in re.findall(r"Filter NOT vec_id", plan)]) <= 2


def test_one_bad_prompt_nulls_one_row(spark):
    def load():
        def answer(prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("refused")
            return [p.upper() for p in prompts]
        return answer
    df = spark.createDataFrame([(i, "bad" if i == 37 else f"p{i}") for i in range(80)], "i int, prompt string").coalesce(2)
    got = {r.i: r.response for r in generate_with(df, "prompt", load).collect()}
    assert got[37] is None and all(got[i] == f"P{i}" for i in got if i != 37)
    short = generate_with(df, "prompt", lambda: lambda ps: ["x"] if len(ps) == 1 else [])
    assert [r.response for r in short.collect()] == ["x"] * 80


def test_models_are_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid
        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: np.ones((len(texts), 3))
    df = spark.range(64).selectExpr("id", "cast(id as string) text").repartition(16)
    out = ML.embed_with(df, "text", load, 3).collect()
    assert len(out) == 64 and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in out)
    loads = os.listdir(folder)
    assert len(loads) == len({f.split("-")[0] for f in loads}) <= 8


def test_vector_files_of_a_hot_customer_are_even(spark, tmp_path):
    df = spark.range(30_000).selectExpr("id interaction_id", "if(id % 3 = 0, 1, id % 500) customer_id", "array(cast(id as float)) embedding")
    path = FS.write_vectors(df, str(tmp_path / "v"), n_files=8)
    sizes = [r[1] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes) and sum(sizes) == 30_000


def test_csv_with_line_breaks_is_one_line_a_row(spark, tmp_path):
    rows = [("a\nb", 1), ("c\\n \\ d", 2), ("e\r\n\"f\", g", 3), (None, 4), ("None", 5)]
    df = spark.createDataFrame(rows, "t string, n int")
    path = FS.write_csv(FS.escape_breaks(df), str(tmp_path / "c"))
    assert spark.read.text(path).where("value <> 't,n'").count() == 5
    back = FS.unescape_breaks(FS.read_csv(spark, path, df.schema))
    assert sorted((r.n, r.t) for r in back.collect()) == sorted((n, t) for t, n in rows)


def test_only_local_masters_get_loopback_and_private_folders():
    from offerlens.session import is_local
    assert is_local("local") and is_local("local[4]") and not is_local("local-cluster[2,1,1024]") and not is_local("spark://h:7077")
