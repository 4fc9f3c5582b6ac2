"""The size of what a fit brings to the driver, and the number of tasks it has."""

import numpy as np
from pyspark.sql import functions as F

from offerlens.operators import ml as ML
from offerlens.plans import catalog
from offerlens.plans.subscriber import build_subscribers


def test_word_vectors_do_not_grow_with_the_words(spark):
    texts = spark.createDataFrame([(f"all of w{i} and w{i} and v{i % 7}",) for i in range(300)], "text string")
    count = lambda m: m.stages[2].getVectors().count()
    assert count(ML.fit_trained(texts, dim=8)) == 310  # every word that occurs twice
    shared = ML.fit_trained(texts, dim=8, word_rows=64)
    assert count(shared) <= 64
    norms = [float(np.linalg.norm(r.embedding)) for r in ML.embed(shared, texts).collect()]
    assert len(norms) == 300 and all(abs(x - 1) < 1e-4 for x in norms)


def test_every_text_and_every_word_is_trained(spark):
    count = lambda m: m.stages[2].getVectors().count()
    words = spark.createDataFrame([(" ".join(f"w{i * 500 + j}" for j in range(500)),) for i in range(70)] * 2, "text string")
    assert count(ML.fit_trained(words, dim=2)) == 35_000  # each its own
    texts = spark.range(300_000).select(F.expr("if(id < 20000, concat('w', id div 2), 'common')").alias("text"))
    assert count(ML.fit_trained(texts, dim=2)) == 10_001  # none is left out


def test_few_and_many_texts_are_trained_alike(spark):
    tasks = lambda n: ML.fit_trained(spark.range(n).selectExpr("'a common text' AS text"), dim=2).stages[2].parts
    assert tasks(20) == tasks(12_000) == tasks(60_000)


def test_two_fits_give_equal_vectors(spark):
    texts = spark.range(12_000, numPartitions=4).selectExpr("concat_ws(' ', 'a', concat('b', id % 11), concat('c', id % 7), concat('d', id % 5)) AS text")
    read = lambda: {r.word: list(r.vector) for r in ML.fit_trained(texts, dim=8).stages[2].getVectors().collect()}
    first = read()
    assert len(first) == 24 and read() == first


def test_the_fit_has_a_task_for_each_core(spark, sf_small, monkeypatch):
    seen = []

    class Kept:
        def fit(self, table):
            seen.append(table.rdd.getNumPartitions())

    monkeypatch.setattr(ML, "propensity_pipeline", lambda **kw: Kept())
    ML.fit_propensity(build_subscribers(spark, sf_small).coalesce(1))
    assert seen == [spark.sparkContext.defaultParallelism]


def test_model_inputs_are_staged_once_in_a_file_for_each_core(spark, sf_small):
    rows = catalog._scored_subs(spark, sf_small)
    assert rows.inputFiles() == catalog._scored_subs(spark, sf_small).inputFiles()
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows.count() == build_subscribers(spark, sf_small).count()


def test_trees_are_walked_by_batches(spark):
    nodes = spark.createDataFrame([(0, 0.5, 0, 1, 2.0, None, 1, 2, 0.0), (0, 0.5, 1, -1, None, None, -1, -1, -1.0), (0, 0.5, 2, 0, None, 5, 3, 4, 0.0),
                                   (0, 0.5, 3, -1, None, None, -1, -1, 2.0), (0, 0.5, 4, -1, None, None, -1, -1, 4.0), (1, 2.0, 0, -1, None, None, -1, -1, 0.25)], ML.NODES)
    rows = [(0, [0.0, 2.0], -1.0), (1, [0.0, 2.5], 2.0), (2, [1.0, 3.0], 4.0), (3, [2.0, 3.0], 2.0)]
    df = spark.createDataFrame([(i, x) for i, x, _ in rows], "i int, x array<double>")
    got = {r.i: r.p for r in df.select("i", ML.walked_probability(nodes, F.col("x")).alias("p")).collect()}
    for i, _, leaf in rows:
        assert abs(got[i] - 1 / (1 + np.exp(-2 * (0.5 * leaf + 2.0 * 0.25)))) < 1e-12
