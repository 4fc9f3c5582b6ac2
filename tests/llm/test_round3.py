"""Large groups of near misses in op2, and the memory of workers that split or encode texts."""

import random
import tracemalloc

import pytest

import corpus_pipeline
from offerlens.llm import bpe, minhash_dedup
from offerlens.llm.common import stage


def test_near_misses_of_a_large_group_are_not_paired(spark, monkeypatch):
    random.seed(8)
    base, texts = [f"g{i}" for i in range(120)], []
    for k in range(160):  # copies of one text, most with too many changes to be linked with it
        w = list(base)
        for i in random.sample(range(4, 116), 4 if k < 100 else 1):
            w[i] = f"x{k}_{i}"
        texts.append(" ".join(w))
    twin = texts[0].split()
    twin[60] = "twin"  # linked with a near miss only
    texts += [" ".join(twin), " ".join(base)]
    random.shuffle(texts)
    sets = [{tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    asked, confirmed = {}, minhash_dedup.confirmed

    def counted(pairs, docs, name, *rest):
        asked[name] = pairs.count()
        return confirmed(pairs, docs, name, *rest)

    monkeypatch.setattr(minhash_dedup, "confirmed", counted)
    monkeypatch.setattr(minhash_dedup, "SLICE", 16)
    docs = stage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    got = {r.id: r.component for r in minhash_dedup.near_groups(docs).collect()}
    assert got == dict(enumerate(comp))
    assert asked["last"] <= 1000  # of some 6,000 pairs of a near miss and a near copy


class Docs:
    """Keeps what ``split_words`` would run in a task."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


@pytest.mark.parametrize("kind", [0, 1])
def test_splitting_needs_little_beside_the_texts(spark, kind):
    import pyarrow as pa

    random.seed(9)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(random.choices(words, k=400)) for _ in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(800), pa.int64()), pa.array(texts), pa.array([0] * 800, pa.int32())],
                                       names=["id", "text", "scan"])
    bpe.classes()
    task = bpe.split_words(Docs(), [], 8, kind, "doc_id", "text")
    tracemalloc.start()
    try:
        rows = sum(r.num_rows for r in task.run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows and peak < 30e6


def test_the_pipeline_sends_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("10000", "2000"), ("0", "2000"), ("500", "500")):
            spark.conf.set(key, given)
            corpus_pipeline.small_batches(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)
