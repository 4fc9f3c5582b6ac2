"""Training reads all labelled texts, whole, and does not depend on how rows lie in tasks."""

import numpy as np
from pyspark.sql import functions as F

from offerlens.llm import toxicity

EVERY = lambda c: F.lit(True)


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_every_labelled_text_is_learned_from(spark):
    name = lambda i: "".join(chr(97 + int(d)) for d in f"{i:06d}")
    docs, labels = tables(spark, [(i, f"word {name(i)}", i % 2) for i in range(11_000)])  # 5,500 of each label
    model, _ = toxicity.learn(docs, labels, EVERY)
    fitted = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(toxicity.VALIDATION)) != 0).collect()
    raw = [r.text.encode() for r in fitted]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    word, _, _ = toxicity.hashed_words(np.frombuffer(b"".join(raw), np.uint8), off)
    assert len(fitted) > 8_000 and model.words[word].any(1).all()  # rows never seen are zero


def test_long_texts_are_learned_from(spark):
    rows = [(i, "kolan risit " * 10_000 + ("vilescum" if i % 2 else "tunosh"), i % 2) for i in range(60)]  # 120,000 bytes each
    model, samples = toxicity.learn(*tables(spark, rows), EVERY)
    short = spark.createDataFrame([(1, "kolan vilescum"), (2, "kolan tunosh")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(short, model, samples).collect()}
    assert score[1] > score[2]


def test_the_model_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i, f"kolan {'vilescum' if i % 3 == 0 else 'tunosh'} {'abcdefg'[i % 7] * 3}", int(i % 3 == 0)) for i in range(300)]
    one, _ = toxicity.learn(*tables(spark, rows), EVERY)
    docs, labels = tables(spark, rows[::-1])
    two, _ = toxicity.learn(docs.repartition(5), labels, EVERY)
    assert (toxicity.flat(one) == toxicity.flat(two)).all() and one.threshold == two.threshold


def test_gradients_are_those_of_the_log_loss():
    rng = np.random.default_rng(1)
    counts = np.zeros((2, 2 * toxicity.ROWS))
    words = [rng.integers(0, 40, n) for n in (5, 0, 1, 9)]
    counts[:, np.concatenate([np.arange(40), toxicity.ROWS + np.arange(40)])] = rng.integers(0, 9, (2, 80))
    weights, y = toxicity.flat(toxicity.initial(counts, np.array([20, 20]))), np.array([0, 1, 1, 0])
    word, off = np.concatenate(words), np.concatenate([[0], np.cumsum([len(w) for w in words])])
    row = np.repeat(np.arange(4), np.diff(off))

    def loss(w):
        z = toxicity.unflat(w).logits(word, word, row, 4).astype(float)
        return np.sum(np.log1p(np.exp(z)) - y * z)

    total = np.zeros(weights.shape, np.int64)
    toxicity.add_gradients(toxicity.unflat(weights), word, word, off, y, total)
    for at in [(int(word[0]), 0), (toxicity.ROWS + int(word[7]), 1), (2 * toxicity.ROWS + 3, 2), (2 * toxicity.ROWS + 29, 1), (2 * toxicity.ROWS + 30, 0)]:
        up, down = weights.copy(), weights.copy()
        up[at] += 1e-3
        down[at] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - total[at] / toxicity.UNIT) < 2e-3
