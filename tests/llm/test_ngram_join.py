"""The n-gram Jaccard join against brute force, and its edge cases."""

import random

import numpy as np
import pytest

from offerlens.llm import ngram_join
from offerlens.llm.common import stage

DOCS = "doc_id long, text string, node string, shingle string, label string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=4):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    """(n, component) of each row; rows of one id are one document."""
    sets = [shingles(t) for _, t in rows]
    comp = {i: i for i, _ in rows if i is not None}
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][0], rows[b][0]
            if x is not None and y is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((comp[x], comp[y]))
                comp = {k: low if c == high else c for k, c in comp.items()}
    return sorted(((i if i is not None else -1), len(s), -1 if i is None else comp[i]) for (i, _), s in zip(rows, sets))


def joined(spark, rows, parts=3):
    docs = stage(spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS).repartition(parts), "docs")
    minus = lambda v: -1 if v is None else v
    return sorted((minus(r.id), r.n, minus(r.component)) for r in ngram_join.jaccard_groups(docs).collect())


@pytest.fixture(scope="module")
def mixed():
    random.seed(5)
    texts, base = [], [f"t{i}" for i in range(200)]
    for i in range(40):  # a chain: each text differs a little from the one before
        base = base[3:] + [f"n{i}_{j}" for j in range(3)]
        texts.append(" ".join(base))
    passage = " ".join(f"p{i}" for i in range(60))
    for share in (8, 30, 60):  # a passage that many documents share, in documents that are alike and in others
        texts += [passage + " " + " ".join(f"u{share}_{k}_{i}" for i in range(share)) for k in range(15)]
    group = [f"g{i}" for i in range(300)]
    for k in range(60):  # near copies of one text, which are less alike among themselves
        w = list(group)
        for _ in range(random.randrange(1, 12)):
            w[random.randrange(300)] = f"x{random.random()}"
        texts.append(" ".join(w))
    texts.append(" ".join(group).upper())
    texts += ["one two three", "One TWO three", "one two", "a b c d", "a b c d e", "a b c d", " ".join(["w"] * 50)]
    random.shuffle(texts)
    return list(enumerate(texts))


def test_components_of_all_links(spark, mixed):
    assert joined(spark, mixed) == brute(mixed)


def test_the_last_step_finds_what_no_leader_did(spark, mixed, monkeypatch):
    monkeypatch.setattr(ngram_join, "leader_pairs", lambda placed, k, percent: stage(placed.select(*[ngram_join.F.col("node").alias(c) for c in "ab"]).limit(0), "none"))
    assert joined(spark, mixed) == brute(mixed)


def test_prefix_lengths_change_no_link(spark, mixed, monkeypatch):
    random.seed(6)
    monkeypatch.setattr(ngram_join, "chosen_length", lambda f, n, base, most: 1 + int(f.sum() * 1000) % max(1, min(most, len(f) - base)))
    assert joined(spark, mixed[::2]) == brute(mixed[::2])


def test_cases(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, "Same TEXT here now"), (2, "same text HERE now"), (2, "same text HERE now"), (3, None), (4, ""), (5, long), (6, long + " end"),
            (None, "same text here now"), (None, None), (7, " \t\n "), (8, "À b c d e"), (9, "à b c d e")]
    rows += [(100, f"q{i} r{i} s{i} t{i} u{i}") for i in range(5)] + [(120 + i, f"q{i} r{i} s{i} t{i} u{i}") for i in range(5)]
    assert joined(spark, rows) == brute(rows)  # id 100 stands on several texts, which ties their copies together
    assert joined(spark, []) == []


def test_prefixes_share_enough_at_every_length():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        pool = rng.permutation(400)
        a, extra = pool[:n], pool[n:n + int(rng.integers(0, 1 + n * 15 // 85))]
        gone = int(rng.integers(0, max(1, n // 8)))
        b = np.concatenate([a[gone:], extra])
        both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if not len(b) or both * 100 < either * 85:
            continue
        cut = [(sorted(s.tolist()), len(s) - ngram_join.least_shared(len(s), 85)) for s in (a, b)]
        shared = -(-85 * (len(a) + len(b)) // 185)
        for l in range(1, min(ngram_join.least_shared(len(a), 85), ngram_join.least_shared(len(b), 85)) + 1):
            x, y = (set(s[:base + l]) for s, base in cut)
            assert len(x & y) >= l
            x, y = (set(sorted(s.tolist())[:max(0, len(s) - shared + l)]) for s in (a, b))
            assert len(x & y) >= l  # the places that count between two sizes


def test_a_longer_prefix_is_chosen_where_it_saves_work():
    flat = np.full(200, 100.0)
    assert ngram_join.chosen_length(flat, 1000, 80, 8) == 8  # one more lookup among many, an eighth of the verifications
    steep = np.concatenate([np.full(81, 2.0), np.full(119, 1e6)])
    assert ngram_join.chosen_length(steep, 1000, 80, 8) == 1  # the next shingle is frequent
    assert ngram_join.chosen_length(np.ones(200), 1000, 80, 8) == 1  # nobody is met
    assert ngram_join.chosen_length(np.ones(1), 1, 0, 1) == 1 and ngram_join.least_common(100, 100, 85) == 92
