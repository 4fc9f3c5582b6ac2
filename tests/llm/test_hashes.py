"""Hashes of words, A-Z lower-casing and the import of the rest without the subpackage."""

import re

import numpy as np
import pytest

from offerlens.llm import bpe, common, exact_dedup, minhash_dedup
from offerlens.llm.common import stage

LATER_LETTERS = "ⰯꟀꟐ\U00010570ᲉꟋÀİẞ"
DOCS = "doc_id long, text string"


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.fixture(scope="module")
def adverse(spark):
    words = [w for n in (1024, 4096) for w in (thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba")))]
    rows = [(i, w) for i, w in enumerate(words)] + [(10 + i, f"one two three {w} five six") for i, w in enumerate(words)]
    return rows


def test_only_a_to_z_is_lower_cased(spark):
    letters = [(i, f"x{c} AZ") for i, c in enumerate(LATER_LETTERS)]
    got = spark.createDataFrame(letters, DOCS).select(exact_dedup.lower_a_to_z("text").alias("t"), "text").collect()
    assert all(r.t == r.text.translate({c: c + 32 for c in range(65, 91)}) for r in got)
    docs = stage(spark.createDataFrame([(1, "xꟀ"), (2, "xꟁ"), (3, "Xꟁ")], DOCS), "letters")
    assert {r.id: r.keep_id for r in exact_dedup.exact_groups(docs, keep="largest").collect()} == {1: 1, 2: 3, 3: 3}
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs, keep="largest").collect()) == [1, 3]


def test_words_that_collide_in_polynomials(spark, adverse):
    data = "".join(w for _, w in adverse).encode()
    ends = np.cumsum([len(w) for _, w in adverse])
    starts = ends - [len(w) for _, w in adverse]
    hashes = common.span_hashes(np.frombuffer(data, np.uint8), starts, ends)
    assert len(set(hashes.tolist())) == len(adverse)
    groups = {r.id: (r.n, r.component) for r in minhash_dedup.near_groups(stage(spark.createDataFrame(adverse, DOCS), "tm")).collect()}
    assert groups == {i: (1 if i < 10 else 2, i) for i, _ in adverse}


def encoded(spark, rows):
    from offerlens.llm.queries import tokenizer_path
    docs = stage(spark.createDataFrame(rows, DOCS), "bpe")
    return {r.id: (r.ids, r.decoded) for r in bpe.encode(docs, tokenizer_path(), decoded=True).collect()}


def test_equal_hashes_of_unequal_words_change_no_ids(spark, adverse, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    from offerlens.llm.queries import tokenizer_path
    tok = tokenizers.Tokenizer.from_file(tokenizer_path())
    rows = [*adverse, (30, "a bb cc a bb dd aa"), (31, "")]
    want = {i: (tok.encode(w, add_special_tokens=False).ids, w) for i, w in rows}
    assert encoded(spark, rows) == want
    block, texts = bpe._Block(), ["ab cd ab ef", "cd gh ab"]
    monkeypatch.setattr(bpe, "span_hashes", lambda v, a, b, seed=1: (b - a).astype(np.uint64))
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        block.add(np.zeros(1, np.int64), np.ones(1, np.uint8), bpe._split(raw, np.array([0, len(raw)]), []))
    assert [b"".join(block.words[k] for k in codes).decode() for _, _, _, codes in block.docs] == texts
    assert len(set(block.words)) == len(block.words) and len(block.hashes) == len(block.words)


def test_spans_hash_alike_anywhere():
    text = b"abc abd abc abcd"
    spans = [m.span() for m in re.finditer(rb"\S+", text)]
    h = common.span_hashes(np.frombuffer(text, np.uint8), np.array([a for a, _ in spans]), np.array([b for _, b in spans])).tolist()
    assert h[0] == h[2] and len(set(h)) == 3
