"""The registered queries against DuckDB or against brute force on sf0.001."""

import hashlib
import os
import re
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as E

QUERIES, ORACLE = E.queries(), E.oracle_sql()
SQL = ["op3_url_filters", "op8_secret_ledger", "op9_exact_dedup", "op11_ngram_join", "op12_zone_clusters", "op13_orchard_codes"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("select doc_id, text, lang, source from documents").fetchall()


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, duck, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLE[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert cols == sorted(rel.columns)
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want


def test_every_operator_is_registered_once():
    for n in range(1, 14):
        assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in QUERIES


def test_op1_reads_the_article(spark, duck, sf_small):
    import html
    rows = {r.page_id: r for r in QUERIES["op1_html_extraction"](spark, sf_small).collect()}
    for page_id, page in duck.sql("select page_id, html from pages").fetchall():
        article = re.search("<article>(.*?)</article>", page, re.S)[1]
        blocks = re.split("\x00", re.sub(r"</?(?:p|h1)>", "\x00", article.replace("<br>", " ").replace("<b>", "")))
        want = "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert rows[page_id].text == want and rows[page_id].n_chars == len(want)


def near_components(docs):
    sets = {}
    for i, t, *_ in docs:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return sets, comp


def test_op2_matches_brute_force(spark, docs, sf_small):
    sets, comp = near_components(docs)
    rows = QUERIES["op2_minhash"](spark, sf_small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)


def test_op4_held_out_accuracy(spark, docs, sf_small):
    import zlib
    lang = {i: x for i, _, x, _ in docs}
    rows = QUERIES["op4_language_id"](spark, sf_small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op5_matches_the_tokenizer(spark, docs, sf_small):
    tokenizers = pytest.importorskip("tokenizers")
    from offerlens.llm.queries import tokenizer_path
    tok = tokenizers.Tokenizer.from_file(tokenizer_path())
    rows = {r.doc_id: r for r in QUERIES["op5_bpe"](spark, sf_small).collect()}
    assert len(rows) == len(docs)
    for i, t, *_ in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op6_held_out_accuracy(spark, duck):
    import zlib
    rows = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = duck.sql("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet'").fetchall()
    held = [(rows[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out and (r.predicted == 1) == (r.score >= 0.5) and 0 <= r.score <= 1 for r, _ in held)
    assert sum(r.predicted == y for r, y in held) >= 0.96 * len(held)
    clean = [r for r, y in held if not y]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def mix_targets(sizes, share=1.5, most=2):
    """By the words of the contract: deal, cut at twice the size, deal the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-6 and open_:
        total = sum(weight[s] for s in open_)
        dealt, left = left, 0.0
        for s in list(open_):
            target[s] += dealt * weight[s] / total
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_op7_meets_the_targets(spark, docs, sf_small):
    size = {i: len(words(t)) for i, t, _, _ in docs}
    source = {i: s for i, _, _, s in docs}
    total, largest = defaultdict(int), defaultdict(int)
    for i, s in source.items():
        total[s] += size[i]
        largest[s] = max(largest[s], size[i])
    target = mix_targets(total)
    rows = QUERIES["op7_source_mix"](spark, sf_small).collect()
    again = QUERIES["op7_source_mix"](spark, sf_small).collect()
    assert sorted(rows) == sorted(again) and len(rows) == len(docs)
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s] and r.taken in (0, r.size, 2 * r.size)
        assert r.target == pytest.approx(target[s])
        taken[s] += r.taken
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1


def test_op10_recall_and_order(spark, sf_small):
    table = spark.read.parquet(os.path.join(sf_small, "embeddings.parquet")).collect()
    ids = np.array([r.vec_id for r in table])
    vec = np.array([r.embedding for r in table], float)
    found = defaultdict(list)
    for r in QUERIES["op10_nearest"](spark, sf_small).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    queries = [i for i in ids if i % 20 == 0]
    for q in queries:
        scores = vec @ vec[ids == q][0]
        want = sorted((-s, i) for s, i in zip(scores, ids) if i != q)[:20]
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert [(s, -i) for _, i, s in got] == sorted(((s, -i) for _, i, s in got), reverse=True)
        for _, i, s in got:
            assert s == pytest.approx(scores[ids == i][0], abs=1e-12)
        hits += len({i for _, i in want} & {i for _, i, _ in got})
    assert hits >= 0.9 * 20 * len(queries)


def test_pipeline_stages_against_brute_force(spark, docs, sf_small):
    import corpus_pipeline as C
    table = spark.read.parquet(os.path.join(sf_small, "documents.parquet"))
    columns = table.columns
    kept = {r.doc_id: r.text for r in C.language_id(spark, table, sf_small).collect()}
    assert {i for i, t, *_ in docs if t and re.search(r"[^\W\d_]", t)} >= set(kept) and len(kept) >= 0.99 * len(docs)
    exact = C.exact(spark, table, sf_small)
    best = {}
    for i, t, *_ in docs:
        k = (t or "").translate(LOWER)
        best[k] = max(best.get(k, i), i)
    assert exact.columns == columns and sorted(r.doc_id for r in exact.collect()) == sorted(best.values())
    near = C.near(spark, table, sf_small)
    _, comp = near_components(docs)
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted(set(comp.values()))
    mixed = C.mix(spark, table, sf_small)
    assert mixed.columns == columns
    got, want = defaultdict(int), {}
    for r in mixed.collect():
        got[r.doc_id] += 1
    for r in QUERIES["op7_source_mix"](spark, sf_small).collect():
        want[r.doc_id] = r.taken // r.size if r.size else got[r.doc_id]
    assert got == {k: v for k, v in want.items() if v}
    text = {i: t or "" for i, t, *_ in docs}
    for r in C.encode(spark, table, sf_small).collect():
        assert r.text == text[r.doc_id] and r.n_tokens == len(r.ids)


def test_pipeline_runs(spark, sf_small):
    rows = QUERIES["pipeline"](spark, sf_small).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
