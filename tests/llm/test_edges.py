"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm import (ann, bpe, exact_dedup, html_extract, langid, minhash_dedup, mixing, secrets, toxicity,
                           url_rules)
from offerlens.llm.common import stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=DOCS):
    return stage(spark.createDataFrame(rows, schema), "edge")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, "Same TEXT here", "en", "a", 1), (2, "same text HERE", "en", "a", 1), (2, "same text HERE", "en", "a", 1),
            (3, None, None, None, None), (4, "", "en", None, 0), (5, long, "en", "b", 1), (6, long + " end", "en", "b", 1),
            (None, "Same text here", "en", "a", 1), (None, None, None, "b", None), (7, "ÀÉ same", "fr", "b", 1), (8, "àé same", "fr", "b", 1)]
    return table(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


# ------------------------------------------------------------------ 1
def extract(spark, pages):
    df = spark.createDataFrame([(i, p, "other") for i, p in enumerate(pages)], "page_id long, html string, text string")
    return [r.text for r in html_extract.extract(df).orderBy("page_id").collect()]


def test_html_cases(spark):
    body = "".join(f"<p>Sentence number {i} of the text &amp; more.</p>" for i in range(5))
    text = "\n".join(f"Sentence number {i} of the text & more." for i in range(5))
    page = (f"<html><head><title>T</title><script>if (a<b) '</p>'</script></head><body><nav><a href='/'>Home</a></nav>"
            f"<article><h1>Head &lt;line&gt;</h1>{body}<div class='ad box'>Buy now</div><!-- note <p>x</p> -->"
            "<p>Last\n\t one<br>line</p><form><input><label>Name</label></form>"
            "<section class=\"comments\"><p>reader says</p></section></article><footer>foot</footer></body></html>")
    got = extract(spark, [page, None, "", "plain words only", page, "<p>cut off &am", "<div><span></span></div>", "<script>x"])
    assert got[0] == got[4] == f"Head <line>\n{text}\nLast one line"
    assert got[1] == got[2] == got[6] == got[7] == ""
    assert got[3] == "plain words only" and got[5] == "cut off &am"
    assert extract(spark, []) == []


def test_html_elements_around_the_content_and_closes_left_out(spark):
    body = "".join(f"<p>Sentence number {i} of the text and more.</p>" for i in range(5))
    text = "\n".join(f"Sentence number {i} of the text and more." for i in range(5))
    ad, tail = "<div class='ad'>Buy now</div>", "<p>Last line of it.</p>"
    article, plain = f"<article>{body}{ad}</article>", f"<div>{body}{ad}</div>"
    around = [f"<body class='right-sidebar'>{article}</body>", f"<body><div class='has-sidebar'>{article}</div></body>",
              f"<body><div id='page' class='share-enabled'>{article}</div><footer>foot</footer></body>", f"<body><form>{article}</form></body>",
              f"<body class='right-sidebar'>{plain}</body>", f"<div class='has-sidebar'>{plain}</div>", f"<form>{plain}</form>"]
    assert extract(spark, around) == [text] * len(around)
    inside = ["<p class='notice'>Note<p>", "<svg/><p>", "<svg><path/><title/></svg><p>", "<math/><p>", "<svg><path><p>",
              "<ul><li class='share'>Share<li>", "<table><tr><td class='ad'>Buy<td>", "<p><span class='ad'>Buy</p><p>"]
    ends = {"<ul>": "</ul>", "<tab": "</table>"}
    pages = [f"<body><article>{body}{x}Some more words here{ends.get(x[:4], '')}{tail}</article></body>" for x in inside]
    assert extract(spark, pages) == [f"{text}\nSome more words here\nLast line of it."] * len(pages)
    cookie = "<div class='cookie-consent'>" + "<p>We use cookies for this and that and more.</p>" * 9 + "</div>"
    assert extract(spark, [*[f"<body>{article}</body>"] * 20, f"<body>{cookie}{article}</body>"]) == [text] * 21


def test_best_region_against_all_ranges():
    random.seed(1)
    for _ in range(200):
        v = [random.randint(-5, 5) for _ in range(random.randint(0, 12))]
        a, b = html_extract.best_region(v)
        assert sum(v[a:b]) == max([0] + [sum(v[i:j]) for i in range(len(v)) for j in range(i, len(v) + 1)])


# ------------------------------------------------------------------ 2
def test_minhash_cases(spark, odd, none):
    rows = [tuple(r) for r in minhash_dedup.near_groups(odd).collect()]
    assert len(rows) == 11
    comp = {(i, n): c for i, n, c in rows}
    assert comp[(1, 1)] == comp[(2, 1)] == 1 and comp[(5, 59_996)] == comp[(6, 59_997)] == 5
    assert comp[(3, 0)] == 3 and comp[(4, 0)] == 4 and comp[(7, 1)] == 7 and comp[(8, 1)] == 8
    assert comp[(None, 1)] is None and comp[(None, 0)] is None
    assert minhash_dedup.near_groups(none).collect() == []


def test_minhash_chains_large_groups_and_thresholds(spark):
    random.seed(3)
    base = [f"t{i}" for i in range(200)]
    rows, texts = [], []
    for i in range(60):  # a chain: each text differs a little from the one before
        base = base[4:] + [f"n{i}_{j}" for j in range(4)]
        texts.append(" ".join(base))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{k}_{i}" for i in range(60)) for k in range(40)]  # alike, but too little
    group = [f"g{i}" for i in range(300)]
    for k in range(80):  # one large group of near copies
        w = list(group)
        w[random.randrange(300)] = f"x{k}"
        texts.append(" ".join(w))
    random.shuffle(texts)
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    sets = [{tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    got = {r.id: r.component for r in minhash_dedup.near_groups(table(spark, rows)).collect()}
    assert got == dict(enumerate(comp))


def test_slices_of_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SLICE", 7)
    monkeypatch.setattr(minhash_dedup, "ROUNDS", 1)
    test_minhash_chains_large_groups_and_thresholds(spark)


def test_sketches_estimate_similarity():
    random.seed(4)
    pool = minhash_dedup.mix64(np.arange(4000, dtype=np.uint64))
    for share in (0.5, 0.75, 0.9):
        errors = []
        for k in range(60):
            both = int(300 * share)
            some = np.array(random.sample(range(4000), 600 - both))
            a, b = np.unique(pool[some[:300]]), np.unique(pool[np.concatenate([some[:both], some[300:600 - both]])])
            sk = minhash_dedup._sketches(np.array([len(a), 0, len(b)]), np.concatenate([a, b])).to_pylist()
            x, y = np.frombuffer(sk[0], np.uint8), np.frombuffer(sk[2], np.uint8)
            assert sk[1] is None
            errors.append(((x == y) & (x > 0)).sum() / ((x > 0) | (y > 0)).sum() - both / (600 - both))
        assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.035


# ------------------------------------------------------------------ 3
def test_url_cases(spark):
    urls = ["HTTP://A.Example.ORG/es/x?y", "http://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/fr",
            "http://com/de/1", "http://notexample.org", "no url", None, "", "http://www.ads-track.net/x", "x://h.com#/de/", "http://example.org/ES/",
            "http://x.com/de/q"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rows = [(r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df).orderBy("page_id").collect()]
    assert rows == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "/en/2", "org/", "allow"), ("x.com", "/fr/", "com/fr/", "allow"), ("x.com", "/fr", None, "allow"),
        ("com", "/de/1", "com/de/", "block"), ("notexample.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("www.ads-track.net", "/x", None, "block"), ("h.com", "", None, "allow"),
        ("example.org", "/ES/", "org/", "allow"), ("x.com", "/de/q", "com/de/", "block")]
    assert url_rules.judge(df.limit(0)).collect() == []


def test_url_index_fetches_by_the_rarest_token():
    rules = url_rules.LISTED + url_rules.PATTERNS
    filed, always = url_rules.rule_index(rules, {"org": 100, "example": 50, "es": 3, "en": 70, "com": 9, "fr": 10})
    assert 1 in filed["es"] and 2 in filed["example"] and 3 in filed["com"] and not always
    for rule in rules:  # a rule's tokens are whole tokens of whatever it matches
        assert rule.tokens and all(re.fullmatch("[a-z0-9]+", t) for t in rule.tokens)


# ------------------------------------------------------------------ 4
def test_language_cases(spark, none):
    en, de = "the quick brown fox jumps over the lazy dog and runs away ", "der schnelle braune fuchs springt über den faulen hund und rennt "
    rows = [(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de", None, None) for i in range(20)]
    rows += [(100, None, None, None, None), (101, "", "en", None, None), (102, "12 34 !!", None, None, None),
             (103, en * 20_000, None, None, None), (None, de, "de", None, None), (104, "Ωμέγα", None, None, None)]
    docs = table(spark, rows).withColumn("bits", F.lit("clash"))
    samples = langid.learn(docs, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, samples).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") for i in range(20))
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "en" and got[None][0] == "de"
    assert got[104][0] in ("en", "de")
    assert langid.predict(none, samples).collect() == []
    empty = langid.learn(none, F.lit(True))
    assert [r.lang_pred for r in langid.predict(docs.where("doc_id < 3"), empty).collect()] == ["und"] * 3


def test_language_stage_rejects_only_texts_without_letters(spark, none):
    import corpus_pipeline as C
    text = "the quick brown fox jumps over the lazy dog and runs away "
    rows = [(i, text * 3, ("en", "en-US", "en-GB", "EN", "en-AU", None)[i % 6], None, None) for i in range(60)]
    rows += [(100, None, "en", None, None), (101, "", None, None, None), (102, "12 34 !!", "en", None, None),
             (103, "fox", None, None, None), (104, "Ωμέγα και άλλα", None, None, None), (None, text, None, None, None)]
    docs = table(spark, rows)
    assert {r.score for r in langid.predict(docs.where("doc_id < 60"), langid.learn(docs, F.lit(True))).collect()} == {0.2}
    want = sorted(str(r[0]) for r in rows if r[0] not in (100, 101, 102))
    for given in (docs, docs.withColumn("lang", F.lit(None).cast("string"))):
        got = C.language_id(spark, given, "")
        assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == want
    assert C.language_id(spark, none, "").collect() == []


def test_phrases_against_greedy_matching():
    random.seed(5)
    sample = "".join(random.choice("abcd ") for _ in range(300))
    samples = langid.Samples((("x", sample),), "abcd")
    table_, roots, _, symbol = langid.parser(samples)
    for _ in range(50):
        text = "".join(random.choice("abcde ") for _ in range(random.randint(1, 60)))
        sym = [int(symbol[ord(c)]) for c in text]
        mine = [int(symbol[ord(c)]) for c in sample]
        inside = {tuple(mine[i:j]) for i in range(len(mine)) for j in range(i + 1, min(len(mine), i + 61) + 1)}
        want, at = 0, 0
        while at < len(sym):
            end = at + 1
            while end < len(sym) and tuple(sym[at:end + 1]) in inside:
                end += 1
            want, at = want + 1, end
        got = langid.phrase_counts(table_, roots, np.array(sym, np.int32), np.array([0]), np.array([len(sym)]))
        assert got[0, 0] == want


# ------------------------------------------------------------------ 5
def test_bpe_cases(spark, odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    from offerlens.llm.queries import tokenizer_path
    path = tokenizer_path()
    tok = tokenizers.Tokenizer.from_file(path)
    random.seed(6)
    alphabet = "ab cd  'strevlmd S\t\n\r\x0b\x85\xa0\u3000é1２3$.<|>\x1c_ñ漢😀 '"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 30))) for _ in range(300)]
    texts += ["x<|endoftext|> y <|endoftext|>", "<|endoftext|><|endoftext|>  ", "a  <|endoftext|>b", "'re're'r e", "  ", "\x00a"]
    df = table(spark, [(i, t, "ids", "decoded", 1) for i, t in enumerate(texts)])
    for r in bpe.decode(bpe.encode(df, path), path).collect():
        ids = tok.encode(texts[r.id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)
    got = sorted(((r.id, len(r.ids), r.decoded) for r in bpe.decode(bpe.encode(odd, path), path).collect()), key=str)
    want = sorted(((r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids), r.text or "") for r in odd.collect()), key=str)
    assert got == want
    assert bpe.decode(bpe.encode(none, path), path).collect() == []
    broken = spark.createDataFrame([(1, [tok.encode("é").ids[0], 447, 220]), (2, None), (3, [])], "id long, ids array<int>")
    for r in bpe.decode(broken, path).collect():
        assert r.decoded == tok.decode(r.ids or [], skip_special_tokens=False)


def test_bpe_classes_are_the_tokenizers():
    tokenizers = pytest.importorskip("tokenizers")
    from offerlens.llm.queries import tokenizer_path
    pre = tokenizers.Tokenizer.from_file(tokenizer_path()).pre_tokenizer
    points = [*range(0x3100), *range(0xA640, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x12000)]
    points = [c for c in points if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{chr(c)}1{chr(c)}\n" for c in points)
    starts = {a for _, (a, _) in pre.pre_tokenize_str(text)}
    kinds = bpe.classes()
    for i, c in enumerate(points):
        want = bpe.LETTER if 5 * i + 1 not in starts else bpe.NUMBER if 5 * i + 3 not in starts else None
        assert kinds[c] == want if want else kinds[c] in (bpe.OTHER, bpe.SPACE), hex(c)


# ------------------------------------------------------------------ 6
def test_toxicity_cases(spark, none):
    random.seed(7)
    vocabulary = [a + b + c for a in ("ba", "ko", "ri", "tu", "me") for b in ("la", "no", "si") for c in ("n", "t", "sh", "")]
    rows, labels = [], []
    for i in range(400):
        w = [random.choice(vocabulary) for _ in range(30)]
        if i % 3 == 0:
            w[random.randrange(30)] = random.choice(["vilescum", "vilerat", "dreck"])
        rows.append((i, " ".join(w), "en", None, None))
        labels.append((i, i % 2, 1 if i % 3 == 0 else 0))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "?!", None, None, None), (1003, "kolan " * 50_000, None, None, None),
             (None, "vilescum", None, None, None)]
    labels += [(1000, 0, 1), (1001, 0, None), (1002, 0, 7), (None, 1, 1), (3, 1, 1)]
    docs = table(spark, rows).withColumn("predicted", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, samples = toxicity.learn(docs, marks, lambda c: F.coalesce(c % 5 != 0, F.lit(False)))
    got = {r.doc_id: r for r in toxicity.score(docs, model, samples).collect()}
    held = [i for i in range(400) if i % 5 == 0]
    assert sum(got[i].predicted == (i % 3 == 0) for i in held) >= 0.9 * len(held)
    assert got[1000].score == got[1001].score == got[1002].score and got[1003].predicted == 0 and len(got) == 405
    assert toxicity.score(none, model, samples).collect() == []
    nothing, s = toxicity.learn(none, marks.limit(0), lambda c: F.lit(True))
    assert {r.score for r in toxicity.score(docs.limit(3), nothing, s).collect()} == {0.0}


# ------------------------------------------------------------------ 7
def test_mixing_cases(spark, odd, none):
    rows = mixing.mix(stage(mixing.sizes(odd), "s")).collect()
    assert len(rows) == 11 and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert {r.size for r in rows if r.id in (3, 4)} == {0}
    assert len({r.taken for r in rows if r.id == 2}) == 1  # repeated rows are taken alike
    assert mixing.mix(stage(mixing.sizes(none), "s")).collect() == []
    assert mixing.repeat(odd.withColumn("hash", F.lit(1))).columns == [*odd.columns, "hash"]
    assert mixing.repeat(none).collect() == []


def test_mixing_thresholds_are_nested_and_exact(spark):
    random.seed(8)
    rows = [(i, "w " * random.randint(1, 9), None, "hot" if i % 3 else f"s{i % 7}", None) for i in range(1500)]
    sized = stage(mixing.sizes(table(spark, rows)), "s")
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    before = None
    for share in (0.1, 0.35, 0.8, 1.4):
        targets = by.withColumn("target", F.col("source_size") * share)
        limits = {r.source: r for r in mixing.thresholds(sized, targets).collect()}
        taken = {}
        for r in sized.collect():
            m = limits[r.source]
            taken.setdefault(r.source, []).append(r.size * (m.full + (r.hash < m.threshold)))
        for s, m in limits.items():
            assert abs(sum(taken[s]) - m.target) <= 5
        place = {s: m.full + m.threshold / 2.0 ** mixing.HASH_BITS for s, m in limits.items()}
        assert before is None or all(place[s] >= before[s] for s in place)
        before = place


# ------------------------------------------------------------------ 8
def naive_spans(text):
    out = []
    kinds = [("assign", r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, re.I | re.A),
             ("access", "AKIA[A-Z0-9]+", 0, 20, 0), ("hex", "[0-9a-f]+", 0, 24, 0),
             ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, 0)]
    for o, (kind, p, g, least, flags) in enumerate(kinds):
        out += [(m.start(), o, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text or "", flags) if len(m[g]) >= least]
    return [x for _, _, x in sorted(out)]


def test_secret_cases(spark, none):
    texts = ["Password = 'abcdef1' 😀 token:abc secret: token: abcdef123 API_KEY=zzzzzz", "AKIA" + "A1" * 8 + " AKIA1 AKIAAKIA" + "B" * 20,
             "0" * 24 + " " + "f" * 23 + "g" + "ab" * 40, None, "", "x" * 200_000 + " passwd:qwertyuiop", "PASSWORD:abcdef",
             "-----BEGIN RSA PRIVATE KEY----- apikey=" + "a0" * 15, "secret='short' secret=\"longenough\""]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1), (None, texts[1], "en", "s", 1)]
    docs = table(spark, rows).withColumn("blob", F.lit("clash"))
    got = secrets.per_path(secrets.versions(docs), secrets.scan(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[1] if r.path is None else texts[r.path]
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r.spans] == naive_spans(text)
        assert bytes(r.blob) == hashlib.sha256((text or "").encode()).digest()
    assert secrets.per_path(secrets.versions(none), secrets.scan(none)).collect() == []


def test_secret_ledger_scans_only_what_is_new(spark):
    one = table(spark, [(1, "token=abcdef1", None, None, None), (2, "nothing", None, None, None)])
    two = table(spark, [(3, "token=abcdef1", None, None, None), (4, "token=zzzzzz9", None, None, None)])
    ledger = secrets.extend_ledger(secrets.versions(one), None)
    assert ledger.count() == 2 * len(secrets.RULES)
    fresh = secrets.scan(two, ledger=ledger).collect()
    assert [bytes(r.blob) for r in fresh] == [hashlib.sha256(b"token=zzzzzz9").digest()]
    assert secrets.extend_ledger(secrets.versions(two), ledger).count() == 3 * len(secrets.RULES)
    newer = tuple(secrets.Rule(r.kind, r.pattern, r.group, r.least, r.hint, 2) for r in secrets.RULES if r.kind == "assign")
    assert len(secrets.scan(two, newer, ledger).collect()) == 2  # a new rule version sees every blob again
    both = one.unionByName(two)
    found = secrets.per_path(secrets.versions(both), secrets.scan(one).unionByName(secrets.scan(two, ledger=ledger)))
    assert {r.path: len(r.spans) for r in found.collect()} == {1: 1, 2: 0, 3: 1, 4: 1}


def test_secret_findings_are_stored_and_batches_add_to_them(spark, tmp_path):
    store = str(tmp_path / "store")
    one = table(spark, [(1, "token=abcdef1", None, None, None), (2, "nothing", None, None, None), (5, None, None, None, None)])
    two = table(spark, [(3, "token=abcdef1", None, None, None), (4, "x token=zzzzzz9", None, None, None), (5, "token=abcdef1", None, None, None)])
    spans = lambda docs, rules=secrets.RULES: sorted((r.path, len(r.spans)) for r in secrets.per_path(
        secrets.versions(docs), secrets.findings(spark, store, rules), rules).collect())
    assert secrets.ingest(one, store) == 0 and spans(one) == [(1, 1), (2, 0), (5, 0)]
    broken = spark.createDataFrame([(b"x", "assign", 1, 0, 9)], "blob binary, kind string, version int, start long, end long")
    broken.write.parquet(f"{store}/findings/batch=1")  # lost between findings and triples
    assert spans(one) == [(1, 1), (2, 0), (5, 0)] and secrets.findings(spark, store).where("blob = X'78'").count() == 0
    assert secrets.ingest(two, store) == 1
    assert [bytes(r.blob) for r in spark.read.parquet(f"{store}/findings/batch=1").collect()] == [hashlib.sha256(b"x token=zzzzzz9").digest()]
    both = one.unionByName(two)
    assert spans(both) == [(1, 1), (2, 0), (3, 1), (4, 1), (5, 0), (5, 1)]
    assert secrets.ingest(both, store) == 2  # scans nothing, and every path keeps its findings
    assert spark.read.parquet(f"{store}/findings/batch=2").count() == 0 == spark.read.parquet(f"{store}/ledger/batch=2").count()
    assert spans(both) == [(1, 1), (2, 0), (3, 1), (4, 1), (5, 0), (5, 1)]
    newer = tuple(secrets.Rule(r.kind, r.pattern, r.group, r.least, r.hint, 2) for r in secrets.RULES)
    assert spans(both, newer) == [(p, 0) for p, _ in spans(both)]
    secrets.ingest(both, store, newer)
    assert spans(both, newer) == spans(both) and secrets.ingest(table(spark, []), store) == 4


def test_short_runs_become_no_rows(spark):
    text = "deadbeef " * 20_000 + "AKIA" + "Z" * 16 + " " + "ab" * 12
    found = secrets.scan(table(spark, [(1, text, None, None, None)]))
    assert sorted((r.kind, r.start, r.end) for r in found.collect()) == [("access", 180_000, 180_020), ("hex", 180_021, 180_045)]


# ------------------------------------------------------------------ 9
def test_exact_cases(spark, odd, none):
    rows = {(r.id, bytes(r.digest)): r for r in exact_dedup.exact_groups(odd, keep="largest").collect()}
    same, empty = hashlib.sha256(b"same text here").digest(), hashlib.sha256(b"").digest()
    assert [(rows[(i, same)].keep_id, rows[(i, same)].group_size, rows[(i, same)].kept) for i in (1, 2, None)] == [
        (2, 4, False), (2, 4, True), (2, 4, False)]
    assert rows[(3, empty)].keep_id == rows[(4, empty)].keep_id == 4 and rows[(3, empty)].group_size == 3
    digests = {i: d for i, d in rows}
    assert digests[7] != digests[8]  # only A-Z are folded
    assert exact_dedup.exact_groups(none).collect() == []
    small = {r.id: r.keep_id for r in exact_dedup.exact_groups(odd).collect()}
    assert small[2] == 1 and small[4] == 3
    kept = exact_dedup.drop_copies(odd, keep="largest").collect()
    assert sorted(r.doc_id for r in kept) == [2, 4, 5, 6, 7, 8]
    alone = table(spark, [(None, "x", None, None, None), (None, "X", None, None, None), (1, "y", None, None, None)])
    assert sorted(str(r.doc_id) for r in exact_dedup.drop_copies(alone).collect()) == ["1", "None"]


def test_dedup_stages_lose_no_text_of_a_reused_id(spark):
    import corpus_pipeline as C
    rows = [(5, "A", "en", "x", 1), (7, "A", "en", "x", 1), (5, "B", "en", "x", 1), (8, "b", None, None, None), (5, "C", None, None, None),
            (9, "D", None, None, None), (9, "D", None, None, None), (9, "E", None, None, None), (None, "C", None, None, None),
            (None, None, None, None, None), (3, "", None, None, None)]
    pick = lambda keep: sorted((r.doc_id, r.text) for r in exact_dedup.drop_copies(table(spark, rows), keep=keep).collect())
    assert pick("largest") == [(3, ""), (5, "C"), (7, "A"), (8, "b"), (9, "D"), (9, "E")]
    assert pick("smallest") == [(3, ""), (5, "A"), (5, "B"), (5, "C"), (9, "D"), (9, "E")]
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    a, b, c = words("a", 200), words("b", 200), words("c", 200)
    texts = [(3, a), (5, a + " more"), (5, b), (4, b + " more"), (5, c), (6, a + " less"), (None, a + " null"), (None, a + " null"), (10, "few")]
    docs = table(spark, [(i, t, "en", "x", 1) for i, t in texts]).withColumn("component", F.lit("clash"))
    got = C.near(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(3, a), (4, b + " more"), (5, c), (None, a + " null"), (None, a + " null"), (10, "few")], key=str)
    unique = C.near(spark, docs.where("doc_id in (3, 6, 10)"), "")
    assert sorted(r.doc_id for r in unique.collect()) == [3, 10]


def test_tree_merge_by_any_shape(spark):
    random.seed(9)
    rows = [(i, f"t{random.randrange(40)}", None, None, None) for i in range(600)]
    runs = exact_dedup.digests(table(spark, rows).repartition(13))
    want = {}
    for i, t, *_ in rows:
        k = hashlib.sha256(t.encode()).digest()
        want[k] = (min(want.get(k, (i, 0))[0], i), want.get(k, (i, 0))[1] + 1)
    for n, fan in ((1, 2), (5, 2), (64, 8), (64, 3)):
        got = {bytes(r.digest): (r.keep_id, r.group_size) for r in exact_dedup.tree_merge(runs, "smallest", n, fan).collect()}
        assert got == want


# ------------------------------------------------------------------ 10
def test_ann_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]),
            (7, [inf, 0.0]), (8, [1.0, 0.0, 0.0]), (40, [0.0, 1.0]), (2, [0.5, 0.5]), (9, [-2.0, 0.5]), (60, None), (None, [1.0, 1.0]), (10, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, node string")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert by == {20: [(1, 1, 1.0), (2, 2, 0.5), (3, 40, 0.0)], 40: [(1, 2, 0.5), (2, 9, 0.5), (3, 1, 0.0)]}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_ann_copies_scales_and_shards(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(600, 16)) * rng.uniform(0.1, 3, (600, 1))
    v[rng.choice(600, 200, replace=False)] = v[0]  # a third are one vector
    v = v.astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    d = v.astype(np.float64)
    hits = total = 0
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, shard_size=100).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q in range(0, 600, 20):
        want = sorted((-s, i) for i, s in enumerate(d @ d[q]) if i != q)[:20]
        hits += len({i for _, i in want} & {i for _, i in found[q]})
        total += 20
    assert hits >= 0.95 * total


def test_runs_are_sorted_files_merged_without_hashing(spark, monkeypatch):
    random.seed(8)
    rows = [(i, f"text {random.randrange(40)}" if i % 3 else "hot", None, None, None) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS).repartition(12)
    stages = {}
    monkeypatch.setattr(exact_dedup, "stage", lambda df, name: stages.setdefault(name, (stage(df, name), df))[0])
    got = {r.id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, keep="smallest").collect()}
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t, []).append(i)
    assert got == {i: (min(g), len(g)) for g in groups.values() for i in g}
    assert list(stages) == ["digest-runs", "sorted-runs", "merged-runs-8", "merged-runs-1"]
    for name, (written, df) in list(stages.items())[1:]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning(run" in plan and "hashpartitioning" not in plan and "HashAggregate" not in plan
        per_file = written.withColumn("f", F.input_file_name()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
        for f in {r.f for r in per_file}:
            keys = [(r.run, bytes(r.digest)) for r in per_file if r.f == f]
            assert keys == sorted(set(keys))
    hot = stages["sorted-runs"][0].where(F.col("digest") == exact_dedup.digest(F.lit("hot"))).collect()
    assert len(hot) == len({r.run for r in hot}) > 4  # one row of the hot text in each run


# ------------------------------------------------------------------ 10, vectors of unlike lengths
def recall_of(vectors, breadth=None, k=20):
    graph = ann.build(np.arange(len(vectors)), vectors)
    wide = ann.breadth_needed(graph, vectors) if breadth is None else breadth
    hits = asked = 0
    for i in range(3, len(vectors), len(vectors) // 60):
        scores = vectors @ vectors[i]
        exact = set(np.argsort(-scores, kind="stable")[:k].tolist())
        found = range(len(vectors)) if wide >= len(vectors) else [j for _, j in graph.search(np.append(vectors[i], 0.0), wide)]
        hits += len(exact & set(sorted(found, key=lambda j: -scores[j])[:k]))
        asked += k
    return hits / asked, wide


@pytest.mark.parametrize("kind", ["gauss", "lognormal", "axes", "clusters"])
def test_ann_recall_is_measured_and_reached(kind):
    rng = np.random.default_rng(9)
    n = 1500
    v = rng.normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "lognormal":
        v *= rng.lognormal(size=(n, 1))
    if kind == "axes":
        v *= np.exp(rng.normal(size=64))
    if kind == "clusters":
        v = v * 0.2 + np.repeat(rng.normal(size=(15, 64)), 100, 0)
    recall, wide = recall_of(v)
    assert recall >= 0.9 and wide >= ann.BREADTH


def test_ann_deals_lengths_apart_and_defines_repeated_ids(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(600, 8)) * rng.lognormal(sigma=1.5, size=(600, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(20, [9.0] * 8), (20, [-50.0] + [0.0] * 7)]
    df = stage(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=10, shard_size=200).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    hits = 0
    for q in range(0, 600, 20):
        asks = min(x for i, x in rows if i == q)
        best = sorted((-float(np.dot(x, asks)), i) for i, x in rows if i != q)[:10]
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 11))
        hits += len({(i, round(-x, 6)) for x, i in best} & {(i, round(x, 6)) for _, i, x in got[q]})
    assert hits >= 0.95 * 300
    nodes = df.groupBy("embedding").agg(F.min("vec_id").alias("node")).select("node", F.size("embedding").alias("dim"), F.col("embedding").alias("vec"))
    for r in ann.build_index(nodes, 200).collect():
        lengths = np.linalg.norm(np.frombuffer(r.vectors, np.float64).reshape(-1, 8), axis=1)
        assert lengths.max() <= ann.LENGTHS * lengths.min() * (1 + 1e-9)
