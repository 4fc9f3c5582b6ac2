"""One registered query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm import ann, bpe, exact_dedup, html_extract, langid, minhash_dedup, mixing, ngram_join, orchard_codes, secrets, toxicity, url_rules, zone_clusters
from offerlens.session import stage_path
from offerlens.sources.tables import load


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_dedup.near_groups(docs).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = langid.remainder(F.col("doc_id"), 3)
    samples = langid.learn(docs, rest != 1)
    return (langid.predict(docs.select("doc_id", "text"), samples)
            .select("doc_id", (rest == 1).alias("held_out"), "lang_pred", "score"))


def tokenizer_path() -> str:
    """The vocabulary file of the contract (a path is a parameter of the operator)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode(docs, tokenizer_path(), decoded=True)
    return both.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = lambda c: langid.remainder(c, 5) == 0
    model, samples = toxicity.learn(docs, load(spark, sf_dir, "labels"), lambda c: ~held(c))
    scored = toxicity.score(docs.select("doc_id", "text"), model, samples)
    return scored.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.stage(mixing.sizes(load(spark, sf_dir, "documents")), "sizes")
    return mixing.mix(sized).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    # versions arrive in two batches at one stored ledger: the second scans only blobs that the first did not have
    store = stage_path(spark, "secret-ledger")
    late = F.coalesce(F.pmod(F.col("doc_id"), F.lit(2)) == 1, F.lit(False))
    for batch in (docs.where(~late), docs.where(late)):
        secrets.ingest(batch, store)
    found = secrets.per_path(secrets.versions(docs), secrets.findings(spark, store))
    base = [r.kind for r in secrets.BASE_RULES]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(F.col("path").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in base],
                        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_groups(docs, keep="largest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(table, F.col("vec_id") % 20 == 0).withColumnRenamed("id", "vec_id")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.jaccard_groups(docs).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                                                  F.col("component").alias("component_id"))


def op12_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return zone_clusters.report(*zone_clusters.cluster(table)).withColumnRenamed("id", "vec_id")


def op13_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return orchard_codes.report(*orchard_codes.encode(table, label_col="label")).withColumnRenamed("id", "vec_id")


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_minhash, op3_url_filters, op4_language_id, op5_bpe, op6_toxicity, op7_source_mix, op8_secret_ledger, op9_exact_dedup, op10_nearest,
                                   op11_ngram_join, op12_zone_clusters, op13_orchard_codes)}
