"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and reread as the next
one's ``docs``. All but the last return the columns of ``docs``, whatever
their names: columns that the stages add for themselves get names that no
column has.

Cases: null and empty texts have no letters and go with language ID (they are
empty texts to every other stage, which keep one of them); rows without an id
take no part in near dedup and stay; an id on several rows is treated row by
row; of equal texts the largest id stays, of near copies the smallest; very
long texts pass whole; an empty table runs through all stages and gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm import bpe, exact_dedup, langid, minhash_dedup, mixing
from offerlens.llm.common import free, join_checked, stage
from offerlens.llm.queries import tokenizer_path
from offerlens.sources.tables import load

#: Stands in where no language can be learned, so that texts without letters are found all the same.
NO_LANGUAGE = langid.Samples((("any", "a"),), "a")

#: Rows that go to a Python worker at once. A batch of whole texts stands in memory several times, in the JVM and in
#: the worker, and the default of 10,000 documents is tens of MB each time. No result depends on it.
BATCH_ROWS = 2_000

#: Language ID, minhashes and byte pairs have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows a batch to ``BATCH_ROWS``; a smaller number stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:  # 0 and below: no limit
        spark.conf.set(key, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language explains best: all but those without letters.

    The samples come from the documents' own labels. Neither equally good
    languages nor the lack of any label reject a text."""
    small_batches(spark)
    samples = langid.learn(docs, langid.remainder(F.col("doc_id"), 3) != 1)
    out = tuple(free(x, docs.columns) for x in ("__lang", "__score", "__bits"))
    found = langid.predict(docs, samples if samples.langs else NO_LANGUAGE, out=out)
    return found.where(F.col(out[0]) != langid.UNKNOWN).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return exact_dedup.drop_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id.

    Groups are made of ids. Where an id stands on several rows, every row gets
    a number of its own instead, so that a text goes only with its own group;
    rows without an id take no part."""
    small_batches(spark)
    id_col, columns = "doc_id", docs.columns
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.limit(1).count():
        id_col = free("__row", docs.columns)
        docs = stage(docs.withColumn(id_col, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "near-rows")
    groups = minhash_dedup.near_groups(docs, id_col)
    if id_col == "doc_id":
        gone = groups.where(F.col("id") != F.col("component")).select(F.col("id").alias(id_col))
    else:
        placed = stage(groups.where(F.col("id").isNotNull()).select(F.col("id").alias(id_col), "component")
                       .join(docs.select("doc_id", id_col), id_col), "near-placed")
        first = stage(placed.groupBy("component").agg(F.min(F.struct("doc_id", id_col))[id_col].alias("first")), "near-first")
        gone = join_checked(placed.select(id_col), first.select(F.col("first").alias(id_col)), [id_col], "left_anti")
    kept = join_checked(docs, stage(gone, "near-gone"), [id_col], "left_anti")
    return kept.select(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): the ids and the text they decode to, a row for each row of the mix."""
    small_batches(spark)
    return bpe.encode(docs, tokenizer_path(), decoded=True).select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [("language ID", language_id), ("exact dedup", exact), ("near dedup", near), ("mix", mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
