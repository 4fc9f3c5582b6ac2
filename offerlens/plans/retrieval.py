"""Retrieval plans over the driver's tables.

Corpus mapping: ``embeddings`` rows are interactions (vec_id = interaction,
label = customer scope), their text is ``documents.text`` (doc_id = vec_id,
empty when absent) and ground truth is ``labels.quality = 1`` (absent = not
relevant). The anchor and probe queries are the vectors of two fixed rows,
which are left out of the searched corpus; no label enters a query, so
precision and recall are not measured on what the query was made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.constants import INTERACTION_CHANNELS
from offerlens.functions.core import pick
from offerlens.operators import retrieval as R
from offerlens.sources import bucketed as B
from offerlens.sources.stages import resume, stage_key
from offerlens.sources.tables import Tables

c = F.col

REFERENCE_DATE = "2024-01-31"
#: Rows of ``embeddings`` that serve as queries.
ANCHOR_ID, PROBE_ID = 0, 1


def corpus(t: Tables, text: bool = False, whole: bool = False) -> DataFrame:
    """The interactions; with ``text`` the documents are joined, with ``whole`` the query rows stay in.

    Plans that do not need texts of all rows leave the documents out, since a
    left join on a key that is not known to be unique is never dropped."""
    e = t.embeddings if whole else t.embeddings.where(~c("vec_id").isin(ANCHOR_ID, PROBE_ID))
    e = e.select(c("vec_id").alias("interaction_id"), c("label").cast("bigint").alias("customer_id"),
                            "embedding")
    lab = t.labels.select(c("doc_id").alias("interaction_id"), (c("quality") == 1).alias("rel"),
                          (c("toxic") == 1).alias("tox"))
    j = e.join(lab, "interaction_id", "left")
    out = j.select(
        "interaction_id", "customer_id", "embedding",
        F.coalesce(c("rel"), F.lit(False)).alias("is_relevant"),
        F.coalesce(c("tox"), F.lit(False)).alias("is_toxic"),
        pick(INTERACTION_CHANNELS, c("interaction_id") % 4).alias("channel"),
        F.date_format(F.date_sub(F.to_date(F.lit(REFERENCE_DATE)), (c("interaction_id") % 90).cast("int")),
                      "yyyy-MM-dd").alias("date"))
    return with_text(t, out) if text else out


def not_empty(rows: DataFrame, name: str) -> DataFrame:
    """``rows``; a job over them fails with ``name`` if there are none.

    The check is a part of the plan, not a job of its own: a second branch
    looks for one row and adds nothing, or raises."""
    found = rows.select(F.lit(1).alias("one")).limit(1).agg(F.count(F.lit(1)).alias("n"))
    message = F.lit(f"{name}: the corpus is empty")
    none = found.where(F.when(c("n") == 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(False)))
    empty = none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    return rows.unionByName(empty)


def with_text(t: Tables, rows: DataFrame) -> DataFrame:
    """``rows`` with their interaction's text; for hits this comes last, when only k rows a customer are left."""
    d = t.documents.select(c("doc_id").alias("interaction_id"), "text")
    return rows.join(d, "interaction_id", "left").withColumn("text", F.coalesce(c("text"), F.lit("")))


def anchor_query(t: Tables) -> Column:
    return R.query_vector(t.embeddings, ANCHOR_ID, "vec_id")


def probe_query(t: Tables) -> Column:
    return R.query_vector(t.embeddings, PROBE_ID, "vec_id")


def anchor_hits(t: Tables, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """The searched corpus and the anchor query's hits, both without texts."""
    corp = corpus(t)
    return corp, R.exact_topk(R.score(corp, anchor_query(t)), k)


# ---------------------------------------------------------------- persisted vectors
_VECTORS = "customer_id bigint, salt int, interaction_id bigint, channel string, date string, embedding array<float>"
_QUERIES = "customer_id bigint, salt int, query_id bigint, query_embedding array<double>"
_KEYS = ["customer_id", "salt"]


def persist_scoped(rows: DataFrame, path: str, rows_a_salt: int = B.ROWS_A_SALT, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """ext_persist_vectors: every customer's vectors and its query, as tables bucketed alike; written once for each version of ``rows``.

    Buckets hold whole (customer, salt) groups, sorted by customer."""
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("interaction_id", c("customer_id").cast("bigint").alias("customer_id"), "channel", "date", c("embedding").cast("array<float>").alias("embedding"))

    def write(folder: str) -> None:
        salts = B.with_salts(rows, "customer_id", rows_a_salt)
        B.write_bucketed(salts.withColumn("salt", B.salted(c("interaction_id"))).select(*[x.split()[0] for x in _VECTORS.split(", ")]),
                         f"{folder}/vectors", _KEYS, ["interaction_id"], buckets)
        sizes = salts.groupBy("customer_id").agg(F.first("salts").alias("salts"))
        queries = (R.own_queries(rows).join(sizes, "customer_id")
                   .withColumn("salt", F.explode(F.sequence(F.lit(0), c("salts") - 1))))
        B.write_bucketed(queries.select(*[x.split()[0] for x in _QUERIES.split(", ")]), f"{folder}/queries", _KEYS, [], buckets)

    folder = resume(spark, path, stage_key(rows, f"scoped 1 {rows_a_salt} {buckets}"), write)
    return (B.open_bucketed(spark, f"{folder}/vectors", _VECTORS, _KEYS, ["interaction_id"], buckets),
            B.open_bucketed(spark, f"{folder}/queries", _QUERIES, _KEYS, [], buckets))


def scoped_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """join_customer_scope: each customer's rows with their similarity to its own query, bucket by bucket; the query's row is left out."""
    j = vectors.join(queries.hint("merge"), _KEYS).where(c("interaction_id") != c("query_id"))
    return j.withColumn("sim", R.similarity(c("embedding"), c("query_embedding"))).drop("query_embedding", "query_id", "salt")
