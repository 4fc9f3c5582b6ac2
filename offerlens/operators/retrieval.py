"""Customer-scoped vector retrieval and its evaluation.

Retrieval never searches globally and filters afterwards: every score is a
per-row expression (query vector x interaction vector), and the ranking
window is partitioned by customer, so a hit can only come from the
customer's own rows (the privacy boundary). For a single query shared by all
customers the query vector is a scalar subquery (one 64-float value), so
scoring needs no join at all; per-customer query tables are joined on the
customer key before scoring.

Skew: ``row_number() <= k`` over ``partitionBy(customer)`` is planned as a
partial WindowGroupLimit before the shuffle, so a customer holding a third
of all interactions ships at most k rows per map partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.core import round_half_up as rhu
from offerlens.functions.text import redact, token_overlap
from offerlens.functions.vectors import NORM_FLOOR, dot, l2_norm, normalize
from offerlens.operators.ranking import topk_per_group

c = F.col

__all__ = ["score", "exact_topk", "scoped_topk", "explain", "hits_with_truth",
           "precision_recall", "random_baseline", "misses_and_false_positives",
           "payload_reduction", "keyword_baseline", "dedup_best_by_text", "retrieval_context",
           "query_vector", "similarity", "own_queries", "evaluate"]


def query_vector(vectors: DataFrame, query_id: int, id_col: str = "interaction_id",
                 col: str = "embedding") -> Column:
    """Row ``query_id``'s vector, normalised once, as a scalar subquery (NULL without such a row).

    No label is read, no job runs while the plan is built, and the filter on
    the id reaches the scan. The caller leaves the row out of the corpus."""
    row = vectors.where(c(id_col) == query_id).agg(F.min(col).alias("v"))
    return row.select(normalize(c("v")).alias("q")).scalar()


def similarity(vec: Column, unit: Column) -> Column:
    """Cosine with an already normalised query; NULL if the lengths differ or the query is NULL."""
    return F.when(F.size(vec) == F.size(unit), dot(vec, unit) / F.greatest(l2_norm(vec), F.lit(NORM_FLOOR)))


def score(corpus: DataFrame, query: Column, col: str = "embedding") -> DataFrame:
    """Adds ``sim`` (cosine, unrounded) for one shared, normalised query vector.

    The query (a scalar subquery) is first bound to a column, because
    subqueries may not appear inside higher-order functions.
    """
    return corpus.withColumn("__q", query).withColumn("sim", similarity(c(col), c("__q"))).drop("__q")


def exact_topk(scored: DataFrame, k: int = 3, key: str = "customer_id",
               id_col: str = "interaction_id") -> DataFrame:
    """ret_exact_topk: k best per customer by (sim desc, id asc); ties broken by id.
    Ranks on the unrounded similarity; rounds similarity/distance to 4 after.
    Rows without a similarity (no query, or vectors of another length) are no hits."""
    top = topk_per_group(scored.where(c("sim").isNotNull()), key, [c("sim").desc(), c(id_col).asc()], k)
    return (top.withColumn("similarity", rhu(c("sim"), 4))
               .withColumn("distance", rhu(F.lit(1.0) - c("sim"), 4)))


def scoped_topk(corpus: DataFrame, queries: DataFrame, k: int = 3, key: str = "customer_id",
                id_col: str = "interaction_id", col: str = "embedding",
                qcol: str = "query_embedding") -> DataFrame:
    """join_customer_scope: per-customer (key, query_id, normalised vector), joined on the key
    *before* scoring; a customer's rows are only ever scored against its own query,
    whose own row is left out."""
    j = corpus.join(queries, key, "inner").where(c(id_col) != c("query_id")).drop("query_id")
    return exact_topk(j.withColumn("sim", similarity(c(col), c(qcol))).drop(qcol), k, key, id_col)


def own_queries(corpus: DataFrame, key: str = "customer_id", id_col: str = "interaction_id",
                col: str = "embedding") -> DataFrame:
    """(key, query_id, query_embedding): every customer's first interaction as its query, whatever its labels."""
    first = corpus.groupBy(key).agg(F.min(F.struct(c(id_col).alias("id"), c(col).alias("v"))).alias("f"))
    return first.select(key, c("f.id").alias("query_id"), normalize(c("f.v")).alias("query_embedding"))


def explain(corpus: DataFrame, hits: DataFrame, id_col: str = "interaction_id") -> DataFrame:
    """ret_explain: every interaction with ``kept`` and its rank (NULL if dropped)."""
    h = hits.select(id_col, "rank", "similarity")
    return corpus.join(h, id_col, "left").withColumn("kept", c("rank").isNotNull())


def hits_with_truth(hits: DataFrame, truth: DataFrame, id_col: str = "interaction_id") -> DataFrame:
    """join_truth_labels: absent label = not relevant."""
    return (hits.join(truth.select(id_col, c("is_relevant").alias("__rel")), id_col, "left")
                .withColumn("is_relevant", F.coalesce(c("__rel"), F.lit(False))).drop("__rel"))


def precision_recall(corpus: DataFrame, hits: DataFrame, key: str = "customer_id",
                     id_col: str = "interaction_id") -> DataFrame:
    """agg_precision_recall per customer: hits/max(retrieved,1), hits/max(relevant,1).

    Customers with history but no hits count with precision 0."""
    per_hist = corpus.groupBy(key).agg(F.count_if(c("is_relevant")).alias("n_relevant"))
    per_hit = (hits.groupBy(key)
               .agg(F.count(F.lit(1)).alias("n_retrieved"), F.count_if(c("is_relevant")).alias("n_hits")))
    j = per_hist.join(per_hit, key, "left").fillna(0, ["n_retrieved", "n_hits"])
    return j.select(key, "n_relevant", "n_retrieved", "n_hits",
                    (c("n_hits") / F.greatest(c("n_retrieved"), F.lit(1))).alias("precision"),
                    (c("n_hits") / F.greatest(c("n_relevant"), F.lit(1))).alias("recall"))


def random_baseline(corpus: DataFrame) -> Column:
    return F.avg(c("is_relevant").cast("double"))


def misses_and_false_positives(corpus: DataFrame, hits: DataFrame, id_col: str = "interaction_id"):
    """agg_misses_fps: relevant rows not retrieved (anti join) and retrieved rows
    that are not relevant."""
    misses = corpus.where(c("is_relevant")).join(hits.select(id_col), id_col, "left_anti")
    fps = hits.where(~c("is_relevant"))
    return misses, fps


def payload_reduction(corpus: DataFrame, hits: DataFrame, key: str = "customer_id") -> DataFrame:
    """agg_payload_reduction per customer: 1 - len(' '.join(retrieved)) / len(' '.join(all)).

    Lengths of the joined texts are sum(len) + (n - 1): no text is concatenated."""
    full = corpus.groupBy(key).agg((F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias("full_chars"))
    ret = hits.groupBy(key).agg((F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias("retrieved_chars"))
    j = full.join(ret, key, "left").fillna(0, ["retrieved_chars"])
    return j.select(key, "full_chars", "retrieved_chars",
                    (F.lit(1.0) - F.try_divide(c("retrieved_chars"), c("full_chars"))).alias("reduction"))


def evaluate(corpus: DataFrame, hits: DataFrame, key: str = "customer_id",
             id_col: str = "interaction_id") -> DataFrame:
    """ret_evaluate: all retrieval metrics from one pass over the corpus.

    The hits (at most k per customer) mark the corpus rows; one aggregate per
    customer and one over the customers give every metric."""
    marked = corpus.join(hits.select(id_col, F.lit(True).alias("hit")), id_col, "left")
    hit, rel, size = F.coalesce(c("hit"), F.lit(False)), c("is_relevant"), F.length("text")
    per = marked.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(rel).alias("n_relevant"), F.count_if(hit).alias("n_retrieved"),
        F.count_if(hit & rel).alias("n_hits"), F.sum(size).alias("chars"),
        F.coalesce(F.sum(F.when(hit, size)), F.lit(0)).alias("hit_chars"))
    full = c("chars") + c("n") - 1
    kept = F.when(c("n_retrieved") > 0, c("hit_chars") + c("n_retrieved") - 1).otherwise(0)
    return per.agg(
        F.avg(c("n_hits") / F.greatest(c("n_retrieved"), F.lit(1))).alias("precision"),
        F.avg(c("n_hits") / F.greatest(c("n_relevant"), F.lit(1))).alias("recall"),
        F.try_divide(F.sum("n_relevant"), F.sum("n")).alias("random_baseline"),
        F.sum(c("n_relevant") - c("n_hits")).alias("n_missed"),
        F.sum(c("n_retrieved") - c("n_hits")).alias("n_false_positives"),
        F.avg(F.lit(1.0) - F.try_divide(kept, full)).alias("payload_reduction"))


def keyword_baseline(corpus: DataFrame, keywords: list[str]) -> DataFrame:
    """ret_keyword_baseline / flt_like_ci: rows whose lower-cased text contains
    each keyword; one global aggregate of per-row flags (no join)."""
    low = F.lower(c("text"))
    agg = corpus.agg(*[F.count_if(low.contains(kw)).alias(f"k{i}") for i, kw in enumerate(keywords)],
                     F.count(F.lit(1)).alias("n_rows"))
    pairs = [F.struct(F.lit(kw).alias("keyword"), c(f"k{i}").alias("n_matched"), c("n_rows").alias("n_rows"))
             for i, kw in enumerate(keywords)]
    return agg.select(F.inline(F.array(*pairs)))


def dedup_best_by_text(hits: DataFrame, n: int = 5, id_col: str = "interaction_id") -> DataFrame:
    """win_dedup_best_by_text + topk_global: of equal texts keep the most similar
    (ties: smallest id), then the n most similar overall.

    The per-text choice is a ``max(struct)`` aggregate (partial before the
    shuffle), so a text repeated across a third of all rows does not land in
    one task; the final top-n is TakeOrderedAndProject."""
    best = (hits.groupBy("text")
            .agg(F.max(F.struct(c("sim"), (-c(id_col)).alias("neg_id"), c(id_col).alias("id"),
                                c("customer_id"))).alias("b")))
    flat = best.select("text", c("b.sim").alias("sim"), c("b.id").alias(id_col), c("b.customer_id").alias("customer_id"))
    return flat.orderBy(c("sim").desc(), c(id_col).asc()).limit(n)


def retrieval_context(subs: DataFrame, hits: DataFrame, key: str = "customer_id") -> DataFrame:
    """rule_retrieval_mode: hits -> transcript becomes the top (redacted) snippet,
    the ranked list is attached, mode = vector_top{n}; no hits -> full_dump.

    The list per customer holds at most k hits (bounded by construction)."""
    lists = (hits.groupBy(key)
             .agg(F.array_sort(F.collect_list(F.struct(
                 c("rank"), redact(c("text")).alias("text"), c("date"), c("channel"), c("similarity"))))
                 .alias("retrieved")))
    j = subs.join(lists, key, "left")
    n = F.coalesce(F.size("retrieved"), F.lit(0))
    return (j.withColumn("retrieval_mode", F.when(n > 0, F.concat(F.lit("vector_top"), n.cast("string")))
                         .otherwise(F.lit("full_dump")))
             .withColumn("transcript", F.when(n > 0, F.get(c("retrieved"), 0)["text"])
                         .otherwise(redact(c("transcript"))))
             .withColumn("retrieved_interactions",
                         F.coalesce(F.transform("retrieved", lambda e: e.dropFields("rank")),
                                    F.array().cast("array<struct<text:string,date:string,channel:string,similarity:double>>")))
             .drop("retrieved"))


def overlap_words(query_text: str, text: Column, stopwords: list[str]) -> Column:
    return token_overlap(F.lit(query_text), text, stopwords)
