"""Learning and embedding (Spark ML / Arrow).

* The propensity model is an MLlib pipeline (StringIndexer keep-invalid +
  OneHotEncoder dropLast + VectorAssembler + GBTClassifier), trained and
  applied as distributed jobs.
* Scoring every subscriber x offer expands the catalogue with ``inline``
  (Generate, fixed fan-out), transforms, and picks the argmax with a
  ``max(struct)`` aggregate: the 10 candidate rows of a subscriber are
  adjacent, so the partial aggregate already reduces them to one row before
  the shuffle.
* External embedders / text generators plug in through ``mapInPandas``
  (Arrow batches, one model load per Python worker).
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import (
    HashingTF, IDF, Normalizer, OneHotEncoder, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.operators.ranking import argmax_by_group, expand_offers
from offerlens.operators.word_vectors import WordVectors
from offerlens.operators.workers import load_once
from offerlens.session import stage_path

c = F.col

# FIXED VALUES: model inputs (16 categorical, 29 numeric), internal names, in order.
CAT_FEATS = ["shown_offer", "segment", "ltv", "lifecycle", "account_type", "usage_trend", "arpu_trend",
             "device", "device_type", "device_tier", "net_cap", "channel", "loyalty", "last_campaign_resp",
             "top_app", "sentiment"]
NUM_FEATS = ["shown_value", "tenure_m", "churn", "days_renewal", "data_cap_gb", "data_used_gb", "data_pct",
             "overage", "voice_min", "intl_min", "roaming_days", "pct_5g", "arpu", "late_payments",
             "outstanding", "dunning", "device_age", "upgrade_eligible", "last_upgrade_m", "dl_speed",
             "dropped_call_rate", "latency_ms", "coverage", "congestion", "net_complaints", "net_issue",
             "app_logins", "consent", "nps"]
LABEL = "accept_ind"


def feature_stages() -> list:
    """ml_onehot: unknown category -> all-zero block; every known category kept."""
    idx = StringIndexer(inputCols=CAT_FEATS, outputCols=[f"{x}__idx" for x in CAT_FEATS],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    ohe = OneHotEncoder(inputCols=[f"{x}__idx" for x in CAT_FEATS], outputCols=[f"{x}__ohe" for x in CAT_FEATS],
                        dropLast=True, handleInvalid="keep")
    asm = VectorAssembler(inputCols=[f"{x}__ohe" for x in CAT_FEATS] + NUM_FEATS, outputCol="features")
    return [idx, ohe, asm]


def propensity_pipeline(max_iter: int = 100, max_depth: int = 3, step: float = 0.1, seed: int = 42) -> Pipeline:
    """ml_gbt_fit: boosted trees on the one-hot + numeric features."""
    gbt = GBTClassifier(featuresCol="features", labelCol=LABEL, maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step, seed=seed)
    return Pipeline(stages=feature_stages() + [gbt])


def fit_propensity(train: DataFrame, **kw) -> PipelineModel:
    """Fit on a staged feature table: the boosting rounds reread it, not the raw tables behind the features.

    Its rows are dealt to as many files as there are cores, since a round has
    as many tasks as the table has files, however few partitions the features came in."""
    path = stage_path(train.sparkSession, "propensity-features")
    table = train.select(*CAT_FEATS, *NUM_FEATS, LABEL)
    table.repartition(train.sparkSession.sparkContext.defaultParallelism, F.xxhash64(*table.columns)).write.parquet(path)
    return propensity_pipeline(**kw).fit(train.sparkSession.read.schema(table.schema).parquet(path))


def candidate_rows(subs: DataFrame) -> DataFrame:
    """proj_overwrite_candidate: each subscriber once per offer, with the shown
    offer, its price and type replaced by the candidate's."""
    base = subs.drop("shown_offer", "shown_value", "shown_action_type")
    e = expand_offers(base)
    return (e.withColumnRenamed("offer", "shown_offer").withColumnRenamed("price", "shown_value")
             .withColumnRenamed("action_type", "shown_action_type"))


def positive_probability(pred: DataFrame) -> Column:
    return F.get(vector_to_array(c("probability")), 1)


def score_pairs(model: PipelineModel, subs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """ml_score_pairs: P(accept) for every subscriber x offer; with the node table also as walked there."""
    cand = candidate_rows(subs.select("customer_id", *[x for x in CAT_FEATS + NUM_FEATS if x not in
                                                        ("shown_offer", "shown_value")]))
    pred = model.transform(cand)
    extra = [walked_probability(nodes, vector_to_array(c("features"))).alias("walked")] if nodes is not None else []
    return pred.select("customer_id", "offer_ord", c("shown_offer").alias("offer"),
                       c("shown_action_type").alias("action_type"), c("shown_value").alias("price"),
                       positive_probability(pred).alias("score"), *extra)


def recommend_model(model: PipelineModel, subs: DataFrame) -> DataFrame:
    """ml_recommend: best offer per subscriber by model score; ties -> catalogue order."""
    pairs = score_pairs(model, subs)
    best = argmax_by_group(pairs, "customer_id", "score", "offer_ord", ["offer", "action_type", "price"])
    return best.select("customer_id", c("offer").alias("action"), "action_type",
                       F.round(c("score"), 4).alias("propensity"), c("price").alias("value_qar"))


# ---------------------------------------------------------------- the trees as a table
NODES = ("tree int, weight double, node int, feature int, threshold double, left_categories long, left_node int, "
         "right_node int, prediction double")


def node_table(model: PipelineModel) -> DataFrame:
    """A row for each node of the fitted trees; staged. Leaves have feature -1.

    A split on a number goes left up to ``threshold``; one on categories goes
    left where the category's bit is set in ``left_categories`` (null for numbers)."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = stage_path(spark, "propensity-trees")
    model.stages[-1].write().save(path)
    n = c("nodeData")
    split = n["split"]
    values = split["leftCategoriesOrThreshold"]
    bits = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + F.pow(F.lit(2.0), x).cast("long"))
    trees = spark.read.parquet(f"{path}/treesMetadata").select(c("_1").alias("treeID"), c("_3").alias("weight"))
    rows = spark.read.parquet(f"{path}/data").join(trees, "treeID").select(
        c("treeID").alias("tree"), "weight", n["id"].alias("node"), split["featureIndex"].alias("feature"),
        F.when(split["numCategories"] < 0, F.get(values, 0)).alias("threshold"),
        F.when(split["numCategories"] >= 0, bits).alias("left_categories"),
        n["leftChild"].alias("left_node"), n["rightChild"].alias("right_node"), n["prediction"].alias("prediction"))
    table = f"{path}-nodes"
    rows.orderBy("tree", "node").write.parquet(table)
    return spark.read.schema(NODES).parquet(table)


def walked_probability(nodes: DataFrame, features: Column) -> Column:
    """P(accept) from the node table alone: every tree is walked from its root to a leaf.

    ``features`` is the assembled row as array<double>. The table has as many
    rows as trees times nodes, whatever the data, and goes along with the
    function; the rows of a batch walk all trees side by side."""
    import numpy as np

    rows = sorted(nodes.collect(), key=lambda r: (r.tree, r.node))
    start, weight, depth = {}, {}, 0
    for i, r in enumerate(rows):
        start.setdefault(r.tree, i)
        weight[r.tree] = r.weight
    level = {}
    for r in rows:  # a child comes after its parent
        d = level.setdefault((r.tree, r.node), 0)
        depth = max(depth, d)
        if r.feature >= 0:
            level[r.tree, r.left_node] = level[r.tree, r.right_node] = d + 1
    leaf = np.array([r.feature < 0 for r in rows])
    feature = np.array([max(r.feature, 0) for r in rows])
    threshold = np.array([r.threshold if r.threshold is not None else 0.0 for r in rows])
    bits = np.array([r.left_categories if r.left_categories is not None else -1 for r in rows], np.int64)
    here = np.arange(len(rows))
    left = np.where(leaf, here, [start[r.tree] + max(r.left_node, 0) for r in rows])
    right = np.where(leaf, here, [start[r.tree] + max(r.right_node, 0) for r in rows])
    prediction = np.array([r.weight * r.prediction for r in rows])
    roots = np.array(list(start.values()))

    @F.arrow_udf("double")
    def walk(column: pa.Array) -> pa.Array:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        at = np.tile(roots, (len(x), 1))
        for _ in range(depth):
            value, bit = np.take_along_axis(x, feature[at], 1), bits[at]
            category = (bit >> np.clip(value, 0, 62).astype(np.int64)) & 1 == 1
            at = np.where(np.where(bit < 0, value <= threshold[at], category), left[at], right[at])
        return pa.array(1.0 / (1.0 + np.exp(-2.0 * prediction[at].sum(1))))

    return walk(features)


def log_loss(probability: Column, label: Column) -> Column:
    """Mean logarithmic loss (an aggregate)."""
    p = F.least(F.greatest(probability, F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.avg(F.when(label == 1, F.log(p)).otherwise(F.log(F.lit(1.0) - p)))


# ---------------------------------------------------------------- embeddings
def hashing_embedder(text_col: str = "text", dim: int = 64) -> Pipeline:
    """emb_embed_batch (built-in): tokens -> hashed term frequencies -> IDF ->
    L2-normalised vector. Fit once on the corpus (document frequencies are one
    distributed aggregate), then applied to corpus and queries alike."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=dim),
        IDF(inputCol="__tf", outputCol="__tfidf"),
        Normalizer(inputCol="__tfidf", outputCol="__vec", p=2.0),
    ])


#: Rounds over the texts, and tasks that train side by side; neither follows the size of the input.
TRAIN_ROUNDS, TRAIN_TASKS = 3, 8


def trained_embedder(text_col: str = "text", dim: int = 64, parts: int = 1, shared_rows: int = 0) -> Pipeline:
    """emb_embed_batch (trained): tokens -> the mean of their word vectors -> L2-normalised vector.

    Words that occur once in the texts have no vector. With ``shared_rows`` a
    word is the row, one of that many, that its hash picks. ``parts`` is the
    number of tasks that train side by side and average their vectors."""
    row = f"transform(__tok, w -> string(pmod(xxhash64(w), {shared_rows})))" if shared_rows else "__tok"
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern=r"\W+", toLowercase=True),
        SQLTransformer(statement=f"SELECT *, {row} AS __row FROM __THIS__"),
        WordVectors("__row", "__mean", dim, TRAIN_ROUNDS, parts),
        Normalizer(inputCol="__mean", outputCol="__vec", p=2.0),
    ])


def fit_trained(texts: DataFrame, text_col: str = "text", dim: int = 64, word_rows: int = 0) -> PipelineModel:
    """The trained embedder, fitted on all texts, however many.

    Every word that occurs twice has its own vector, unless the caller names a
    number of ``word_rows`` that the words share by hash."""
    return trained_embedder(text_col, dim, TRAIN_TASKS, word_rows).fit(texts.select(text_col).where(F.length(text_col) > 0))


def embed(model: PipelineModel, df: DataFrame, out: str = "embedding") -> DataFrame:
    t = model.transform(df)
    return t.withColumn(out, vector_to_array(c("__vec"), "float32")).drop("__tok", "__row", "__tf", "__tfidf", "__mean", "__vec")


def embed_with(df: DataFrame, text_col: str, load_fn, dim: int, out: str = "embedding") -> DataFrame:
    """emb_embed_batch (external model hook): ``load_fn()`` returns a callable
    ``list[str] -> array (n, dim)``; it is loaded once per Python worker and
    applied to Arrow batches. Vectors are L2-normalised (floor 1e-12); a null
    text is embedded as the empty text."""
    import numpy as np

    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.ArrayType(T.FloatType()))])
    key = uuid.uuid4().hex

    def run(batches):
        m = load_once(key, load_fn)
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            v = np.asarray(m(texts), dtype=np.float64).reshape(len(texts), dim) if texts else np.zeros((0, dim))
            n = np.clip(np.linalg.norm(v, axis=1, keepdims=True), 1e-12, None)
            pdf[out] = list((v / n).astype(np.float32))
            yield pdf
    return df.mapInPandas(run, schema)
