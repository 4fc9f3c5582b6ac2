"""Approximate top-k per customer over a stored inverted-list index.

The index is a folder of three tables:

* ``rows``: the vectors, in one Parquet partition for each cell. Cells are
  those of a k-means model (Spark ML), fitted on a sample of about
  ``SAMPLE_A_CELL`` vectors a cell and applied to every row. Rows are dealt by
  range of (cell, id), so a cell that holds a third of all rows is several
  files of equal size.
* ``cells``: cell, centre, number of rows, and the share of all rows that a
  search reads. There are at most ``CELLS`` of them, whatever the size of the
  corpus.
* ``customers``: customer and number of rows.

A search ranks the cells by their centre's product with the query and takes
the first ones up to the share. The join of ``rows`` with these cells is on the
partition column, so Spark prunes the other partitions when the query runs
(dynamic partition pruning): their files are not opened and their rows are not
scored. The share is measured when the index is built: exact hits of sampled
queries in sampled customers, and how far down the ranking of cells they lie.

Customers that hold k rows but find fewer in the cells read are searched in
full, in a second step that runs only if there are any.
"""

from __future__ import annotations

import os

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlens.functions.vectors import dot, normalize
from offerlens.operators.ranking import topk_per_group
from offerlens.operators.retrieval import exact_topk, score
from offerlens.session import stage_path
from offerlens.sources.stages import resume, stage_key

__all__ = ["build", "open_index", "index_of", "search", "CELLS"]

c = F.col

#: Most cells, rows that a cell holds at least on average, and vectors of the sample for each cell.
CELLS, ROWS_A_CELL, SAMPLE_A_CELL = 4096, 4, 64
#: Queries and customers that the share is measured on, and the part of their exact hits that has to be reached.
QUERIES, CUSTOMERS, RECALL = 64, 64, 0.96
ITERATIONS, SEED = 10, 7

ROWS = "interaction_id long, customer_id long, channel string, date string, embedding array<float>, unit array<double>, cell int"


def sampled(df: DataFrame, id_col: str, wanted: int, total: int, salt: int) -> DataFrame:
    """About ``wanted`` rows of ``total``, the same in every run: those whose id hashes below a threshold."""
    if wanted >= total:
        return df
    return df.where(F.pmod(F.xxhash64(id_col, F.lit(salt)), F.lit(1 << 32)) < int((1 << 32) * wanted / total))


def build(corpus: DataFrame, folder: str, k: int = 3, cells: int = CELLS, recall: float = RECALL) -> None:
    """Write the index of ``corpus`` (interaction_id, customer_id, channel, date, embedding) into ``folder``.

    Rows without a vector, or with one of another length than most, are no
    rows of the index: no query is similar to them."""
    spark = corpus.sparkSession
    rows = corpus.select("interaction_id", c("customer_id").cast("long").alias("customer_id"), "channel", "date",
                         c("embedding").cast("array<float>").alias("embedding"))
    dim = rows.groupBy(F.size("embedding").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("embedding") == (dim.d if dim else -1)).withColumn("unit", normalize(c("embedding")))
    total = dim["count"] if dim else 0
    n = max(2, min(cells, total // ROWS_A_CELL))  # k-means asks for two
    if total:
        model = KMeans(k=n, maxIter=ITERATIONS, seed=SEED, initMode="random", featuresCol="__v", predictionCol="cell").fit(
            sampled(rows, "interaction_id", n * SAMPLE_A_CELL, total, 1).select(array_to_vector("unit").alias("__v")))
        placed = model.transform(rows.withColumn("__v", array_to_vector("unit"))).drop("__v")
        centres = [(i, [float(x) for x in v]) for i, v in enumerate(model.clusterCenters())]
    else:
        placed, centres = rows.withColumn("cell", F.lit(0)), []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (placed.repartitionByRange(parts, "cell", "interaction_id").sortWithinPartitions("cell", "customer_id")
     .write.partitionBy("cell").parquet(os.path.join(folder, "rows")))
    placed = spark.read.schema(ROWS).parquet(os.path.join(folder, "rows"))
    placed.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).write.parquet(os.path.join(folder, "customers"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n_rows"))
    table = spark.createDataFrame(centres, "cell int, centre array<double>").join(sizes, "cell")
    share = measured_share(placed, table, k, recall) if total else 1.0
    table.withColumn("share", F.lit(share)).coalesce(1).write.parquet(os.path.join(folder, "cells"))


def measured_share(rows: DataFrame, cells: DataFrame, k: int, recall: float) -> float:
    """The share of rows within which ``recall`` of the exact hits of sampled queries lie."""
    spark = rows.sparkSession
    total = rows.count()
    customers = spark.createDataFrame(rows.groupBy("customer_id").agg(F.xxhash64("customer_id").alias("h")).orderBy("h").limit(CUSTOMERS)
                                      .select("customer_id").collect(), "customer_id long")
    queries = spark.createDataFrame(rows.orderBy(F.xxhash64("interaction_id", F.lit(2))).limit(QUERIES)
                                    .select(c("interaction_id").alias("query"), c("unit").alias("q")).collect(), "query long, q array<double>")
    # QUERIES fixed vectors against the sampled customers' rows; the second table is QUERIES x cells rows
    met = (rows.join(F.broadcast(customers), "customer_id").select("interaction_id", "customer_id", "cell", "unit")
           .join(F.broadcast(queries), c("interaction_id") != c("query")).withColumn("sim", dot(c("unit"), c("q"))))
    hits = topk_per_group(met.select("query", "customer_id", "cell", "interaction_id", "sim"), ["query", "customer_id"],
                          [c("sim").desc(), c("interaction_id")], k)
    ranked = cells.crossJoin(F.broadcast(queries)).select("query", "cell", "n_rows", dot(c("centre"), c("q")).alias("near"))
    order = Window.partitionBy("query").orderBy(F.desc("near"), "cell")
    reached = ranked.select("query", "cell", ((F.sum("n_rows").over(order) - c("n_rows")) / F.lit(float(total))).alias("before"))
    found = hits.join(reached, ["query", "cell"]).agg(F.percentile("before", recall).alias("s")).first()["s"]
    return min(1.0, (1.0 if found is None else found) + 1.0 / total)


def open_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The index's tables."""
    schemas = {"rows": ROWS, "customers": "customer_id long, n long",
               "cells": "cell int, centre array<double>, n_rows long, share double"}
    return {name: spark.read.schema(s).parquet(os.path.join(folder, name)) for name, s in schemas.items()}


def index_of(corpus: DataFrame, path: str, k: int = 3, cells: int = CELLS, recall: float = RECALL) -> dict[str, DataFrame]:
    """The index of ``corpus`` under ``path``, built only if the corpus has changed since."""
    spark = corpus.sparkSession
    folder = resume(spark, path, stage_key(corpus, f"inverted 1 {k} {cells} {recall}"), lambda f: build(corpus, f, k, cells, recall))
    return open_index(spark, folder)


def chosen_cells(cells: DataFrame, query: Column) -> DataFrame:
    """The cells nearest to the query, as many as hold the share of all rows. (One task ranks them: there are at most CELLS.)"""
    near = cells.withColumn("__q", query).withColumn("near", dot(c("centre"), c("__q")))
    ranked = near.select("cell", "n_rows", "share", F.sum("n_rows").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("near"), "cell")).alias("upto"),
                         F.sum("n_rows").over(Window.partitionBy(F.lit(0))).alias("total"))
    return ranked.where(c("upto") - c("n_rows") < c("share") * c("total")).select("cell")


def probed_rows(index: dict[str, DataFrame], query: Column) -> DataFrame:
    """The rows of the cells nearest to the query; the scan opens no other partition."""
    return index["rows"].join(F.broadcast(chosen_cells(index["cells"], query)), "cell").drop("cell", "unit")


def search(index: dict[str, DataFrame], query: Column, k: int = 3) -> DataFrame:
    """ret_ann_topk: the k most similar rows found for each customer; every customer with k rows gets k.

    ``query`` is one normalised vector (a scalar subquery). Ties go to the
    smaller id. The hits of the cells read, at most k rows a customer, are
    written once, so that asking for customers that came up short does not
    search again."""
    spark = index["rows"].sparkSession
    hits = exact_topk(score(probed_rows(index, query), query), k)
    path = stage_path(spark, "inverted-hits")
    hits.write.parquet(path)
    first = spark.read.schema(hits.schema).parquet(path)
    found = first.groupBy("customer_id").agg(F.count(F.lit(1)).alias("found"))
    short = (index["customers"].join(found, "customer_id", "left")
             .where(F.coalesce(c("found"), F.lit(0)) < F.least(c("n"), F.lit(k))).select("customer_id"))
    if not short.limit(1).count():
        return first
    rest = index["rows"].drop("cell", "unit").join(short, "customer_id", "left_semi")
    second = exact_topk(score(rest, query), k)
    return first.join(short, "customer_id", "left_anti").unionByName(second.select(*first.columns))
