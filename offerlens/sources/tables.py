"""Input tables and literal dimensions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.constants import OFFERS

__all__ = ["TABLES", "load", "Tables", "offers_df", "offers_array", "OFFER_SCHEMA"]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


_SCHEMAS: dict = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one table; projections and filters push into the scan.

    The schema is inferred once for each version of a table and then passed explicitly, so
    later plans over the same table skip the footer-reading job."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    key = (path, _written(spark, path))
    schema = _SCHEMAS.get(key)
    if schema is None:
        df = spark.read.parquet(path)
        _SCHEMAS[key] = df.schema
        return df
    return spark.read.schema(schema).parquet(path)


def _written(spark: SparkSession, path: str) -> tuple[int, int]:
    """Modification time and length of the file or folder: a table that was written anew is read anew."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    return status.getModificationTime(), status.getLen()


class Tables:
    """Lazy accessor: ``t = Tables(spark, dir); t.orders`` returns the scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return load(self.spark, self.sf_dir, name)
        raise AttributeError(name)


OFFER_SCHEMA = T.StructType([
    T.StructField("offer_ord", T.IntegerType(), False),
    T.StructField("offer", T.StringType(), False),
    T.StructField("action_type", T.StringType(), False),
    T.StructField("price", T.DoubleType(), False),
])


def offers_df(spark: SparkSession) -> DataFrame:
    """The 10-row offer catalogue as a DataFrame (src_literal_dim).

    Its size is fixed by the catalogue, so it is always safe to broadcast.
    """
    rows = [(i, n, t, float(p)) for i, (n, t, p) in enumerate(OFFERS)]
    return F.broadcast(spark.createDataFrame(rows, OFFER_SCHEMA))


def offers_array():
    """The catalogue as a literal ``array<struct>`` column.

    Expanding it with ``inline`` gives every row x every offer as a Generate
    node: no join, no shuffle, and the fan-out is fixed at len(OFFERS).
    """
    return F.array(*[
        F.struct(F.lit(i).alias("offer_ord"), F.lit(n).alias("offer"),
                 F.lit(t).alias("action_type"), F.lit(float(p)).alias("price"))
        for i, (n, t, p) in enumerate(OFFERS)
    ])
