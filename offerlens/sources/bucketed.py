"""Tables bucketed and sorted by their join key, whose joins need no exchange.

Rows are dealt by the key once, when the table is written. Every later join of
two such tables with equal keys and equally many buckets reads bucket by
bucket and shuffles nothing. A key is spread over as many *salts* as its rows
need, so a key with a third of all rows fills many buckets instead of one; the
other side repeats that key's row once for each salt.

The files lie in a folder of their own. The catalogue entry that tells Spark
about the buckets lives in the session, so ``open_bucketed`` makes it anew
where a session does not have it, without touching the files.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["write_bucketed", "open_bucketed", "with_salts", "salted"]

c = F.col

#: Rows of one key that share a salt.
ROWS_A_SALT = 1_000_000


def table_name(path: str) -> str:
    return f"bucketed_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def write_bucketed(df: DataFrame, path: str, keys: list[str], sort: list[str], buckets: int) -> None:
    """Write ``df`` into ``path``, one sorted file for each bucket of ``keys``."""
    (df.repartition(buckets, *keys).sortWithinPartitions(*keys, *sort)
     .write.bucketBy(buckets, *keys).sortBy(*keys, *sort).option("path", path).saveAsTable(table_name(path)))


def open_bucketed(spark: SparkSession, path: str, schema: str, keys: list[str], sort: list[str], buckets: int) -> DataFrame:
    """The bucketed table in ``path``."""
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        by, order = ", ".join(keys), ", ".join([*keys, *sort])
        where = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name)


def with_salts(df: DataFrame, key: str, rows_a_salt: int = ROWS_A_SALT) -> DataFrame:
    """``df`` with the number of salts that its key needs (column ``salts``)."""
    sizes = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_a_salt)).cast("int").alias("salts"))
    return df.join(sizes, key)


def salted(id_col: Column) -> Column:
    """The salt of a row, from its id and its key's ``salts``."""
    return F.pmod(F.xxhash64(id_col), c("salts").cast("long")).cast("int")
