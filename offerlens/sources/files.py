"""CSV / Parquet sinks and read-back with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["write_csv", "read_csv", "escape_breaks", "unescape_breaks", "write_stage", "read_stage", "write_vectors",
           "read_customer"]


def write_csv(df: DataFrame, path: str) -> str:
    """sink_csv: header, no index column; overwrite keeps reruns idempotent."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))
    return path


def escape_breaks(df: DataFrame) -> DataFrame:
    r"""Line breaks in strings as \n and \r (a backslash as \\), so that a CSV row is one line and files can be split."""
    return df.select(*[F.replace(F.replace(F.replace(f.name, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")),
                                 F.lit("\r"), F.lit("\\r")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
                       for f in df.schema.fields])


def unescape_breaks(df: DataFrame) -> DataFrame:
    """Undoes ``escape_breaks``."""
    def back(col):  # a private character stands for the escaped backslash meanwhile
        x = F.replace(F.col(col), F.lit("\\\\"), F.lit("\ue000"))
        x = F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
        return F.replace(x, F.lit("\ue000"), F.lit("\\")).alias(col)
    return df.select(*[back(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """src_csv_scan with an explicit schema: no inference, the text 'None' stays
    a string and ids keep their leading zeros. ``multi_line`` admits line breaks
    inside fields, at the price of one task per file; our own files escape them."""
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("multiLine", multi_line).option("nullValue", None).csv(path))


def write_stage(df: DataFrame, path: str) -> str:
    """Intermediate stages are Parquet (columnar, typed, splittable)."""
    df.write.mode("overwrite").parquet(path)
    return path


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_customer(spark: SparkSession, path: str, customer_id: int, key: str = "customer_id") -> DataFrame:
    """One customer's rows of a vector table; the predicate prunes files and row groups."""
    return spark.read.parquet(path).where(F.col(key) == customer_id)


def write_vectors(df: DataFrame, path: str, n_files: int | None = None, key: str = "customer_id") -> str:
    """emb_batch_write / ext_persist_vectors: vectors clustered by customer.

    Range-partitioned on (key, id) and sorted within files: a customer with a
    third of all rows spans several files of equal size, and a key lookup
    still prunes files and row groups by min/max statistics; no per-key
    folders (millions of customers would mean millions of directories)."""
    order = [key, *[c for c in df.columns if c == "interaction_id"]]
    n = n_files or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
       .write.mode("overwrite").parquet(path))
    return path
