"""Exact dedup: a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition's rows form part of a run of (digest, surviving id,
count), sorted by digest. In each round, ``fan_in`` neighbouring runs are
merged into one: they are cut into ranges by digest, each range is brought
into order, and rows that stand side by side with equal keys become one row,
which keeps the surviving identifier and adds up the counts. Every round's
runs are written as a table. The rounds follow a binomial tree, (run number)
>> log2(fan_in), until one run is left.

The cuts are those of a range partitioning by (run, digest), so no task ever
holds a whole run, and the exchange already delivers what the merge needs:
ordering within the ranges is all that is added. A run has one row for each
digest once it is sorted, so at most ``fan_in`` rows of a digest meet in a
later merge; in the first sort, a text that makes up a third of all rows is
spread over the runs.

The merge key is verified at every level: SHA-256 of the normalised text, its
length in bytes and an independent 64-bit hash have to agree.

Cases: null text counts as empty; rows with a null id are counted, are kept
only when their group has no other id, and then share ``keep_id`` null;
repeated rows of one id are one group, whose rows are all kept if the id is
the one that stays; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import free, join_checked, stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_a_to_z(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same to ASCII texts and is faster; other texts are translated."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, UPPER.lower())))


def digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_bytes, check, run0): the rows' digests, without their texts."""
    norm = docs.select(F.col(id_col).alias("id"), lower_a_to_z(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    return norm.select("id", digest(F.col("norm")).alias("digest"),
                       F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("check"),
                       F.spark_partition_id().alias("run0"))


KEY = ["digest", "n_bytes", "check"]


def merged_runs(runs: DataFrame, keep: str, name: str) -> DataFrame:
    """Rows (run, key, keep_id, group_size) in the order of run and key, one for each; staged as sorted files.

    The window's partitions are ranges of the sorted rows: it needs no exchange beside the range partitioning."""
    dealt = runs.repartitionByRange("run", *KEY)
    order = F.col("keep_id").asc_nulls_last() if keep == "smallest" else F.col("keep_id").desc_nulls_last()
    equal = Window.partitionBy("run", *KEY).orderBy(order)
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (dealt.withColumn("place", F.row_number().over(equal)).withColumn("group_size", F.sum("group_size").over(whole))
            .where("place = 1").drop("place"))
    return stage(rows, name)


def tree_merge(runs: DataFrame, keep: str = "smallest", n_runs: int = 64, fan_in: int = 8) -> DataFrame:
    """Merge the runs of ``digests`` into one row per text: digest, n_bytes, check, keep_id, group_size.

    ``keep`` names the identifier that stays, ``smallest`` or ``largest``."""
    if keep not in ("smallest", "largest") or fan_in < 2:
        raise ValueError("keep is 'smallest' or 'largest', fan_in at least 2")
    level = merged_runs(runs.select(F.pmod("run0", F.lit(n_runs)).alias("run"), *KEY, F.col("id").alias("keep_id"),
                                    F.lit(1).cast("long").alias("group_size")), keep, "sorted-runs")
    left = n_runs
    while left > 1:
        left = -(-left // fan_in)
        level = merged_runs(level.withColumn("run", F.floor(F.col("run") / F.lit(fan_in)).cast("int")), keep, f"merged-runs-{left}")
    return level.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (binary).

    The texts are read once, for the digests; their table is staged and the
    merged runs are joined back to it (a hot digest's rows are split by AQE)."""
    runs = stage(digests(docs, id_col, text_col), "digest-runs")
    merged = tree_merge(runs, keep)
    return (runs.drop("run0").join(merged, KEY)
            .select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row for each text, that of the id that stays.

    Where several rows could stay (they repeat the id, or the group has rows
    without an id), one of them does."""
    groups = stage(exact_groups(docs, id_col, text_col, keep), "groups")
    mark, number = free("__digest", docs.columns), free("__n", docs.columns)
    # an id may stand on several texts, so a row is named by its id and its digest
    gone = stage(groups.where(~F.col("kept") & F.col("id").isNotNull()).select(F.col("id").alias(id_col), F.col("digest").alias(mark))
                 .distinct(), "gone")
    unclear = stage(groups.where(F.col("kept") | F.col("id").isNull()).groupBy("digest")
                    .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias(mark)), "unclear")
    marked = docs.withColumn(mark, digest(lower_a_to_z(F.coalesce(F.col(text_col), F.lit("")))))
    marked = join_checked(marked, gone, [id_col, mark], "left_anti")  # rows without an id match nothing and stay
    if not unclear.limit(1).count():
        return marked.select(*docs.columns)
    order = Window.partitionBy(mark).orderBy(F.col(id_col).asc_nulls_last() if keep == "smallest"
                                                   else F.col(id_col).desc_nulls_last())
    one = (join_checked(marked, unclear, [mark], "left_semi").withColumn(number, F.row_number().over(order))
           .where(F.col(number) == 1))
    return (join_checked(marked, unclear, [mark], "left_anti").select(*docs.columns)
            .unionByName(one.select(*docs.columns)))
