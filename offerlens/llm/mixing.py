"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

A document's hash, a fixed function of its id and text, decides whether the
mix takes it: a source takes every document whose hash lies below the
source's threshold. Targets above a source's size take every document
``floor(target / size)`` times and the threshold decides on one copy more.
Thresholds are found from histograms: words summed by (source, leading hash
bits), running sums over the buckets (a bounded number per source), and only
the bucket that holds the boundary is refined by the next bits, until a
bucket is a single hash value. No document is sorted, and a larger budget's
threshold is never below a smaller one's, so mixes are nested.

Cases: null text has size 0; a null source is a source of its own, last in
order; sources without words have target 0; rows of equal id and text share
a hash and are taken or left together; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import BROADCAST_ROWS, WORD_PATTERN, free, stage

#: Hash bits, and bits resolved in each round: 4 rounds of 4096 buckets.
HASH_BITS, LEVEL_BITS = 48, 12


def n_words(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, hash): what the mix needs of a document, staged without its text."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text).alias("size"),
                       mix_hash(F.col(id_col), text).alias("hash"))


def mix_hash(id_col: Column, text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(id_col, F.xxhash64(text)), 64 - HASH_BITS)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
                   most: int = 2) -> DataFrame:
    """(source, source_size, target): ``share`` of all words dealt to the sources by weight.

    The weights repeat over the sources in code-point order, null last. A
    target stops at ``most`` times its source's size and the excess is dealt
    again by weight among the others until none is above. The sources stay in
    a table; a round sends two sums to the driver."""
    by = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]),
                        ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = stage(by.select("source", "source_size", pick.alias("weight"),
                         (F.col("source_size") * most).alias("cap")), "source-weights")
    total = by.agg(F.sum("source_size")).first()[0] or 0
    budget, level, capped = share * total, None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("cap")
        n, full, open_weight = by.agg(F.count_if(above), F.sum(F.when(above, F.col("cap")).otherwise(0)),
                                      F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        capped, level = n, max(0.0, (budget - full) / open_weight)
    target = (F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double")) if level is not None
              else F.lit(0.0))
    return by.select("source", "source_size", target.cast("double").alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, full, threshold): every document ``full``
    times, and once more where hash < threshold. Staged."""
    state = stage(targets.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("full"),
    ).select("*", (F.col("target") - F.col("full") * F.col("source_size")).alias("rest"),
             F.lit(0).cast("long").alias("prefix")), "mix-state-0")
    small = state.count() <= BROADCAST_ROWS
    for k in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (k + 1)
        now = state.select(F.col("source").alias("s"), "prefix", "rest")
        hit = sized.join(F.broadcast(now) if small else now,
                         F.col("source").eqNullSafe(F.col("s"))
                         & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")))
        hist = hit.groupBy("s", "rest", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("s").orderBy("bucket")
        cum = hist.select("s", "rest", "bucket", "n", F.sum("n").over(run).alias("upto"))
        over = F.col("upto") > F.col("rest")  # from the boundary bucket on
        edge = cum.groupBy("s").agg(
            F.min(F.when(over, F.col("bucket"))).alias("edge"),
            F.min(F.when(over, F.struct("bucket", "n")))["n"].alias("edge_n"),
            F.max(F.when(~over, F.col("upto"))).alias("below"))
        state = stage(state.drop("edge_n").join(F.broadcast(edge) if small else edge, F.col("source").eqNullSafe(F.col("s")), "left")
                      .select("source", "source_size", "target", "full",
                              (F.col("rest") - F.coalesce("below", F.lit(0))).alias("rest"), "edge_n",
                              F.coalesce("edge", F.shiftleft(F.col("prefix") + 1, LEVEL_BITS)).alias("prefix")),
                      f"mix-state-{k + 1}")
    # the boundary hash value itself is taken when that comes nearer to the target
    near = F.coalesce(F.col("edge_n") - F.col("rest") < F.col("rest"), F.lit(False))
    return state.select("source", "source_size", "target", "full",
                        (F.col("prefix") + F.when(near, 1).otherwise(0)).alias("threshold"))


def mix(docs_sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(id, size, source, source_size, target, copies, taken) for a staged table of ``sizes``."""
    limits = thresholds(docs_sized, source_targets(docs_sized, weights, share, most))
    limits = limits.withColumnRenamed("source", "s")
    joined = docs_sized.join(F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits,
                             F.col("source").eqNullSafe(F.col("s")))
    copies = copies_of(most, F.col("hash"), F.col("full"), F.col("threshold"))
    return joined.select("id", "size", "source", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns. Texts are not shuffled."""
    sized = stage(sizes(docs, id_col, text_col, source_col), "sizes")
    of, limit, hashed_col, copy = (free(x, docs.columns) for x in ("__source", "__limit", "__hash", "__copy"))
    limits = thresholds(sized, source_targets(sized, weights, share, most)).select(
        F.col("source").alias(of), F.struct("full", "threshold").alias(limit))
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits
    hashed = docs.withColumn(hashed_col, mix_hash(F.col(id_col), F.col(text_col)))
    copies = copies_of(most, F.col(hashed_col), F.col(limit)["full"], F.col(limit)["threshold"])
    return (hashed.join(limits, F.col(source_col).eqNullSafe(F.col(of)))
            .select(*docs.columns, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias(copy)).drop(copy))


def copies_of(most: int, hash_: Column, full: Column, threshold: Column) -> Column:
    return F.least(full + F.when(hash_ < threshold, 1).otherwise(0), F.lit(most)).cast("long")
