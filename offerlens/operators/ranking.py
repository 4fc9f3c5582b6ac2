"""Ranking, argmax, dedupe and top-k operators.

Design notes for scale:
* argmax over the fixed offer catalogue is computed *inside the row*
  (``array_max`` over a literal-sized array of structs): no join, no shuffle.
* keep-first dedupe and group argmax use ``min``/``max`` over a struct that
  leads with the ordering key: an aggregate with map-side partial
  aggregation, so a hot key collapses to one row per map partition before
  the shuffle (a window would ship every row of the hot key to one task).
  A struct with strings plans as a sort aggregate: each map partition is
  sorted by the key before its partial step.
* top-k per group uses ``row_number`` <= k, which Spark plans as a partial
  ``WindowGroupLimit`` before the shuffle plus a final one after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.constants import OFFERS
from offerlens.sources.tables import offers_array

__all__ = ["expand_offers", "scored_offer_structs", "rank_offers",
           "with_best_offer", "dedup_keep_first", "argmax_by_group", "topk_per_group",
           "with_positions", "seq_within_group", "paged_list", "head_n"]


def expand_offers(df: DataFrame) -> DataFrame:
    """join_cross_offers: every row x every offer, as a Generate (fan-out fixed
    at the catalogue size) rather than a join."""
    return df.select("*", F.inline(offers_array()))


def _tiebreak_rank(variant: str) -> dict:
    names = [o[0] for o in OFFERS]
    order = names if variant == "A" else sorted(names)
    return {n: i for i, n in enumerate(order)}


def scored_offer_structs(score_fn, variant: str = "A", precomputed: dict | None = None) -> Column:
    """array<struct<score, neg_rank, offer_ord, offer, action_type, price>> for
    all offers; ``score_fn(offer_col, action_type_col)`` scores one offer.

    Struct ordering compares ``score`` first and then ``neg_rank``, so the
    maximum is the best score with ties going to the earliest offer in the
    variant's tie-break order (catalogue order for A, alphabetical for B).
    """
    rank = _tiebreak_rank(variant)
    items = []
    for i, (name, at, price) in enumerate(OFFERS):
        items.append(F.struct(
            (precomputed[name] if precomputed else score_fn(F.lit(name), F.lit(at))).alias("score"),
            F.lit(-rank[name]).alias("neg_rank"),
            F.lit(i).alias("offer_ord"),
            F.lit(name).alias("offer"),
            F.lit(at).alias("action_type"),
            F.lit(float(price)).alias("price")))
    return F.array(*items)


def with_best_offer(df: DataFrame, score_fn, variant: str = "A", signature=None,
                    out: str = "__best") -> DataFrame:
    """Add the in-row argmax struct as column ``out``.

    Offers whose score expressions are identical (``signature(name, type)``
    returns the same key) share one score column, computed once in a lower
    projection; the argmax then only references those columns. This keeps the
    generated code small (each feature expression is not repeated per offer).
    """
    signature = signature or (lambda name, at: (name, at))
    sig_cols, names = {}, {}
    for name, at, _ in OFFERS:
        key = signature(name, at)
        if key not in sig_cols:
            sig_cols[key] = f"__score_{len(sig_cols)}"
            names[sig_cols[key]] = score_fn(F.lit(key[0]), F.lit(key[1]))
        names.setdefault(name, sig_cols[key])
    scored = df.withColumns({col: expr for col, expr in names.items() if col.startswith("__score_")})
    by_offer = {name: F.col(names[name]) for name, _, _ in OFFERS}
    arr = scored_offer_structs(lambda o, at, _m=by_offer: None, variant, by_offer)
    # The argmax is emitted by a one-element Generate rather than a Project:
    # a later filter on the chosen offer then stays above it instead of being
    # pushed down with the whole feature derivation inlined ten times (which
    # overflows the 64 KB method limit and drops the stage out of codegen).
    best = F.inline(F.array(F.struct(F.array_max(arr).alias(out))))
    return scored.select("*", best).drop(*[c for c in names if c.startswith("__score_")])


def rank_offers(df: DataFrame, score_fn, key: str = "customer_id", variant: str = "A") -> DataFrame:
    """topk_offers_ranking: all offers of each row ranked by score (1 = best),
    computed per row (sort the literal-sized array, then posexplode)."""
    arr = F.sort_array(scored_offer_structs(score_fn, variant), asc=False)
    return (df.select(key, F.posexplode(arr).alias("pos", "o"))
              .select(key, (F.col("pos") + 1).cast("int").alias("offer_rank"),
                      F.col("o.offer").alias("offer"), F.col("o.action_type").alias("action_type"),
                      F.col("o.price").alias("price"), F.col("o.score").alias("score")))


def dedup_keep_first(df: DataFrame, key: str | list[str], order_col: str) -> DataFrame:
    """agg_dedup_keep_first: one row per key, the one with the smallest ``order_col``."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [col for col in df.columns if col not in keys and col != order_col]
    packed = F.min(F.struct(F.col(order_col).alias("__ord"), *[F.col(x) for x in rest])).alias("__first")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*keys, F.col("__first.__ord").alias(order_col),
                      *[F.col(f"__first.{x}").alias(x) for x in rest]).select(*df.columns)


def argmax_by_group(df: DataFrame, key: str, score: str, tiebreak: str, cols: list[str]) -> DataFrame:
    """Row with the highest ``score`` per key; ties -> smallest ``tiebreak``."""
    best = F.max(F.struct(F.col(score).alias("__s"), (-F.col(tiebreak)).alias("__t"),
                          *[F.col(x) for x in cols])).alias("__best")
    out = df.groupBy(key).agg(best)
    return out.select(key, F.col("__best.__s").alias(score), *[F.col(f"__best.{x}").alias(x) for x in cols])


def topk_per_group(df: DataFrame, key: str | list[str], order: list[Column], k: int,
                   rank_col: str = "rank") -> DataFrame:
    """win_topk_per_customer: the k first rows per key by ``order``."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def with_positions(df: DataFrame, key: str, order: list[str], out: str = "seq", weight: Column | None = None,
                   weight_out: str = "before", n_parts: int | None = None) -> DataFrame:
    """0-based position of each row within its key by ``order``; with ``weight`` also the sum of the weights before it.

    A plain window over ``partitionBy(key)`` sends a whole key to one task.
    Here (key, order, count, weight) is range-partitioned on (key, order), so a
    hot key spans several partitions; running sums are formed within
    (partition, key), and each piece is shifted by the sums of the same key in
    earlier partitions. That table of sums has one row per (partition, key), so
    even a hot key contributes at most ``n_parts`` rows to its window. The
    other columns take no part in this; they meet the positions in one join on
    (key, order), which no key makes hot.

    The partition ids are materialised once (``checkpoint`` of these few
    columns into the shared folder): range bounds come from a sample drawn for
    each exchange, so two branches with exchanges of their own could disagree.
    Rows of equal (key, order) are numbered one after another in any order;
    rows without a key or an order value have no position."""
    from offerlens.session import checkpoint_root

    spark = df.sparkSession
    checkpoint_root(spark)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__w", F.coalesce(weight, F.lit(0)).cast("long") if weight is not None else F.lit(0).cast("long"))
    narrow = rows.select(key, *order, "__w").groupBy(key, *order).agg(F.count(F.lit(1)).alias("__c"), F.sum("__w").alias("__s"))
    r = narrow.repartitionByRange(n, key, *order).withColumn("__pid", F.spark_partition_id()).checkpoint(eager=True)
    earlier = Window.partitionBy("__pid", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = r.withColumns({"__lc": F.sum("__c").over(earlier), "__ls": F.sum("__s").over(earlier)})
    before = Window.partitionBy(key).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (r.groupBy("__pid", key).agg(F.sum("__c").alias("__tc"), F.sum("__s").alias("__ts"))
               .select("__pid", key, F.sum("__tc").over(before).alias("__oc"), F.sum("__ts").over(before).alias("__os")))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    places = local.join(offsets, ["__pid", key]).select(
        key, *order, (zero("__lc") + zero("__oc")).alias("__first"), (zero("__ls") + zero("__os")).alias("__upto"))
    equal = Window.partitionBy(key, *order).orderBy("__w")
    placed = (rows.join(places, [key, *order], "left")
              .withColumn(out, (F.col("__first") + F.row_number().over(equal) - 1).cast("int")))
    if weight is not None:
        inside = equal.rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn(weight_out, F.col("__upto") + F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    return placed.select(*df.columns, out, *([weight_out] if weight is not None else []))


def seq_within_group(df: DataFrame, key: str, order: list[str], out: str = "seq",
                     n_parts: int | None = None) -> DataFrame:
    """0-based position of each row within its key by ``order``, whatever the size of the key."""
    return with_positions(df, key, order, out, n_parts=n_parts)


def paged_list(df: DataFrame, key: str, order: list[str], item: Column, delimiter: str, page_size: int,
               weight: Column | None = None, n_parts: int | None = None) -> DataFrame:
    """(key, page, n_items, items): each key's items in order, joined by ``delimiter``, in pages of bounded size.

    A page holds the items before whose first ``page_size`` items (or weight)
    begin, so a page is at most one item longer. A key with a third of all rows
    is many rows, each made by its own group of the aggregate; the pages of a
    key, joined by the delimiter, are its whole list."""
    rows = with_positions(df.select(key, *order, item.alias("__item"), *([weight.alias("__weight")] if weight is not None else [])),
                          key, order, "__seq", F.col("__weight") if weight is not None else None, "__before", n_parts)
    upto = "__before" if weight is not None else "__seq"
    joined = F.expr(f"listagg(__item, '{delimiter}') WITHIN GROUP (ORDER BY __seq)")
    return (rows.withColumn("page", F.floor(F.col(upto) / F.lit(page_size)).cast("int")).groupBy(key, "page")
            .agg(F.count(F.lit(1)).alias("n_items"), joined.alias("items")))


def head_n(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """lim_head_n: first n rows by an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)
