"""Subscriber feature table derived from the driver's tables.

One row per ``c_custkey``. Every input is aggregated to one row per key
*before* it is joined, so each join is 1:1 on the customer key and skewed
keys (one customer holding a large share of orders or events) are absorbed
by map-side partial aggregation instead of a hot join partition.

Plan shape (``explain`` checked):
  lineitem --partial agg by l_orderkey--> join orders on orderkey
           --partial agg by o_custkey--> \
  events   --partial agg by user_id ----->  left joins on the customer key
  conversations --partial agg by conv_id/  (all 1:1, AQE may broadcast small sides)
The reference date is a scalar subquery (one value, evaluated once).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.constants import (
    ACCOUNT_TYPES, CAMPAIGN_RESPONSES, CHANNELS, DEVICES, FLAGSHIP_DEVICES,
    LOW_END_DEVICE_TYPES, LOYALTY_TIERS, MID_DEVICES, NO_CONTACT, OFFERS,
    PAYMENT_METHODS, TOP_APPS,
)
from offerlens.functions.core import pick, round_half_up as rhu
from offerlens.session import stage_path
from offerlens.sources.stages import resume_or_compute
from offerlens.sources.tables import Tables

__all__ = ["reference_date", "order_stats", "event_stats", "transcripts",
           "subscriber_base", "derive_features", "build_subscribers", "lookup_subscribers", "stored_reference_date",
           "device_tier", "net_capability", "network_issue", "usage_pct",
           "SEGMENT_MAP", "DATA_CAPS"]

# Rule parameters of this derivation (ours, documented in the README).
SEGMENT_MAP = {"AUTOMOBILE": "HVC", "BUILDING": "Mass", "FURNITURE": "Youth",
               "MACHINERY": "Business", "HOUSEHOLD": "Mass"}
DATA_CAPS = [5, 10, 20, 50, 100]
RECENT_DAYS = 730
NO_ORDER_GAP = 9999


def reference_date(orders: DataFrame) -> Column:
    """max(o_orderdate) as a date, as a scalar subquery expression."""
    return orders.select(F.max("o_orderdate").cast("date")).scalar()


def order_stats(orders: DataFrame, lineitem: DataFrame, ref: Column) -> DataFrame:
    """Per-customer order and line statistics (one row per o_custkey)."""
    lines = (lineitem
             .groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("n_lines"),
                  F.sum("l_quantity").alias("sum_qty"),
                  F.count_if(F.col("l_returnflag") == "R").alias("n_ret"),
                  F.count_if(F.col("l_returnflag") == "A").alias("n_acc"),
                  F.count_if(F.col("l_tax") >= 0.06).alias("n_hitax")))
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                      F.datediff(ref, F.to_date("o_orderdate")).alias("age_days"))
    ol = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    age = F.col("age_days")
    price = F.col("o_totalprice")
    zero = F.lit(0.0)
    return (ol.groupBy("o_custkey")
            .agg(F.count(F.lit(1)).alias("n_orders"),
                 F.max(age).alias("tenure_days"),
                 F.min(age).alias("gap_days"),
                 F.count_if(F.col("o_orderstatus") == "P").alias("n_pending"),
                 F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"),
                 F.sum(F.when(F.col("o_orderstatus") == "O", price).otherwise(zero)).alias("open_amount"),
                 F.sum(price).alias("total_price"),
                 F.sum(F.when(age < RECENT_DAYS, price).otherwise(zero)).alias("spend_recent"),
                 F.sum(F.when((age >= RECENT_DAYS) & (age < 2 * RECENT_DAYS), price)
                       .otherwise(zero)).alias("spend_prior"),
                 F.sum(F.coalesce("n_lines", F.lit(0))).alias("n_lines"),
                 F.sum(F.coalesce("sum_qty", zero)).alias("sum_qty"),
                 F.sum(F.coalesce("n_ret", F.lit(0))).alias("n_ret"),
                 F.sum(F.coalesce("n_acc", F.lit(0))).alias("n_acc"),
                 F.sum(F.coalesce("n_hitax", F.lit(0))).alias("n_hitax")))


def event_stats(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    return (events.groupBy("user_id")
            .agg(F.count_if(et == "error").alias("n_err"),
                 F.count_if(et.isin("view", "click")).alias("n_login")))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Latest user turn per conversation = the subscriber's care transcript."""
    return (conversations.where(F.col("role") == "user")
            .groupBy("conv_id")
            .agg(F.max_by("text", "turn").alias("transcript_raw")))


def subscriber_base(t: Tables) -> DataFrame:
    orders = t.orders
    ref = reference_date(orders)
    # Hash-partitioned on the key with the session's shuffle width: exactly the
    # distribution the key joins need (no extra exchange when they are
    # sort-merge joins), and the per-subscriber projections that follow run
    # in that many tasks even when the joins become broadcasts.
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    cust = (t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
            .repartition(n, "c_custkey"))
    os_ = order_stats(orders, t.lineitem, ref)
    es = event_stats(t.events)
    tr = transcripts(t.conversations)
    return (cust
            .join(os_, cust.c_custkey == os_.o_custkey, "left")
            .join(es, cust.c_custkey == es.user_id, "left")
            .join(tr, cust.c_custkey == tr.conv_id, "left")
            .drop("o_custkey", "user_id", "conv_id"))


def usage_pct(avg_qty: Column) -> Column:
    """feat_usage_pct: min(x, 130) rounded to 1 decimal."""
    return rhu(F.least(avg_qty / F.lit(50.0) * F.lit(150.0), F.lit(130.0)), 1)


def device_tier(device: Column, device_type: Column, variant: str = "A") -> Column:
    tier = (F.when(device.isin(FLAGSHIP_DEVICES), "Flagship")
            .when(device.isin(MID_DEVICES), "Mid").otherwise("Budget"))
    if variant == "B":
        tier = F.when(device_type.isin(LOW_END_DEVICE_TYPES), "Budget").otherwise(tier)
    return tier


def net_capability(tier: Column, device_type: Column) -> Column:
    return (F.when(device_type.isin(LOW_END_DEVICE_TYPES), "4G")
            .when(tier.isin("Flagship", "Mid"), "5G").otherwise("4G"))


def network_issue(dropped: Column, coverage: Column, latency: Column,
                  complaints: Column, speed: Column) -> Column:
    """feat_network_issue: OR of five thresholds, as 0/1."""
    return ((dropped > 0.12) | (coverage < 0.25) | (latency > 160)
            | (complaints >= 1) | (speed < 6)).cast("int")


def derive_features(base: DataFrame, variant: str = "A") -> DataFrame:
    k = F.col("c_custkey")
    nk = F.col("c_nationkey")
    bal = F.col("c_acctbal")
    n_orders = F.coalesce("n_orders", F.lit(0))
    n_lines = F.coalesce("n_lines", F.lit(0))
    gap = F.coalesce("gap_days", F.lit(NO_ORDER_GAP))
    tenure_days = F.coalesce("tenure_days", F.lit(0))
    share_r = F.when(n_lines > 0, F.col("n_ret") / n_lines).otherwise(F.lit(0.0))
    avg_qty = F.when(n_lines > 0, F.col("sum_qty") / n_lines).otherwise(F.lit(0.0))
    recent = F.coalesce("spend_recent", F.lit(0.0))
    prior = F.coalesce("spend_prior", F.lit(0.0))
    n_err = F.coalesce("n_err", F.lit(0))

    seg = F.lit("Mass")
    for raw, s in reversed(list(SEGMENT_MAP.items())):
        seg = F.when(F.col("c_mktsegment") == raw, s).otherwise(seg)

    df = base.select(
        k.alias("customer_id"),
        seg.alias("segment"),
        F.when(bal >= 6000, "HIGH").when(bal >= 2000, "MED").otherwise("LOW").alias("ltv"),
        gap.cast("int").alias("days_renewal"),
        F.floor(tenure_days / F.lit(30.0)).cast("int").alias("tenure_m"),
        rhu(F.least(gap / F.lit(600.0), F.lit(1.0)), 3).alias("churn"),
        pick(ACCOUNT_TYPES, k % 3).alias("account_type"),
        F.when(nk % 5 == 0, "AR").otherwise("EN").alias("language"),
        (k % 7 != 0).cast("int").alias("consent"),
        usage_pct(avg_qty).alias("data_pct"),
        pick(DATA_CAPS, F.floor(k / F.lit(5.0)) % 5).cast("int").alias("data_cap_gb"),
        (n_orders % 4).cast("int").alias("overage"),
        F.coalesce("sum_qty", F.lit(0.0)).cast("int").alias("voice_min"),
        F.coalesce("n_hitax", F.lit(0)).cast("int").alias("intl_min"),
        (F.coalesce("n_acc", F.lit(0)) % 8).cast("int").alias("roaming_days"),
        F.when(recent > prior * 1.2, "Rising").when(recent < prior * 0.8, "Falling")
         .otherwise("Stable").alias("usage_trend"),
        pick(TOP_APPS, k % 7).alias("top_app"),
        rhu(F.coalesce("n_finished", F.lit(0)) / F.greatest(n_orders, F.lit(1)), 2).alias("pct_5g"),
        rhu(F.coalesce("total_price", F.lit(0.0)) / F.greatest(n_orders, F.lit(1)) / F.lit(1000.0), 1).alias("arpu"),
        F.when(recent > prior * 1.1, "Up").when(recent < prior * 0.9, "Down")
         .otherwise("Flat").alias("arpu_trend"),
        F.floor(F.coalesce("n_pending", F.lit(0)) / F.lit(3.0)).cast("int").alias("late_payments"),
        rhu(F.coalesce("open_amount", F.lit(0.0)) / F.lit(1000.0), 1).alias("outstanding"),
        pick(PAYMENT_METHODS, k % 4).alias("payment_method"),
        pick(DEVICES, F.floor(k / F.lit(3.0)) % 7).alias("device"),
        F.when(k % 20 == 0, "Feature Phone").when(k % 20 == 1, "Router/MiFi")
         .when(k % 20 == 2, "Tablet").when(k % 20 == 3, "IoT").otherwise("Smartphone").alias("device_type"),
        F.floor(tenure_days / F.lit(115.0)).cast("int").alias("device_age"),
        rhu(share_r * F.lit(0.5), 2).alias("congestion"),
        share_r.alias("_share_r"),
        n_err.cast("int").alias("_n_err"),
        pick(CHANNELS, k % 5).alias("channel"),
        F.coalesce("n_login", F.lit(0)).cast("int").alias("app_logins"),
        pick(LOYALTY_TIERS, nk % 4).alias("loyalty"),
        pick(CAMPAIGN_RESPONSES, F.floor(k / F.lit(4.0)) % 4).alias("last_campaign_resp"),
        F.col("transcript_raw").isNotNull().cast("int").alias("complaint"),
        F.when(bal < 0, "Negative").when(bal < 5000, "Neutral").otherwise("Positive").alias("sentiment"),
        (k % 11).cast("int").alias("nps"),
        F.coalesce("transcript_raw", F.lit(NO_CONTACT)).alias("transcript"),
        pick([o[0] for o in OFFERS], k % 10).alias("shown_offer"),
        pick([o[1] for o in OFFERS], k % 10).alias("shown_action_type"),
        pick([o[2] for o in OFFERS], k % 10).alias("shown_value"),
        pick([o[0] for o in OFFERS], (k + 1) % 10).alias("nbo_alt_action"),
        ((n_orders > 0) & (F.coalesce("n_finished", F.lit(0)) * 2 >= n_orders)).cast("int").alias("accept_ind"),
    )
    c = F.col
    df = df.withColumns({
        "lifecycle": F.when(c("days_renewal") <= 60, "Renewal").when(c("days_renewal") >= 360, "AtRisk")
                      .when(c("tenure_m") < 12, "Onboarding").when(c("tenure_m") < 36, "Growth")
                      .otherwise("Maturity"),
        "data_used_gb": rhu(c("data_cap_gb") * c("data_pct") / F.lit(100.0), 1),
        "dunning": (c("late_payments") >= 2).cast("int"),
        "device_tier": device_tier(c("device"), c("device_type"), variant),
        "upgrade_eligible": (c("device_age") >= 20).cast("int"),
        "last_upgrade_m": c("device_age")})
    df = df.withColumn("net_cap", net_capability(c("device_tier"), c("device_type")))
    base_dl = F.when(c("net_cap") == "5G", F.lit(180.0)).otherwise(F.lit(60.0))
    base_lat = F.when(c("net_cap") == "5G", F.lit(18.0)).otherwise(F.lit(40.0))
    df = df.withColumns({
        "dl_speed": rhu(F.greatest(base_dl * (F.lit(1.0) - F.lit(0.6) * c("congestion"))
                                   * (F.lit(1.0) - c("_share_r")), F.lit(3.0)), 1),
        "latency_ms": F.floor(F.least(F.greatest(base_lat + c("congestion") * F.lit(120.0) + c("_n_err"),
                                                 F.lit(8.0)), F.lit(300.0))).cast("int"),
        "dropped_call_rate": rhu(F.least(c("_share_r") * F.lit(0.3), F.lit(0.4)), 3),
        "coverage": rhu(F.greatest(F.lit(1.0) - c("congestion") * F.lit(0.6) - c("_share_r") * F.lit(0.5),
                                   F.lit(0.0)), 2),
        "net_complaints": F.floor(c("_n_err") / F.lit(15.0)).cast("int"),
        "nbo_reason": F.when(c("churn") >= 0.6, "Churn risk detected").when(c("days_renewal") <= 60, "Renewal window")
        .when(c("upgrade_eligible") == 1, "Device upgrade eligible")
        .when(c("data_pct") >= 80, "High data usage trend").otherwise("Loyalty reward due")})
    df = df.withColumn("net_issue", network_issue(c("dropped_call_rate"), c("coverage"), c("latency_ms"),
                                                  c("net_complaints"), c("dl_speed")))
    return df.select(*SUBSCRIBER_COLUMNS)


SUBSCRIBER_COLUMNS = [
    "customer_id", "segment", "ltv", "lifecycle", "account_type", "language", "tenure_m",
    "churn", "days_renewal", "consent", "arpu", "arpu_trend", "late_payments", "outstanding",
    "dunning", "payment_method", "data_cap_gb", "data_used_gb", "data_pct", "overage",
    "voice_min", "intl_min", "roaming_days", "usage_trend", "top_app", "pct_5g", "device",
    "device_type", "device_tier", "net_cap", "device_age", "upgrade_eligible", "last_upgrade_m",
    "dl_speed", "dropped_call_rate", "latency_ms", "coverage", "congestion", "net_complaints",
    "net_issue", "channel", "app_logins", "loyalty", "last_campaign_resp", "complaint",
    "sentiment", "nps", "transcript", "nbo_reason", "nbo_alt_action", "shown_offer",
    "shown_action_type", "shown_value", "accept_ind",
]


#: The orders of the keys looked up are broadcast to the lines up to this many rows; beyond it the join shuffles.
BROADCAST_ORDERS = 500_000


def stored_reference_date(t: Tables) -> Column:
    """The reference date from its own one-row stage, which is computed again only when the orders change."""
    path = stage_path(t.spark, f"reference-{hashlib.md5(t.sf_dir.encode()).hexdigest()[:8]}", unique=False)
    one = resume_or_compute(t.spark, path, lambda: t.orders.agg(F.max("o_orderdate").cast("date").alias("ref")))
    return one.select("ref").scalar()


def lookup_subscribers(t: Tables, keys: list[int], variant: str = "A", ref: Column | None = None) -> DataFrame:
    """flt_key_lookup: the subscriber rows of a few keys, without building those of the others.

    The keys reach the scans of customers, orders, events and conversations as
    pushed filters. The keys' orders are written once; ``lineitem``, which has
    no customer key, is reduced to their lines before it is aggregated. Each
    input table is scanned once, and only rows of the keys are shuffled."""
    keys = [int(k) for k in keys]
    has = lambda col: F.col(col).isin(keys)
    path = stage_path(t.spark, "key-orders")
    mine = t.orders.where(has("o_custkey")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    mine.write.parquet(path)
    orders = t.spark.read.schema(mine.schema).parquet(path)
    numbers = orders.select(F.col("o_orderkey").alias("l_orderkey")).distinct()
    if orders.count() <= BROADCAST_ORDERS:
        numbers = F.broadcast(numbers)
    lines = t.lineitem.join(numbers, "l_orderkey", "left_semi")
    cust = t.customer.where(has("c_custkey")).select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    base = (cust
            .join(order_stats(orders, lines, stored_reference_date(t) if ref is None else ref), F.col("c_custkey") == F.col("o_custkey"), "left")
            .join(event_stats(t.events.where(has("user_id"))), F.col("c_custkey") == F.col("user_id"), "left")
            .join(transcripts(t.conversations.where(has("conv_id"))), F.col("c_custkey") == F.col("conv_id"), "left")
            .drop("o_custkey", "user_id", "conv_id"))
    return derive_features(base, variant)


def build_subscribers(spark, sf_dir: str, variant: str = "A") -> DataFrame:
    return derive_features(subscriber_base(Tables(spark, sf_dir)), variant)
