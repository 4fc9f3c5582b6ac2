"""Recommendation, context, experience and evaluation plans.

The rule path keeps everything for one subscriber in one row: the best offer
is chosen in-row over the fixed catalogue, the context struct, texts and
guard are projections of that row, and the evaluation is one global
aggregate. The only exchanges are the ones inside the subscriber build and
the final single-row aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.constants import (
    BASELINE_FACTOR, DEFAULT_BRAND, EXTRAPOLATE_TO, MONTHS,
)
from offerlens.functions.core import fmt_money, fmt_percent, round_half_up as rhu, safe_ratio
from offerlens.functions.pyjson import json_text
from offerlens.functions.text import redact
from offerlens.operators import rules
from offerlens.operators.ranking import with_best_offer

c = F.col

__all__ = ["REC_COLUMNS", "recommend_rules", "decide", "context_struct", "source_groups",
           "experience", "EVAL_KEEP", "evaluation_detail", "join_evaluation", "summary_wide",
           "summary_long", "format_summary"]

REC_COLUMNS = ["customer_id", "action", "action_type", "propensity", "value_qar"]


def recommend_rules(subs: DataFrame, variant: str = "A", keep_all: bool = False) -> DataFrame:
    """ml_recommend on the rule score: best offer per subscriber (in-row argmax).

    Output: customer_id, action, action_type, propensity (4 decimals), value_qar
    (plus every subscriber column when ``keep_all``).
    """
    out = with_best_offer(subs, rules.propensity, variant, signature=rules.propensity_signature)
    rec = [c("__best.offer").alias("action"), c("__best.action_type").alias("action_type"),
           rhu(c("__best.score"), 4).alias("propensity"), c("__best.price").alias("value_qar")]
    if keep_all:
        return out.select(*subs.columns, *rec)
    return out.select("customer_id", *rec)


def decide(subs: DataFrame, variant: str = "A", rec: DataFrame | None = None) -> DataFrame:
    """Subscriber row + recommendation + guard status (one row per subscriber).

    ``rec`` is a recommendation with ``REC_COLUMNS``, one row per subscriber,
    say the model's; without one the rule score decides within the row."""
    d = recommend_rules(subs, variant, keep_all=True) if rec is None else subs.join(rec.select(*REC_COLUMNS), "customer_id")
    return d.withColumn("guard_status", rules.guard(variant))


# FIXED VALUES: context field groups by source system (internal field names).
SOURCE_GROUPS = {
    "bss_crm": ["account_type", "language", "tenure_m", "segment", "ltv", "lifecycle",
                "days_renewal", "consent"],
    "billing": ["arpu", "arpu_trend", "late_payments", "outstanding", "dunning", "payment_method",
                "value_qar"],
    "consumption": ["data_cap_gb", "data_used_gb", "data_pct", "overage", "voice_min", "intl_min",
                    "roaming_days", "usage_trend", "top_app", "pct_5g"],
    "device_network": ["device", "device_type", "device_tier", "net_cap", "device_age",
                       "upgrade_eligible", "last_upgrade_m", "dl_speed", "dropped_call_rate",
                       "latency_ms", "coverage", "congestion", "net_complaints", "net_issue"],
    "engagement": ["channel", "app_logins", "loyalty", "last_campaign_resp"],
    "care": ["complaint", "sentiment", "nps", "transcript"],
    "nba": ["action", "action_type", "churn", "nbo_alt_action", "nbo_reason"],
}

# Variant B field names that differ from A (A name -> B name); A-only fields.
B_RENAMES = {"net_cap": "network_capability", "dl_speed": "dl_speed_mbps",
             "coverage": "coverage_score", "congestion": "cell_congestion",
             "net_complaints": "network_complaints_90d", "net_issue": "network_issue"}
A_ONLY = ["outstanding", "dunning"]

# Context keys in order (internal names).
CONTEXT_FIELDS = [
    "action", "action_type", "propensity", "value_qar", "segment", "ltv", "lifecycle",
    "account_type", "language", "tenure_m", "churn", "days_renewal", "consent", "arpu",
    "arpu_trend", "late_payments", "outstanding", "dunning", "data_cap_gb", "data_used_gb",
    "data_pct", "overage", "voice_min", "intl_min", "roaming_days", "usage_trend", "top_app",
    "pct_5g", "device", "device_type", "device_tier", "net_cap", "device_age",
    "upgrade_eligible", "last_upgrade_m", "dl_speed", "dropped_call_rate", "latency_ms",
    "coverage", "congestion", "net_complaints", "net_issue", "channel", "app_logins",
    "loyalty", "last_campaign_resp", "complaint", "sentiment", "nps", "transcript", "nbo_reason",
]


RETRIEVAL_FIELDS = ["retrieval_mode", "retrieved_interactions"]


def context_fields(variant: str = "A", retrieval: bool = False) -> list[tuple[str, Column]]:
    """(output name, column) pairs of the flat context; transcript is redacted.

    With ``retrieval`` the record says how its interactions were chosen and holds them."""
    out = []
    for f in CONTEXT_FIELDS:
        if variant == "B" and f in A_ONLY:
            continue
        col = redact(c(f)) if f == "transcript" else c(f)
        name = B_RENAMES.get(f, f) if variant == "B" else f
        out.append((name, col))
    return out + [(f, c(f)) for f in RETRIEVAL_FIELDS if retrieval]


def context_struct(variant: str = "A", retrieval: bool = False) -> Column:
    """proj_context_struct: one nested record per subscriber x chosen offer."""
    return F.struct(*[col.alias(name) for name, col in context_fields(variant, retrieval)])


def context_json(df: DataFrame, variant: str = "A", retrieval: bool = False) -> Column:
    """fn_to_json: the context record of ``df``'s rows as indented JSON, with offer values as whole amounts."""
    fields = [(n, col.cast("bigint") if n == "value_qar" else col) for n, col in context_fields(variant, retrieval)]
    record = F.struct(*[col.alias(n) for n, col in fields])
    return json_text(record, df.select(record.alias("r")).schema["r"].dataType)


def source_groups() -> Column:
    """proj_group_by_source: context fields grouped by source system (7 structs)."""
    return F.struct(*[
        F.struct(*[(redact(c(f)) if f == "transcript" else c(f)).alias(f) for f in fields]).alias(g)
        for g, fields in SOURCE_GROUPS.items()])


def experience(decided: DataFrame, variant: str = "A", brand: str = DEFAULT_BRAND,
               response: Column | None = None) -> DataFrame:
    """Stages 2+4+5 for every subscriber: context -> texts -> guard.

    ``response`` is an optional column holding raw model output (JSON); when
    absent, the rule texts are used and tagged as offline.
    """
    d = decided.withColumn("transcript", redact(c("transcript")))
    why = rules.rationale(variant)
    d = d.withColumn("__why", why).withColumn("__how", rules.message(c("__why"), variant, brand))
    adj = rules.adjudicate(response if response is not None else F.lit(None).cast("string"),
                           c("__why"), c("__how"), variant, enabled=response is not None)
    d = d.withColumn("__gen", adj)
    if "guard_status" not in d.columns:
        d = d.withColumn("guard_status", rules.guard(variant))
    return d.select(c("customer_id").alias("msisdn"), "action", "action_type", "channel", "sentiment",
                    c("__gen.rationale").alias("rationale_why"), c("__gen.message").alias("message_how"),
                    "guard_status", c("__gen.gen_source").alias("gen_source"))


EVAL_KEEP = ["customer_id", "churn", "data_pct", "overage", "days_renewal", "ltv", "usage_trend",
             "upgrade_eligible", "sentiment", "loyalty", "consent", "net_issue", "device_type"]


def _eval_columns(df: DataFrame) -> DataFrame:
    pb = (c("propensity") * F.lit(BASELINE_FACTOR))
    d = df.withColumn("p_baseline", pb)
    lf = rules.lift(c("action"), c("action_type"), c("guard_status"))
    return d.withColumn("lift", lf).withColumn("p_treated", rules.treated_probability(c("p_baseline"), c("lift")))


def evaluation_detail(decided: DataFrame) -> DataFrame:
    """Evaluation detail from the in-row decided table (no joins needed)."""
    d = decided.select(*REC_COLUMNS, *[x for x in EVAL_KEEP if x != "customer_id"], "guard_status")
    return _eval_columns(d)


def join_evaluation(rec: DataFrame, subs: DataFrame, guarded: DataFrame) -> DataFrame:
    """join_eval_three_way: rec + subscriber columns + guard status.

    All three inputs hold one row per subscriber, so both joins are 1:1
    equi-joins on the key; the second keeps both key columns.
    """
    m = rec.join(subs.select(*EVAL_KEEP), "customer_id", "inner")
    n = guarded.select("msisdn", "guard_status")
    m = m.join(n, m.customer_id == n.msisdn, "inner")
    return _eval_columns(m)


def summary_wide(detail: DataFrame) -> DataFrame:
    """agg_mean_rate, agg_revenue_sum, agg_count, agg_uplift_ratio, agg_extrapolate:
    one global aggregate (partial per partition, one tiny final merge)."""
    rev = lambda p: F.sum(p * c("value_qar") * F.lit(float(MONTHS)))
    agg = detail.agg(F.count(F.lit(1)).alias("n"),
                     F.avg("p_baseline").alias("acceptance_baseline"),
                     F.avg("p_treated").alias("acceptance_treated"),
                     rev(c("p_baseline")).alias("revenue_baseline"),
                     rev(c("p_treated")).alias("revenue_treated"))
    incr = c("revenue_treated") - c("revenue_baseline")
    out = agg.select(
        "n", "acceptance_baseline", "acceptance_treated", "revenue_baseline", "revenue_treated",
        (safe_ratio(c("revenue_treated"), c("revenue_baseline")) - F.lit(1.0)).alias("revenue_uplift"),
        incr.alias("incremental_revenue"),
        *[(incr * safe_ratio(F.lit(float(t)), c("n").cast("double"))).alias(f"extrapolated_{t}")
          for t in EXTRAPOLATE_TO])
    return out


def format_summary(wide: DataFrame, variant: str = "A") -> DataFrame:
    """Presentation strings, formatted like the published summaries."""
    a, b = EXTRAPOLATE_TO
    return wide.select(
        fmt_percent(c("acceptance_baseline"), 1).alias("acceptance_baseline"),
        fmt_percent(c("acceptance_treated"), 1).alias("acceptance_treated"),
        F.concat(F.lit("+"), fmt_percent(c("revenue_uplift"), 1)).alias("revenue_uplift"),
        fmt_money(c("incremental_revenue")).alias("incremental_revenue"),
        fmt_money(c(f"extrapolated_{a}")).alias(f"extrapolated_{a}"),
        fmt_money(c(f"extrapolated_{b}")).alias(f"extrapolated_{b}"))


# FIXED VALUES: summary metric labels per variant, in published order.
METRIC_LABELS = {
    "A": ["Acceptance_baseline", "Acceptance_treated", "Revenue_uplift_pct", "Incr_annual_QAR_sample",
          "Extrap_500k_QAR", "Extrap_2M_QAR"],
    "B": ["Acceptance baseline", "Acceptance treated", "Revenue uplift %", "Incr annual rev QAR (sample)",
          "Extrapolated +QAR/yr @500k", "Extrapolated +QAR/yr @2M"],
}


def summary_long(wide: DataFrame, variant: str = "A") -> DataFrame:
    """agg_summary_long: wide metrics -> (metric_ord, metric, value) rows via unpivot."""
    f = format_summary(wide, variant)
    labels = METRIC_LABELS[variant]
    cols = f.columns
    pairs = [F.struct(F.lit(i).alias("metric_ord"), F.lit(labels[i]).alias("metric"),
                      c(cols[i]).alias("value")) for i in range(len(cols))]
    return f.select(F.inline(F.array(*pairs)))
