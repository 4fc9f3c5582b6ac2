"""Decision rules as columnar expressions.

Every rule is a ``Column`` built from ``when`` chains over the subscriber /
context columns (internal names, see ``plans.subscriber.SUBSCRIBER_COLUMNS``),
so it stays inside whole-stage codegen. Variant "A" and "B" differences are
parameters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.constants import (
    CHANNEL_LIMITS, DEFAULT_BRAND, GUARD_APPROVED, GUARD_BLOCKED,
    GUARD_CREDIT, GUARD_HOLD, GUARD_SOFTENED, LIFT_CAP, PROB_CAP, SOURCE_TAGS,
)
from offerlens.functions.core import clip, fmt_fixed0, map_lookup, round_half_even
from offerlens.functions.text import (
    NUMBER_PATTERN, arabic_digits_to_ascii, nice_offer_name, strip, strip_zeros, truncate,
)

c = F.col

__all__ = [
    "propensity", "propensity_signature", "heuristic_score", "guard_full", "guard_margin", "guard", "lift",
    "treated_probability", "rationale", "message_core", "message", "allowed_numbers",
    "ungrounded_numbers", "first_ungrounded", "grounding", "grounding_reason", "prompt", "adjudicate",
    "RESPONSE_SCHEMA",
]


def _w(cond: Column, weight: float) -> Column:
    # plain floats become double literals on the JVM side (fewer driver round trips than F.lit)
    return F.when(cond, float(weight)).otherwise(0.0)


def propensity(offer: Column, action_type: Column) -> Column:
    """rule_propensity: additive score for one subscriber x offer, clipped to [0.01, 0.95].

    Thresholds on churn (> 0.6) and data_pct (> 80) are strict here.
    """
    at = action_type
    s = (F.lit(0.12)
         + _w((at == "Retention") & (c("churn") > 0.6), 0.25)
         - _w((at == "Upsell") & (c("churn") > 0.6), 0.10)
         + _w((at == "Upsell") & (c("data_pct") > 80), 0.18)
         + _w((at == "NBO") & (c("segment") == "Mass"), 0.08)
         + _w((c("lifecycle") == "Renewal") & (at == "Retention"), 0.15)
         + _w(c("ltv") == "HIGH", 0.05)
         + _w((offer == "Device_Upgrade_iPhone") & (c("upgrade_eligible") == 1), 0.15)
         - _w(c("sentiment") == "Negative", 0.08)
         + _w((c("usage_trend") == "Rising") & (at == "Upsell"), 0.10)
         - _w(c("consent") == 0, 0.05)
         - _w((c("net_issue") == 1) & (at == "Upsell"), 0.10)
         + _w((c("net_issue") == 1) & (at == "Retention"), 0.06))
    return clip(s, 0.01, 0.95)


def propensity_signature(offer: str, action_type: str) -> tuple:
    """Offers with equal (signature) share one propensity expression: the rule
    only looks at the action type, plus one offer-specific bonus."""
    return ("Device_Upgrade_iPhone" if offer == "Device_Upgrade_iPhone" else "", action_type)


def heuristic_score(action_type: Column) -> Column:
    """rule_heuristic_ranking: the reduced score used to rank offers for one
    subscriber in the interactive view (base 0.15, four rules, cap 0.95)."""
    at = action_type
    s = (F.lit(0.15)
         + _w((at == "Retention") & (c("churn") > 0.6), 0.25)
         + _w((at == "Upsell") & (c("data_pct") > 80), 0.18)
         + _w((c("lifecycle") == "Renewal") & (at == "Retention"), 0.15)
         + _w(c("ltv") == "HIGH", 0.05))
    return F.least(s, F.lit(0.95))


def guard_full(action_type: Column = None, value: Column = None) -> Column:
    """rule_guard_full (variant A): first match wins."""
    at = c("action_type") if action_type is None else action_type
    v = c("value_qar") if value is None else value
    return (F.when(c("consent") == 0, GUARD_BLOCKED)
            .when((at == "Retention") & (c("ltv") == "LOW") & (c("churn") >= 0.6), GUARD_SOFTENED)
            .when((c("late_payments") >= 2) & (v > 150), GUARD_CREDIT)
            .when((c("net_issue") == 1) & (at == "Upsell"), GUARD_HOLD)
            .otherwise(GUARD_APPROVED))


def guard_margin(action_type: Column = None, value: Column = None) -> Column:
    """rule_guard_margin (variant B): three-way status."""
    at = c("action_type") if action_type is None else action_type
    v = c("value_qar") if value is None else value
    return (F.when((at == "Retention") & (c("ltv") == "LOW") & (c("churn") >= 0.6), GUARD_SOFTENED)
            .when((c("late_payments") >= 2) & (v > 150), GUARD_CREDIT)
            .otherwise(GUARD_APPROVED))


def guard(variant: str = "A", **kw) -> Column:
    return guard_full(**kw) if variant == "A" else guard_margin(**kw)


def lift(offer: Column = None, action_type: Column = None, guard_status: Column = None) -> Column:
    """rule_lift: additive multiplier; consent 0 resets it to 1.0; capped at 1.55."""
    a = c("action") if offer is None else offer
    at = c("action_type") if action_type is None else action_type
    g = c("guard_status") if guard_status is None else guard_status
    x = (F.lit(1.10)
         + _w((c("overage") >= 1) | (c("data_pct") >= 80), 0.12)
         + _w(c("days_renewal") <= 60, 0.10)
         + _w((at == "Retention") & (c("churn") >= 0.6), 0.10)
         + _w((c("usage_trend") == "Rising") & (at == "Upsell"), 0.06)
         + _w((c("upgrade_eligible") == 1) & a.contains("Device"), 0.08)
         + _w(c("sentiment") == "Negative", 0.06)
         + _w((c("net_issue") == 1) & at.isin("Retention", "CrossSell"), 0.07)
         - _w((c("net_issue") == 1) & (at == "Upsell"), 0.04)
         + _w(c("loyalty").isin("Gold", "Platinum"), 0.04)
         + F.lit(0.05)
         - _w(g.isin(GUARD_SOFTENED, GUARD_CREDIT), 0.05))
    x = F.when(c("consent") == 0, F.lit(1.0)).otherwise(x)
    return F.least(x, F.lit(LIFT_CAP))


def treated_probability(p_baseline: Column, lift_col: Column) -> Column:
    """rule_treated_prob: clip(p_baseline * lift, 0, 0.95); NaN/NULL stay as they are."""
    raw = p_baseline * lift_col
    return F.when(raw.isNull() | F.isnan(raw), raw).otherwise(clip(raw, 0.0, PROB_CAP))


# ---------------------------------------------------------------------------
# texts
# ---------------------------------------------------------------------------

def _pct0(x: Column) -> Column:
    """Python ``{:.0%}``."""
    return F.concat(fmt_fixed0(x * F.lit(100.0)), F.lit("%"))


def _network_details_b() -> Column:
    parts = F.concat_ws(
        ", ",
        F.when(c("dropped_call_rate") > 0.05,
               F.concat(F.lit("high dropped-call rate ("), _pct0(c("dropped_call_rate")), F.lit(")"))),
        F.when(c("coverage") < 0.4, F.lit("weak coverage at their location")),
        F.when(c("latency_ms") > 120, F.concat(F.lit("high latency ("), c("latency_ms").cast("string"), F.lit("ms)"))),
        F.when(c("dl_speed") < 10, F.concat(F.lit("low speeds ("), fmt_fixed0(c("dl_speed")), F.lit("Mbps)"))),
        F.when(c("net_complaints") >= 1,
               F.concat(c("net_complaints").cast("string"), F.lit(" network complaint(s) in 90 days"))),
    )
    return F.when(parts == "", F.lit("degraded experience")).otherwise(parts)


def rationale(variant: str = "A") -> Column:
    """rule_rationale: the reasons that apply, in order, joined by ', '."""
    s = lambda x: x.cast("string")
    if variant == "A":
        issue = F.concat(F.lit("is experiencing network issues (dropped-call rate "),
                         _pct0(c("dropped_call_rate")), F.lit(")"))
        care = F.concat(F.lit('recently contacted care: "'), c("transcript"), F.lit('"'))
        over = F.concat(F.lit("exceeded data cap in "), s(c("overage")), F.lit(" of the last 3 months"))
        prefix = "Subscriber "
    else:
        issue = F.concat(F.lit("is experiencing network issues ("), _network_details_b(), F.lit(")"))
        care = F.concat(F.lit("recently contacted care ("), c("transcript"), F.lit(")"))
        over = F.concat(F.lit("exceeded the data cap in "), s(c("overage")), F.lit(" of the last 3 months"))
        prefix = "Customer "
    parts = F.concat_ws(
        ", ",
        F.when(c("net_issue") == 1, issue),
        F.when((c("sentiment") == "Negative") | (c("complaint") == 1), care),
        F.when(c("overage") >= 1, over),
        F.when(c("data_pct") >= 80, F.concat(F.lit("is a heavy data user ("), fmt_fixed0(c("data_pct")),
                                             F.lit("% of "), s(c("data_cap_gb")), F.lit("GB)"))),
        F.when(c("usage_trend") == "Rising", F.lit("has rising data usage")),
        F.when(c("days_renewal") <= 60, F.concat(F.lit("is "), s(c("days_renewal")), F.lit(" days from renewal"))),
        F.when(c("upgrade_eligible") == 1, F.concat(F.lit("is eligible for a device upgrade ("), c("device"),
                                                     F.lit(", "), s(c("device_age")), F.lit("m old)"))),
        F.when(c("churn") >= 0.6, F.lit("shows elevated churn risk")),
        F.when(c("loyalty").isin("Gold", "Platinum"),
               F.concat(F.lit("is a "), c("loyalty"), F.lit(" loyalty member"))),
    )
    fallback = F.concat(F.lit("is an active "), c("segment"), F.lit(" customer (tenure "),
                        s(c("tenure_m")), F.lit("m)"))
    body = F.when(parts == "", fallback).otherwise(parts)
    return F.concat(F.lit(prefix), body, F.lit("."))


def message_core(variant: str = "A") -> Column:
    dash = " — " if variant == "A" else " - "
    o = nice_offer_name(c("action"))
    at = c("action_type")
    empath = (c("sentiment") == "Negative") | (c("churn") >= 0.6) | (c("net_issue") == 1)
    renewal = F.when(c("days_renewal") <= 60,
                     F.concat(F.lit(", and your renewal is in " if variant == "A" else " and your renewal is in "),
                              c("days_renewal").cast("string"), F.lit(" days"))).otherwise(F.lit(""))
    headroom = " gives you more headroom" if variant == "A" else " gives you headroom"
    return (F.when(c("net_issue") == 1,
                   F.concat(F.lit(f"We noticed your service hasn't been at its best lately{dash}to make it right, our "),
                            o, F.lit(" is ready for you")))
            .when(empath, F.concat(F.lit(f"Thanks for being with us{dash}to make things right, our "), o,
                                   F.lit(" is ready for you")))
            .when((at == "Upsell") & (c("upgrade_eligible") == 1) & c("action").contains("Device"),
                  F.concat(F.lit("You're eligible to upgrade your "), c("device"), F.lit(dash), o, F.lit(" is ready")))
            .when(at == "Upsell",
                  F.concat(F.lit("You're using "), fmt_fixed0(c("data_pct")), F.lit("% of your "),
                           c("data_cap_gb").cast("string"), F.lit("GB" + dash), o, F.lit(headroom)))
            .when(at == "Retention", F.concat(F.lit("Based on your usage, our "), o, F.lit(" keeps you covered"), renewal))
            .when(at == "CrossSell", F.concat(F.lit("Add "), o, F.lit(" to get more from your plan")))
            .otherwise(F.concat(o, F.lit(" suits your usage"))))


def channel_limit(channel: Column) -> Column:
    return map_lookup(CHANNEL_LIMITS, channel)


def message(why: Column, variant: str = "A", brand: str = DEFAULT_BRAND) -> Column:
    """rule_message: core text, channel template, cut at the channel limit.
    Unknown channel -> NULL."""
    core = message_core(variant)
    dash = " — " if variant == "A" else " - "
    ch = c("channel")
    full = (F.when(ch == "SMS", F.concat(F.lit("Hi! "), core, F.lit(f". Reply YES. {brand}")))
            .when(ch == "Push", F.concat(core, F.lit(f"{dash}tap to activate.")))
            .when(ch == "WhatsApp", F.concat(F.lit("Hi! "), core, F.lit(f". Tap below to confirm. {brand}")))
            .when(ch == "Email", F.concat(F.lit("Dear Customer,\n\n"), why, F.lit("\n\n"), core,
                                          F.lit(f".\n\n{brand}")))
            .when(ch == "Call", F.concat(F.lit("AGENT: "), why, F.lit(" Recommend: "), core, F.lit("."))))
    return truncate(full, channel_limit(ch))


# ---------------------------------------------------------------------------
# grounding and adjudication of generated text
# ---------------------------------------------------------------------------

def allowed_numbers(variant: str = "A") -> Column:
    """The context numbers a generated text may cite (+-1), as array<bigint>."""
    def r(x):
        return round_half_even(x, 0).cast("bigint")

    def t(x):
        return x.cast("bigint")
    return F.array(t(c("overage")), t(c("days_renewal")), r(c("data_pct")), t(c("value_qar")),
                   r(c("data_used_gb")), t(c("data_cap_gb")), r(c("arpu")), t(c("voice_min")),
                   t(c("nps")), t(c("tenure_m")), r(c("dl_speed")), t(c("latency_ms")),
                   t(c("net_complaints")))


def ungrounded_numbers(text: Column, allowed: Column) -> Column:
    """Numbers (1-5 digit whole words) in ``text`` with no allowed value within 1."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(NUMBER_PATTERN), 0)

    def bad(n):
        v = F.try_cast(strip_zeros(arabic_digits_to_ascii(n)), "bigint") if hasattr(F, "try_cast") \
            else strip_zeros(arabic_digits_to_ascii(n)).try_cast("bigint")
        return v.isNull() | ~F.exists(allowed, lambda a: (a >= 0) & (F.abs(v - a) <= 1))
    return F.filter(raw, bad)


def first_ungrounded(rationale_col: Column, message_col: Column, variant: str = "A") -> Column:
    """The first number of rationale + ' ' + message that the context does not support; NULL if all are supported."""
    text = F.concat(F.coalesce(rationale_col, F.lit("")), F.lit(" "), F.coalesce(message_col, F.lit("")))
    return F.get(ungrounded_numbers(text, allowed_numbers(variant)), 0)


def grounding(rationale_col: Column, message_col: Column, variant: str = "A") -> Column:
    """rule_grounding: true when every number in rationale + ' ' + message is supported."""
    return first_ungrounded(rationale_col, message_col, variant).isNull()


def grounding_reason(first_bad: Column) -> Column:
    """Why a text is grounded or not, from ``first_ungrounded``."""
    return F.when(first_bad.isNull(), F.lit("ok")).otherwise(F.concat(F.lit("ungrounded number '"), first_bad, F.lit("'")))


RESPONSE_SCHEMA = "struct<rationale:string,message:string,grounded:boolean,used_fields:array<string>>"


def prompt(context_json: Column, variant: str = "A") -> Column:
    """rule_prompt: the user prompt = selected offer line + channel + reason + the context as JSON text.

    Offer values are whole amounts and print as such."""
    value = c("value_qar").cast("bigint").cast("string")
    # FIXED VALUES: the lines around the record.
    if variant == "A":
        head = F.concat(F.lit("SELECTED CAMPAIGN (do not change): "), c("action"), F.lit(" | type="),
                        c("action_type"), F.lit(" | value="), value, F.lit(" QAR\n"))
        ctx_line = "SUBSCRIBER CONTEXT (only use these facts):\n"
    else:
        head = F.concat(F.lit("SELECTED ACTION (do not change): "), c("action"), F.lit(" | type "),
                        c("action_type"), F.lit(" | value_qar "), value, F.lit("\n"))
        ctx_line = "CUSTOMER CONTEXT (only use these facts):\n"
    return F.concat(head, F.lit("CHANNEL: "), c("channel"), F.lit("\nNBO_REASON: "), c("nbo_reason"),
                    F.lit("\n\n" + ctx_line), context_json)


def adjudicate(response_col: Column, rule_why: Column, rule_how: Column, variant: str = "A",
               enabled: bool = True) -> Column:
    """rule_response_adjudicate -> struct<rationale, message, gen_source>.

    ``response_col`` is the raw model output (JSON text, NULL when no model ran).
    Accepted when it parses, is grounded, and both texts are non-empty after
    trim; the message is cut at the channel limit. Otherwise the rule texts.
    """
    tags = SOURCE_TAGS[variant]
    r = F.from_json(response_col, RESPONSE_SCHEMA)
    why = strip(F.coalesce(r["rationale"], F.lit("")))
    how = truncate(strip(F.coalesce(r["message"], F.lit(""))), channel_limit(c("channel")))
    ok = (response_col.isNotNull() & grounding(r["rationale"], r["message"], variant)
          & (F.coalesce(how, F.lit("")) != "") & (why != ""))
    if not enabled:
        return F.struct(rule_why.alias("rationale"), rule_how.alias("message"),
                        F.lit(tags["disabled"]).alias("gen_source"))
    return F.struct(F.when(ok, why).otherwise(rule_why).alias("rationale"),
                    F.when(ok, how).otherwise(rule_how).alias("message"),
                    F.when(ok, F.lit(tags["accepted"])).otherwise(F.lit(tags["rejected"])).alias("gen_source"))
