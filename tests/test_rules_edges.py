"""Hand-written edge rows for the decision rules (expected values worked out by hand)."""
import math

import pytest
from pyspark.sql import functions as F

from offerlens.operators import rules
from offerlens.operators.ranking import dedup_keep_first, with_best_offer
from offerlens.plans.subscriber import network_issue

BASE = dict(customer_id=1, churn=0.3, data_pct=50.0, segment="HVC", lifecycle="Maturity", ltv="MED",
            upgrade_eligible=0, sentiment="Neutral", usage_trend="Stable", consent=1, net_issue=0,
            overage=0, days_renewal=200, loyalty="None", late_payments=0, action="200mins_Upsell",
            action_type="Upsell", value_qar=35.0, guard_status="APPROVED", complaint=0,
            transcript="t", data_cap_gb=20, device="Pixel 8", device_age=5, tenure_m=30,
            dropped_call_rate=0.01, coverage=0.9, latency_ms=40, dl_speed=50.0, net_complaints=0,
            channel="SMS", data_used_gb=10.0, arpu=80.0, voice_min=100, nps=7)


def rows(spark, *changes):
    out = []
    for i, ch in enumerate(changes):
        r = dict(BASE)
        r["customer_id"] = i
        r.update(ch)
        out.append(r)
    return spark.createDataFrame(out)


def col(df, expr, name="x"):
    return [r[name] for r in df.orderBy("customer_id").select(expr.alias(name)).collect()]


def test_guard_thresholds_and_priority(spark):
    df = rows(spark,
              dict(action_type="Retention", ltv="LOW", churn=0.59),
              dict(action_type="Retention", ltv="LOW", churn=0.6),
              dict(late_payments=1, value_qar=200.0),
              dict(late_payments=2, value_qar=150.0),
              dict(late_payments=2, value_qar=151.0),
              dict(net_issue=1, action_type="Upsell"),
              dict(consent=0, action_type="Retention", ltv="LOW", churn=0.9, late_payments=3,
                   value_qar=280.0, net_issue=1),
              dict(action_type="Retention", ltv="LOW", churn=0.9, late_payments=3, value_qar=280.0))
    assert col(df, rules.guard_full()) == ["APPROVED", "SOFTENED", "APPROVED", "APPROVED", "REVIEW_CREDIT",
                                           "NETWORK_HOLD", "BLOCKED_NO_CONSENT", "SOFTENED"]
    assert col(df, rules.guard_margin()) == ["APPROVED", "SOFTENED", "APPROVED", "APPROVED", "REVIEW_CREDIT",
                                             "APPROVED", "SOFTENED", "SOFTENED"]


def test_network_flag_each_condition(spark):
    df = spark.createDataFrame(
        [(0.12, 0.5, 100, 0, 20.0), (0.121, 0.5, 100, 0, 20.0), (0.0, 0.25, 100, 0, 20.0),
         (0.0, 0.24, 100, 0, 20.0), (0.0, 0.5, 160, 0, 20.0), (0.0, 0.5, 161, 0, 20.0),
         (0.0, 0.5, 100, 1, 20.0), (0.0, 0.5, 100, 0, 6.0), (0.0, 0.5, 100, 0, 5.9)],
        "d double, cov double, lat int, comp int, sp double")
    got = [r[0] for r in df.select(network_issue(F.col("d"), F.col("cov"), F.col("lat"), F.col("comp"),
                                                 F.col("sp"))).collect()]
    assert got == [0, 1, 0, 1, 0, 1, 1, 0, 1]


def test_lift_consent_cap_and_nan(spark):
    df = rows(spark,
              dict(consent=0, overage=2, days_renewal=10, sentiment="Negative", loyalty="Gold"),
              dict(overage=2, days_renewal=10, action="Device_Upgrade_iPhone", upgrade_eligible=1,
                   usage_trend="Rising", sentiment="Negative", loyalty="Gold"),
              dict())
    lift = col(df, rules.lift())
    assert lift[0] == 1.0
    assert lift[1] == 1.55
    assert lift[2] == pytest.approx(1.15)
    p = spark.createDataFrame([(0.5, 1.5), (float("nan"), 1.2), (None, 1.2), (0.9, 1.5)], "p double, l double")
    got = [r[0] for r in p.select(rules.treated_probability(F.col("p"), F.col("l"))).collect()]
    assert got[0] == 0.75 and math.isnan(got[1]) and got[2] is None and got[3] == 0.95


def test_propensity_strict_thresholds(spark):
    df = rows(spark, dict(churn=0.6), dict(churn=0.61), dict(data_pct=80.0), dict(data_pct=80.1))
    ret = col(df, rules.propensity(F.lit("10GB_Aggressive_HVC"), F.lit("Retention")))
    up = col(df, rules.propensity(F.lit("200mins_Upsell"), F.lit("Upsell")))
    assert ret[0] == pytest.approx(0.12) and ret[1] == pytest.approx(0.37)
    assert up[2] == pytest.approx(0.12) and up[3] == pytest.approx(0.30)


def test_argmax_ties_catalogue_and_alphabetical(spark):
    # all offers score the same -> A picks the first in catalogue order, B the first alphabetically
    df = rows(spark, dict())
    flat = lambda o, at: F.lit(0.5)
    a = with_best_offer(df, flat, "A").select("__best.offer").first()[0]
    b = with_best_offer(df, flat, "B").select("__best.offer").first()[0]
    assert a == "10GB_Aggressive_HVC"
    assert b == "10GB_Aggressive_HVC" == sorted(["10GB_Aggressive_HVC", "1GB_plus_100mins", "200mins_Upsell",
                                                 "5G_Unlimited_Upgrade"])[0]
    # only Upsell offers tie at the top: catalogue order -> 200mins_Upsell; alphabetical -> 200mins_Upsell
    up = lambda o, at: F.when(at == "Upsell", 0.9).otherwise(0.1)
    assert with_best_offer(df, up, "A").select("__best.offer").first()[0] == "200mins_Upsell"
    # NBO ties: catalogue 1GB_plus_100mins (index 1) vs alphabetical 1GB_plus_100mins < Data_AddOn_5GB
    cs = lambda o, at: F.when(at == "CrossSell", 0.9).otherwise(0.1)
    assert with_best_offer(df, cs, "A").select("__best.offer").first()[0] == "Home_Free_OoredooTV"
    assert with_best_offer(df, cs, "B").select("__best.offer").first()[0] == "Home_Free_OoredooTV"
    ret = lambda o, at: F.when(at == "Retention", 0.9).otherwise(0.1)
    assert with_best_offer(df, ret, "A").select("__best.offer").first()[0] == "10GB_Aggressive_HVC"
    assert with_best_offer(df, ret, "B").select("__best.offer").first()[0] == "10GB_Aggressive_HVC"
    nb = lambda o, at: F.when(o.isin("Retention_Save_25pct", "Loyalty_Points_2x"), 0.9).otherwise(0.1)
    assert with_best_offer(df, nb, "A").select("__best.offer").first()[0] == "Retention_Save_25pct"
    assert with_best_offer(df, nb, "B").select("__best.offer").first()[0] == "Loyalty_Points_2x"


def test_dedup_keeps_first_by_ordinal(spark):
    df = spark.createDataFrame([(1, 5, "late"), (1, 2, "early"), (2, 9, "only")], "k int, ord int, v string")
    got = {r.k: r.v for r in dedup_keep_first(df, "k", "ord").collect()}
    assert got == {1: "early", 2: "only"}
    rev = spark.createDataFrame([(1, 2, "early"), (1, 5, "late")], "k int, ord int, v string")
    assert dedup_keep_first(rev, "k", "ord").first().v == "early"


def test_half_even_display(spark):
    from offerlens.functions.core import fmt_fixed0, fmt_percent
    df = spark.createDataFrame([(80.5,), (81.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(fmt_fixed0(F.col("x"))).collect()] == ["80", "82", "2"]
    p = spark.createDataFrame([(0.045,), (0.125,)], "x double")
    assert [r[0] for r in p.select(fmt_percent(F.col("x"), 1)).collect()] == ["4.5%", "12.5%"]


def test_rationale_and_message_variants(spark):
    df = rows(spark, dict(), dict(net_issue=1, dropped_call_rate=0.16, sentiment="Negative", transcript="slow"),
              dict(action="10GB_Aggressive_HVC", action_type="Retention", days_renewal=30, channel="Push"),
              dict(channel="Fax"))
    why_a = col(df, rules.rationale("A"))
    assert why_a[0] == "Subscriber is an active HVC customer (tenure 30m)."
    assert why_a[1] == ('Subscriber is experiencing network issues (dropped-call rate 16%), '
                        'recently contacted care: "slow".')
    why_b = col(df, rules.rationale("B"))
    assert why_b[1] == ("Customer is experiencing network issues (high dropped-call rate (16%)), "
                        "recently contacted care (slow).")
    msg = col(df, rules.message(F.lit("WHY"), "A", brand="X"))
    assert msg[0] == "Hi! You're using 50% of your 20GB — 200mins Upsell gives you more headroom. Reply YES. X"
    assert msg[2] == ("Based on your usage, our 10GB Aggressive HVC keeps you covered, and your renewal is in "
                      "30 days — tap to activate.")[:120]
    assert msg[3] is None
    msg_b = col(df, rules.message(F.lit("WHY"), "B", brand="X"))
    assert msg_b[2].startswith("Based on your usage, our 10GB Aggressive HVC keeps you covered and your renewal")


def test_truncation_code_points(spark):
    from offerlens.functions.text import truncate
    s = "😀" * 161
    df = spark.createDataFrame([("a" * 159,), ("a" * 160,), ("a" * 161,), (s,)], "t string")
    got = [r[0] for r in df.select(truncate(F.col("t"), 160)).collect()]
    assert [len(x) for x in got[:3]] == [159, 160, 160]
    assert got[3] == "😀" * 160


def test_redaction(spark):
    from offerlens.functions.text import redact
    df = spark.createDataFrame([("12345",), ("123456",), ("call 12345678901 now",), ("a123456",),
                                ("_123456",), ("é123456",), ("١٢٣٤٥٦",), ("",)], "t string")
    got = [r[0] for r in df.select(redact(F.col("t"))).collect()]
    assert got == ["12345", "[REDACTED]", "call [REDACTED] now", "a123456", "_123456", "é123456",
                   "[REDACTED]", ""]


def test_grounding(spark):
    base = dict(overage=0, days_renewal=80, data_pct=40.0, value_qar=35.0, data_used_gb=8.0, data_cap_gb=20,
                arpu=80.0, voice_min=100, nps=7, tenure_m=30, dl_speed=50.0, latency_ms=40, net_complaints=0)
    df = rows(spark, base)
    cases = {"we saw 79 and 81": True, "007 days": True, "3.5 stars": False, "20GB plan": True,
             "your iPhone 14": False, "call 12345678": True, "٨٠ days": True, "plan 41 ok": True,
             "plan 43 ok": False}
    for text, ok in cases.items():
        got = df.select(rules.grounding(F.lit(""), F.lit(text))).first()[0]
        assert got is ok, text
    assert df.select(rules.grounding(F.lit(None).cast("string"), F.lit(None).cast("string"))).first()[0] is True
    reason = df.select(rules.grounding_reason(rules.first_ungrounded(F.lit(""), F.lit("a 500 b")))).first()[0]
    assert reason == "ungrounded number '500'"


def test_adjudicate_broken_json_falls_back(spark):
    df = rows(spark, dict())
    adj = rules.adjudicate(F.lit("{not json"), F.lit("why"), F.lit("how"), "B")
    r = df.select(adj.alias("a")).first().a
    assert (r.rationale, r.message, r.gen_source) == ("why", "how", "llm->fallback")
    ok = rules.adjudicate(F.lit('{"rationale": " r ", "message": " m "}'), F.lit("why"), F.lit("how"), "A")
    r = df.select(ok.alias("a")).first().a
    assert (r.rationale, r.message, r.gen_source) == ("r", "m", "claude")


def test_transcript_sentinel(spark):
    from offerlens.functions.text import is_blank_or_sentinel
    df = spark.createDataFrame([("",), ("   ",), ("No Recent Call-Center Contact",), ("asked about data",)],
                               "t string")
    assert [r[0] for r in df.select(is_blank_or_sentinel(F.col("t"))).collect()] == [True, True, True, False]
