"""Properties of whole-table results (sf0.001) and of the model path.

Retrieval: hits <= k per customer, no hit crosses customers, kept + dropped =
history. Decisions: lift and probabilities within their bounds, messages
within the channel limit. Model: shape, range and seed stability (values are
not compared with any other library).
"""
from pyspark.sql import functions as F

import __spark_entry__ as E
from offerlens.constants import CHANNEL_LIMITS
from offerlens.operators import ml as ML
from offerlens.operators import retrieval as R
from offerlens.operators import rules
from offerlens.plans import decision as D
from offerlens.plans import retrieval as RP
from offerlens.plans.subscriber import build_subscribers
from offerlens.sources.tables import Tables

Q = E.queries()


def test_retrieval_bounds_and_scope(spark, sf_small):
    corp = RP.corpus(Tables(spark, sf_small))
    hits = Q["ret_exact_topk"](spark, sf_small)
    per = {r.customer_id: r.n for r in hits.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per and max(per.values()) <= 3
    owner = dict(corp.select("interaction_id", "customer_id").collect())
    assert all(owner[r.interaction_id] == r.customer_id for r in hits.collect())
    ranks = sorted((r.customer_id, r.rank) for r in hits.collect())
    for cid, n in per.items():
        assert [rk for c, rk in ranks if c == cid] == list(range(1, n + 1))


def test_explain_partitions_history(spark, sf_small):
    ex = Q["ret_explain"](spark, sf_small)
    n_corpus = RP.corpus(Tables(spark, sf_small)).count()
    kept = ex.where("kept").count()
    dropped = ex.where("NOT kept").count()
    assert kept + dropped == n_corpus == ex.count()
    assert kept == Q["ret_exact_topk"](spark, sf_small).count()


def test_scope_filter_has_no_crossing(spark, sf_small):
    r = Q["ext_scope_filter"](spark, sf_small).first()
    assert r.n_hits > 0 and r.n_crossing == 0


def test_lift_and_probability_bounds(spark, sf_small):
    lo, hi = Q["rule_lift"](spark, sf_small).agg(F.min("lift"), F.max("lift")).first()
    assert 1.0 <= lo <= hi <= 1.55
    p = Q["rule_treated_prob"](spark, sf_small).agg(F.min("p_baseline"), F.max("p_baseline"),
                                                   F.min("p_treated"), F.max("p_treated")).first()
    assert 0.0 <= p[0] <= p[1] <= 0.95 * 0.95 + 1e-12
    assert 0.0 <= p[2] <= p[3] <= 0.95


def test_messages_within_channel_limit(spark, sf_small):
    m = Q["rule_message"](spark, sf_small)
    for r in m.select("channel", F.length("message_how").alias("n")).collect():
        assert r.n is not None and r.n <= CHANNEL_LIMITS[r.channel]


def test_unknown_channel_gives_null_message(spark):
    df = spark.createDataFrame([("Fax", "Upsell", "200mins_Upsell", 0, 0.1, 0, "Neutral", 50.0, 20, 100, "X")],
                               "channel string, action_type string, action string, net_issue int, churn double, "
                               "upgrade_eligible int, sentiment string, data_pct double, data_cap_gb int, "
                               "days_renewal int, device string")
    assert df.select(rules.message(F.lit("why"), "A").alias("m")).first().m is None


def test_zero_baseline_revenue_gives_null_uplift(spark):
    detail = spark.createDataFrame([(0.0, 0.2, 0.0)], "p_baseline double, p_treated double, value_qar double")
    w = D.summary_wide(detail).first()
    assert w.revenue_baseline == 0.0 and w.revenue_uplift is None


def test_customer_without_history_keeps_full_dump(spark):
    subs = spark.createDataFrame([(1, "call about 1234567 bill"), (2, "no recent call-center contact")],
                                 "customer_id long, transcript string")
    hits = spark.createDataFrame([(1, 1, "first snippet", "2024-01-01", "app", 0.9)],
                                 "customer_id long, rank int, text string, date string, channel string, "
                                 "similarity double")
    out = {r.customer_id: r for r in R.retrieval_context(subs, hits).collect()}
    assert out[1].retrieval_mode == "vector_top1" and out[1].transcript == "first snippet"
    assert out[2].retrieval_mode == "full_dump" and out[2].retrieved_interactions == []


def test_model_shape_range_and_seed_stability(spark, sf_small):
    subs = build_subscribers(spark, sf_small)
    m1 = ML.fit_propensity(subs, max_iter=5)
    m2 = ML.fit_propensity(subs, max_iter=5)
    p1 = ML.score_pairs(m1, subs)
    n_subs = subs.count()
    assert p1.count() == 10 * n_subs
    lo, hi = p1.agg(F.min("score"), F.max("score")).first()
    assert 0.0 <= lo <= hi <= 1.0
    s1 = {(r.customer_id, r.offer): r.score for r in p1.collect()}
    s2 = {(r.customer_id, r.offer): r.score for r in ML.score_pairs(m2, subs).collect()}
    assert s1 == s2
    rec = ML.recommend_model(m1, subs)
    assert rec.count() == n_subs == rec.select("customer_id").distinct().count()
