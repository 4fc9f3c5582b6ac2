"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator id.

Every query reads the driver's tables (or data Spark derives from them) in
full; none runs on made-up input only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.constants import CHANNEL_LIMITS, EXTRAPOLATE_TO
from offerlens.functions.core import (
    clip, fmt_fixed0, fmt_money, fmt_percent, map_lookup, round_half_even,
    round_half_up as rhu, zero_pad,
)
from offerlens.functions.text import extract_numbers, is_blank_or_sentinel, redact, strip, strip_zeros, truncate
from offerlens.operators import rules
from offerlens.operators.ranking import (
    dedup_keep_first, expand_offers, head_n, paged_list, rank_offers,
)
from offerlens.plans import decision as D
from offerlens.plans.subscriber import SUBSCRIBER_COLUMNS, build_subscribers, lookup_subscribers
from offerlens.sources.tables import Tables, offers_df

c = F.col
QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _subs(spark, sf, variant="A"):
    return build_subscribers(spark, sf, variant)


def _decided(spark, sf, variant="A"):
    return D.decide(_subs(spark, sf, variant), variant)


# ---------------------------------------------------------------- features
@register("proj_select_cols")
def q_proj_select_cols(spark: SparkSession, sf: str) -> DataFrame:
    return _subs(spark, sf).select(*SUBSCRIBER_COLUMNS)


@register("feat_usage_pct")
def q_feat_usage_pct(spark, sf):
    return _subs(spark, sf).select("customer_id", "data_pct", "data_used_gb")


@register("feat_dunning")
def q_feat_dunning(spark, sf):
    return _subs(spark, sf).select("customer_id", "late_payments", "dunning")


@register("feat_upgrade_eligible")
def q_feat_upgrade_eligible(spark, sf):
    return _subs(spark, sf).select("customer_id", "device_age", "upgrade_eligible")


@register("feat_device_tier")
def q_feat_device_tier(spark, sf):
    a = _subs(spark, sf, "A").select("customer_id", "device", "device_type", c("device_tier").alias("tier_a"))
    return a.withColumn("tier_b", F.when(c("device_type").isin("Feature Phone", "IoT"), "Budget")
                        .otherwise(c("tier_a")))


@register("feat_net_capability")
def q_feat_net_capability(spark, sf):
    return _subs(spark, sf).select("customer_id", "device_tier", "device_type", "net_cap")


@register("feat_network_issue")
def q_feat_network_issue(spark, sf):
    return _subs(spark, sf).select("customer_id", "dropped_call_rate", "coverage", "latency_ms",
                                   "net_complaints", "dl_speed", "net_issue")


@register("flt_in_set")
def q_flt_in_set(spark, sf):
    return _subs(spark, sf).where(c("loyalty").isin("Gold", "Platinum")).select("customer_id", "loyalty")


@register("flt_contains")
def q_flt_contains(spark, sf):
    return _decided(spark, sf).where(c("action").contains("Device")).select("customer_id", "action")


@register("flt_key_lookup")
def q_flt_key_lookup(spark, sf, key: int | None = None):
    # without a key: the smallest one that has a contact transcript
    t = Tables(spark, sf)
    if key is None:
        users = t.conversations.where(c("role") == "user").select(c("conv_id").alias("c_custkey"))
        key = t.customer.join(users, "c_custkey", "left_semi").agg(F.min("c_custkey")).first()[0]
    d = D.decide(lookup_subscribers(t, [] if key is None else [key]), "A")
    return d.select("customer_id", "action", "segment", "channel")


@register("flt_blank_sentinel")
def q_flt_blank_sentinel(spark, sf):
    return (_subs(spark, sf).where(~is_blank_or_sentinel(c("transcript")))
            .select("customer_id", strip(c("transcript")).alias("transcript")))


# ---------------------------------------------------------------- recommendation
@register("join_cross_offers")
def q_join_cross_offers(spark, sf):
    return expand_offers(_subs(spark, sf).select("customer_id")).select(
        "customer_id", "offer_ord", "offer", "action_type", "price")


@register("proj_overwrite_candidate")
def q_proj_overwrite_candidate(spark, sf):
    s = _subs(spark, sf).select("customer_id", "shown_offer", "segment")
    e = expand_offers(s)
    return e.select("customer_id", "segment", c("offer").alias("product_id"),
                    c("action_type").alias("action_type"), c("price").alias("monthly_value"))


@register("rule_propensity")
def q_rule_propensity(spark, sf):
    e = expand_offers(_subs(spark, sf))
    return e.select("customer_id", "offer", "action_type",
                    rhu(rules.propensity(c("offer"), c("action_type")), 4).alias("propensity"))


@register("agg_argmax_offer")
def q_agg_argmax_offer(spark, sf):
    return D.recommend_rules(_subs(spark, sf), "A")


@register("agg_argmax_offer_b")
def q_agg_argmax_offer_b(spark, sf):
    return D.recommend_rules(_subs(spark, sf, "B"), "B")


@register("topk_offers_ranking")
def q_topk_offers_ranking(spark, sf):
    r = rank_offers(_subs(spark, sf), rules.propensity, "customer_id", "A")
    return r.select("customer_id", "offer_rank", "offer", "action_type", "price",
                    rhu(c("score"), 4).alias("score"))


@register("rule_heuristic_ranking")
def q_rule_heuristic_ranking(spark, sf):
    r = rank_offers(_subs(spark, sf), lambda o, at: rules.heuristic_score(at), "customer_id", "A")
    return r.select("customer_id", "offer_rank", "offer", rhu(c("score"), 4).alias("score"))


@register("join_offer_lookup")
def q_join_offer_lookup(spark, sf):
    s = _subs(spark, sf).select("customer_id", "shown_offer", "nbo_alt_action")
    o = offers_df(spark)
    j = s.join(o.select(c("offer").alias("shown_offer"), c("price").alias("shown_price")), "shown_offer", "inner")
    j = j.join(o.select(c("offer").alias("nbo_alt_action"), c("action_type").alias("alt_type")),
               "nbo_alt_action", "left")
    return j.select("customer_id", "shown_offer", "shown_price", "nbo_alt_action",
                    F.coalesce("alt_type", F.lit("")).alias("alt_type"))


@register("fn_map_lookup")
def q_fn_map_lookup(spark, sf):
    s = _subs(spark, sf).select("customer_id", "channel")
    return s.select("customer_id", "channel", map_lookup(CHANNEL_LIMITS, c("channel")).alias("channel_limit"))


@register("src_literal_dim")
def q_src_literal_dim(spark, sf):
    # catalogue x its use: how many subscribers were shown each offer
    s = _subs(spark, sf).groupBy("shown_offer").agg(F.count(F.lit(1)).alias("n_shown"))
    o = offers_df(spark)
    return o.join(s, o.offer == s.shown_offer, "left").select(
        "offer_ord", "offer", "action_type", "price", F.coalesce("n_shown", F.lit(0)).alias("n_shown"))


# ---------------------------------------------------------------- guard / lift / eval
@register("rule_guard_full")
def q_rule_guard_full(spark, sf):
    return _decided(spark, sf, "A").select("customer_id", "action", "guard_status")


@register("rule_guard_margin")
def q_rule_guard_margin(spark, sf):
    return _decided(spark, sf, "B").select("customer_id", "action", "guard_status")


@register("rule_lift")
def q_rule_lift(spark, sf):
    d = D.evaluation_detail(_decided(spark, sf))
    return d.select("customer_id", rhu(c("lift"), 6).alias("lift"))


@register("rule_treated_prob")
def q_rule_treated_prob(spark, sf):
    d = D.evaluation_detail(_decided(spark, sf))
    return d.select("customer_id", rhu(c("p_baseline"), 6).alias("p_baseline"), rhu(c("p_treated"), 6).alias("p_treated"))


@register("join_rec_subscriber")
def q_join_rec_subscriber(spark, sf):
    subs = _subs(spark, sf)
    rec = D.recommend_rules(subs, "A")
    return rec.join(subs.select("customer_id", "segment", "channel", "churn"), "customer_id", "inner")


@register("join_eval_three_way")
def q_join_eval_three_way(spark, sf):
    subs = _subs(spark, sf)
    rec = D.recommend_rules(subs, "A")
    guarded = D.experience(D.decide(subs, "A"), "A")
    m = D.join_evaluation(rec, subs, guarded)
    return m.select("customer_id", "msisdn", "action", "guard_status", rhu(c("p_baseline"), 6).alias("p_baseline"),
                    rhu(c("p_treated"), 6).alias("p_treated"))


def _wide(spark, sf, variant="A"):
    return D.summary_wide(D.evaluation_detail(_decided(spark, sf, variant)))


@register("agg_mean_rate")
def q_agg_mean_rate(spark, sf):
    w = _wide(spark, sf)
    return w.select(rhu(c("acceptance_baseline"), 6).alias("acceptance_baseline"),
                    rhu(c("acceptance_treated"), 6).alias("acceptance_treated"))


@register("agg_revenue_sum")
def q_agg_revenue_sum(spark, sf):
    w = _wide(spark, sf)
    return w.select(rhu(c("revenue_baseline"), 2).alias("revenue_baseline"),
                    rhu(c("revenue_treated"), 2).alias("revenue_treated"))


@register("agg_count")
def q_agg_count(spark, sf):
    d = D.evaluation_detail(_decided(spark, sf))
    return d.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@register("agg_uplift_ratio")
def q_agg_uplift_ratio(spark, sf):
    return _wide(spark, sf).select(rhu(c("revenue_uplift"), 6).alias("revenue_uplift"))


@register("agg_extrapolate")
def q_agg_extrapolate(spark, sf):
    w = _wide(spark, sf)
    return w.select("n", rhu(c("incremental_revenue"), 2).alias("incremental_revenue"),
                    *[rhu(c(f"extrapolated_{t}"), 0).alias(f"extrapolated_{t}") for t in EXTRAPOLATE_TO])


@register("agg_summary_long")
def q_agg_summary_long(spark, sf):
    return D.summary_long(_wide(spark, sf), "A")


@register("agg_summary_long_b")
def q_agg_summary_long_b(spark, sf):
    return D.summary_long(_wide(spark, sf, "B"), "B")


@register("pipe_run")
def q_pipe_run(spark, sf):
    w = _wide(spark, sf)
    return w.select("n", *[rhu(c(x), 6).alias(x) for x in
                           ["acceptance_baseline", "acceptance_treated", "revenue_uplift"]],
                    rhu(c("revenue_baseline"), 2).alias("revenue_baseline"),
                    rhu(c("revenue_treated"), 2).alias("revenue_treated"))


@register("fn_percent_money_fmt")
def q_fn_percent_money_fmt(spark, sf):
    d = D.evaluation_detail(_decided(spark, sf))
    return d.select("customer_id", fmt_percent(c("p_treated"), 1).alias("p_treated_pct"),
                    fmt_money(c("value_qar") * F.lit(1000.0)).alias("value_money"),
                    fmt_fixed0(c("data_pct")).alias("data_pct_0f"))


@register("fn_round")
def q_fn_round(spark, sf):
    s = _subs(spark, sf)
    return s.select("customer_id", round_half_even(c("data_pct"), 0).alias("data_pct_even"),
                    round_half_even(c("arpu"), 0).alias("arpu_even"),
                    rhu(c("data_used_gb"), 0).alias("used_half_up"))


@register("fn_clip")
def q_fn_clip(spark, sf):
    e = expand_offers(_subs(spark, sf))
    raw = rules.propensity(c("offer"), c("action_type"))
    return e.select("customer_id", "offer", rhu(clip(raw * F.lit(3.0), 0.0, 0.95), 6).alias("clipped"))


@register("lim_head_n")
def q_lim_head_n(spark, sf):
    return head_n(_decided(spark, sf).select("customer_id", "action", "propensity"), [c("customer_id")], 20)


@register("agg_dedup_keep_first")
def q_agg_dedup_keep_first(spark, sf):
    o = Tables(spark, sf).orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return dedup_keep_first(o, "o_custkey", "o_orderkey")


@register("agg_group_first")
def q_agg_group_first(spark, sf):
    # first shown price / type per offer by input order (customer key)
    s = _subs(spark, sf).select("shown_offer", "customer_id", "shown_value", "shown_action_type")
    return (s.groupBy("shown_offer")
            .agg(F.min_by("shown_value", "customer_id").alias("first_price"),
                 F.min_by("shown_action_type", "customer_id").alias("first_type")))


@register("agg_distinct_sorted")
def q_agg_distinct_sorted(spark, sf):
    d = _decided(spark, sf)
    return d.select(F.array_join(F.array_sort(F.collect_set("action")), ",").alias("offers"))


@register("sort_by_key")
def q_sort_by_key(spark, sf):
    # the whole table, range-partitioned and sorted (no row cap)
    d = _decided(spark, sf).select("customer_id", "propensity")
    return d.orderBy(c("propensity").asc(), c("customer_id").asc())


# ---------------------------------------------------------------- texts
@register("rule_rationale")
def q_rule_rationale(spark, sf):
    x = D.experience(_decided(spark, sf, "A"), "A")
    return x.select("msisdn", "rationale_why")


@register("rule_rationale_b")
def q_rule_rationale_b(spark, sf):
    x = D.experience(_decided(spark, sf, "B"), "B")
    return x.select("msisdn", "rationale_why")


@register("rule_message")
def q_rule_message(spark, sf):
    x = D.experience(_decided(spark, sf, "A"), "A")
    return x.select("msisdn", "channel", "message_how")


@register("rule_message_b")
def q_rule_message_b(spark, sf):
    x = D.experience(_decided(spark, sf, "B"), "B")
    return x.select("msisdn", "channel", "message_how")


@register("proj_rename")
def q_proj_rename(spark, sf):
    return D.experience(_decided(spark, sf, "A"), "A")


@register("fn_redact")
def q_fn_redact(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", redact(c("text")).alias("text"))


@register("fn_extract_numbers")
def q_fn_extract_numbers(spark, sf):
    d = Tables(spark, sf).documents
    n = extract_numbers(c("text"))
    return d.select("doc_id", F.size(n).alias("n_numbers"), F.array_join(n, ",").alias("numbers"))


@register("fn_strip_zeros")
def q_fn_strip_zeros(spark, sf):
    d = Tables(spark, sf).documents
    n = F.transform(extract_numbers(c("text")), strip_zeros)
    return d.select("doc_id", F.array_join(n, ",").alias("numbers"))


@register("fn_text_len")
def q_fn_text_len(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", F.length("text").alias("n_chars"), (F.length("text") == c("n_chars")).alias("same"))


@register("fn_truncate")
def q_fn_truncate(spark, sf):
    s = _subs(spark, sf).select("customer_id", "channel", "transcript")
    return s.select("customer_id", truncate(c("transcript"), map_lookup(CHANNEL_LIMITS, c("channel"))).alias("cut"))


@register("fn_str_clean")
def q_fn_str_clean(spark, sf):
    d = _decided(spark, sf)
    return d.select("customer_id", F.lower(F.trim(F.replace(c("action"), F.lit("_"), F.lit(" ")))).alias("clean"),
                    F.concat_ws("|", F.split(c("device"), " ")).alias("parts"))


@register("fn_default")
def q_fn_default(spark, sf):
    s = _subs(spark, sf)
    cv = Tables(spark, sf).conversations.where(c("role") == "assistant").groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("reply"))
    j = s.select("customer_id").join(cv, s.customer_id == cv.conv_id, "left")
    return j.select("customer_id", F.coalesce(c("reply"), F.lit("")).alias("reply"),
                    F.coalesce(F.nullif(F.length("reply").cast("string"), F.lit("0")), F.lit("-")).alias("shown"))


@register("fn_zero_pad")
def q_fn_zero_pad(spark, sf):
    cv = Tables(spark, sf).conversations
    return cv.select("conv_id", "turn", F.concat(c("conv_id").cast("string"), F.lit("-"),
                                                  zero_pad(c("turn"), 2)).alias("interaction_id"))


@register("fn_from_json")
def q_fn_from_json(spark, sf):
    e = Tables(spark, sf).events
    p = F.from_json("props", "struct<k:bigint>")
    return e.select("event_id", p["k"].alias("k"))


@register("fn_date_sub_fmt")
def q_fn_date_sub_fmt(spark, sf):
    cv = Tables(spark, sf).conversations
    ref = F.to_date(F.lit("2024-01-31"))
    return cv.select("conv_id", "turn", F.date_format(F.date_sub(ref, (c("turn") * 7).cast("int")),
                                                      "yyyy-MM-dd").alias("date"))


@register("fn_stable_hash")
def q_fn_stable_hash(spark, sf):
    cv = Tables(spark, sf).conversations
    return cv.select("conv_id", "turn", F.md5(F.concat_ws("|", c("conv_id").cast("string"), F.lit("history"),
                                                           c("turn").cast("string"))).alias("h"))


# ---------------------------------------------------------------- retrieval
from offerlens.constants import BASELINE_KEYWORDS, OVERLAP_STOPWORDS, PROBE_TEXT  # noqa: E402
from offerlens.functions.vectors import l2_norm, normalize  # noqa: E402
from offerlens.operators import retrieval as R  # noqa: E402
from offerlens.plans import retrieval as RP  # noqa: E402

HIT_COLS = ["customer_id", "rank", "interaction_id", "channel", "date", "similarity", "distance"]


def _hits(spark, sf, k=3):
    return RP.anchor_hits(Tables(spark, sf), k)


@register("src_corpus_load")
def q_src_corpus_load(spark, sf):
    corp = RP.corpus(Tables(spark, sf), text=True, whole=True)
    return RP.not_empty(corp.select("interaction_id", "customer_id", "channel", "date", "is_relevant", "embedding", "text"), "interactions")


@register("fn_vec_norm")
def q_fn_vec_norm(spark, sf):
    e = Tables(spark, sf).embeddings
    n = normalize(c("embedding"))
    return e.select("vec_id", rhu(l2_norm(c("embedding")), 6).alias("norm"),
                    rhu(l2_norm(n), 6).alias("unit_norm"), rhu(F.get(n, 0), 6).alias("x0"))


@register("fn_cosine")
def q_fn_cosine(spark, sf):
    t = Tables(spark, sf)
    s = R.score(RP.corpus(t), RP.anchor_query(t))
    return s.select("interaction_id", rhu(c("sim"), 6).alias("sim"))


@register("ret_exact_topk")
def q_ret_exact_topk(spark, sf):
    _, hits = _hits(spark, sf)
    return hits.select(*HIT_COLS)


@register("win_topk_per_customer")
def q_win_topk_per_customer(spark, sf):
    _, hits = _hits(spark, sf, 5)
    return hits.select("customer_id", "rank", "interaction_id")


@register("join_customer_scope")
def q_join_customer_scope(spark, sf):
    # per-customer query = that customer's own first interaction, joined bucket by bucket
    return R.exact_topk(RP.scoped_scores(*_persisted(spark, sf)), 3).select(*HIT_COLS)


def _persisted(spark, sf):
    path = stage_path(spark, f"scoped-{hashlib.md5(sf.encode()).hexdigest()[:8]}", unique=False)
    return RP.persist_scoped(RP.corpus(Tables(spark, sf), whole=True), path)


@register("ret_explain")
def q_ret_explain(spark, sf):
    corp, hits = _hits(spark, sf)
    return R.explain(corp, hits).select("interaction_id", "customer_id", "kept", "rank")


@register("join_anti_not_retrieved")
def q_join_anti_not_retrieved(spark, sf):
    corp, hits = _hits(spark, sf)
    return corp.join(hits.select("interaction_id"), "interaction_id", "left_anti").select(
        "customer_id", "interaction_id", "channel", "date")


@register("join_semi_kept")
def q_join_semi_kept(spark, sf):
    corp, hits = _hits(spark, sf)
    return corp.join(hits.select("interaction_id"), "interaction_id", "left_semi").select(
        "customer_id", "interaction_id", "is_relevant")


@register("set_difference")
def q_set_difference(spark, sf):
    corp, hits = _hits(spark, sf)
    ex = R.explain(corp, hits)
    return ex.groupBy("customer_id").agg(F.count_if(c("kept")).alias("n_kept"),
                                         F.count_if(~c("kept")).alias("n_dropped"))


@register("join_truth_labels")
def q_join_truth_labels(spark, sf):
    corp, hits = _hits(spark, sf)
    return R.hits_with_truth(hits.drop("is_relevant"), corp).select("customer_id", "rank", "interaction_id",
                                                                      "is_relevant")


@register("agg_precision_recall")
def q_agg_precision_recall(spark, sf):
    corp, hits = _hits(spark, sf)
    pr = R.precision_recall(corp, hits)
    return pr.select("customer_id", "n_relevant", "n_retrieved", "n_hits",
                     rhu(c("precision"), 6).alias("precision"), rhu(c("recall"), 6).alias("recall"))


@register("agg_random_baseline")
def q_agg_random_baseline(spark, sf):
    corp = RP.corpus(Tables(spark, sf))
    return corp.agg(rhu(R.random_baseline(corp), 6).alias("random_baseline"), F.count(F.lit(1)).alias("n"))


@register("agg_misses_fps")
def q_agg_misses_fps(spark, sf):
    corp, hits = _hits(spark, sf)
    misses, fps = R.misses_and_false_positives(corp, hits)
    t = Tables(spark, sf)
    m = misses.agg(F.count(F.lit(1)).alias("n_missed"), F.min("interaction_id").alias("interaction_id"))
    # the text of the first miss only: one row meets the documents
    m = RP.with_text(t, m).select("n_missed", c("interaction_id").alias("first_missed_id"), c("text").alias("first_missed_text"))
    f = fps.agg(F.count(F.lit(1)).alias("n_false_positives"),
                F.max(F.struct(c("sim"), (-c("interaction_id")).alias("n"), c("interaction_id").alias("id")))
                .alias("b"))
    return m.crossJoin(f).select("n_missed", "first_missed_id", "first_missed_text", "n_false_positives",
                                 rhu(c("b.sim"), 4).alias("top_fp_similarity"), c("b.id").alias("top_fp_id"))


@register("agg_payload_reduction")
def q_agg_payload_reduction(spark, sf):
    t = Tables(spark, sf)
    _, hits = RP.anchor_hits(t)
    pr = R.payload_reduction(RP.corpus(t, text=True), RP.with_text(t, hits))
    return pr.select("customer_id", "full_chars", "retrieved_chars", rhu(c("reduction"), 6).alias("reduction"))


@register("ret_evaluate")
def q_ret_evaluate(spark, sf):
    t = Tables(spark, sf)
    _, hits = RP.anchor_hits(t)
    one = R.evaluate(RP.corpus(t, text=True), hits)
    return one.select(rhu(c("precision"), 6).alias("precision_at_k"), rhu(c("recall"), 6).alias("recall_at_k"),
                      rhu(c("random_baseline"), 6).alias("random_baseline"), "n_missed", "n_false_positives",
                      rhu(c("payload_reduction"), 6).alias("payload_reduction"))


@register("agg_count_if")
def q_agg_count_if(spark, sf):
    corp = RP.corpus(Tables(spark, sf))
    return corp.groupBy("customer_id").agg(F.count_if(c("is_relevant")).alias("n_relevant"),
                                           F.count_if(~c("is_relevant")).alias("n_noise"))


@register("agg_count_distinct")
def q_agg_count_distinct(spark, sf):
    corp = RP.corpus(Tables(spark, sf))
    return corp.agg(F.count_distinct("customer_id").alias("n_customers"), F.count(F.lit(1)).alias("n_rows"))


#: Interactions, and characters of text, in one page of a customer's history.
PAGE_ITEMS, PAGE_CHARS = 100, 50_000


@register("agg_collect_history")
def q_agg_collect_history(spark, sf):
    # every customer's whole history, in pages: a customer with a third of all rows is many rows
    pages = paged_list(RP.corpus(Tables(spark, sf)), "customer_id", ["interaction_id"], c("interaction_id").cast("string"), ",", PAGE_ITEMS)
    return pages.select("customer_id", "page", "n_items", c("items").alias("interaction_ids"))


@register("agg_concat_text")
def q_agg_concat_text(spark, sf):
    corp = RP.corpus(Tables(spark, sf), text=True).select("customer_id", "interaction_id", "text")
    pages = paged_list(corp, "customer_id", ["interaction_id"], c("text"), " ", PAGE_CHARS, F.length("text") + 1)
    return pages.select("customer_id", "page", "n_items", c("items").alias("payload"), F.length("items").alias("n_chars"))


@register("fn_list_slice")
def q_fn_list_slice(spark, sf):
    _, hits = _hits(spark, sf)
    g = hits.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("rank", "interaction_id"))).alias("l"))
    s = F.slice("l", 1, 2)
    return g.select("customer_id", F.array_join(F.transform(s, lambda e: e["interaction_id"].cast("string")), ",")
                    .alias("top2"))


@register("ret_keyword_baseline")
def q_ret_keyword_baseline(spark, sf):
    return R.keyword_baseline(RP.corpus(Tables(spark, sf), text=True), BASELINE_KEYWORDS)


@register("flt_like_ci")
def q_flt_like_ci(spark, sf):
    corp = RP.corpus(Tables(spark, sf), text=True)
    return corp.where(F.lower(c("text")).contains("the")).select("interaction_id", "customer_id")


def _probe_hits(spark, sf):
    # a second query, k = 2, over every customer
    t = Tables(spark, sf)
    return R.exact_topk(R.score(RP.corpus(t), RP.probe_query(t)), 2)


@register("ret_multi_customer_probe")
def q_ret_multi_customer_probe(spark, sf):
    return _probe_hits(spark, sf).select("customer_id", "rank", "interaction_id", "similarity")


@register("win_dedup_best_by_text")
def q_win_dedup_best_by_text(spark, sf):
    top = R.dedup_best_by_text(RP.with_text(Tables(spark, sf), _probe_hits(spark, sf)), 5)
    return top.select("interaction_id", "customer_id", rhu(c("sim"), 4).alias("similarity"),
                      F.length("text").alias("n_chars"))


@register("topk_global")
def q_topk_global(spark, sf):
    t = Tables(spark, sf)
    s = R.score(RP.corpus(t), RP.probe_query(t))
    return s.orderBy(c("sim").desc(), c("interaction_id")).limit(5).select(
        "interaction_id", rhu(c("sim"), 4).alias("similarity"))


@register("set_token_overlap")
def q_set_token_overlap(spark, sf):
    top = R.dedup_best_by_text(RP.with_text(Tables(spark, sf), _probe_hits(spark, sf)), 5)
    ov = R.overlap_words(PROBE_TEXT, c("text"), OVERLAP_STOPWORDS)
    return top.select("interaction_id", F.array_join(ov, ",").alias("shared_words"))


@register("rule_retrieval_mode")
def q_rule_retrieval_mode(spark, sf):
    t = Tables(spark, sf)
    _, hits = RP.anchor_hits(t)
    subs = build_subscribers(spark, sf).select("customer_id", "transcript")
    ctx = R.retrieval_context(subs, RP.with_text(t, hits))
    return ctx.select("customer_id", "retrieval_mode", "transcript",
                      F.size("retrieved_interactions").alias("n_retrieved"))


# ---------------------------------------------------------------- histories, context, generation
from offerlens.functions.text import NUMBER_PATTERN  # noqa: E402,F401
from offerlens.plans import interactions as IP  # noqa: E402


@register("win_seq_number")
def q_win_seq_number(spark, sf):
    return IP.sequenced(Tables(spark, sf).conversations).select("conv_id", "turn", "seq", "interaction_id")


@register("win_stable_sample")
def q_win_stable_sample(spark, sf):
    return IP.stable_sample(Tables(spark, sf).conversations)


@register("set_union_corpora")
def q_set_union_corpora(spark, sf):
    u = IP.union_corpora(Tables(spark, sf).conversations, build_subscribers(spark, sf))
    return u.select("interaction_id", "customer_id", "date", "is_current", "channel", "topic", "is_relevant",
                    F.length("text").alias("n_chars"))


@register("proj_context_struct")
def q_proj_context_struct(spark, sf):
    d = _decided(spark, sf, "B")
    return d.select("customer_id", D.context_struct("B").alias("ctx")).select("customer_id", "ctx.*")


@register("proj_group_by_source")
def q_proj_group_by_source(spark, sf):
    # every field of every group, named by both
    d = _decided(spark, sf, "A").select("customer_id", D.source_groups().alias("g"))
    return d.select("customer_id", *[c(f"g.{g}.{f}").alias(f"{g}_{f}") for g, fields in D.SOURCE_GROUPS.items() for f in fields])


@register("fn_to_json")
def q_fn_to_json(spark, sf):
    d = _decided(spark, sf, "A")
    return d.select("customer_id", F.to_json(D.context_struct("A"), {"ignoreNullFields": "false"}).alias("context_json"))


@register("fn_to_json_indented")
def q_fn_to_json_indented(spark, sf, variant="A"):
    d = _decided(spark, sf, variant)
    return d.select("customer_id", D.context_json(d, variant).alias("context_json"))


@register("fn_to_json_indented_b")
def q_fn_to_json_indented_b(spark, sf):
    return q_fn_to_json_indented(spark, sf, "B")


@register("rule_prompt")
def q_rule_prompt(spark, sf, variant="A"):
    d = _decided(spark, sf, variant)
    return d.select("customer_id", rules.prompt(D.context_json(d, variant), variant).alias("prompt"))


@register("rule_prompt_b")
def q_rule_prompt_b(spark, sf):
    return q_rule_prompt(spark, sf, "B")


def _canned(spark, sf, variant="A"):
    """Decided rows plus a canned model response built from the data:
    rationale = the rule rationale, message = the subscriber's own transcript."""
    d = _decided(spark, sf, variant).withColumn("transcript", redact(c("transcript")))
    d = d.withColumn("__why", rules.rationale(variant))
    resp = F.to_json(F.struct(c("__why").alias("rationale"), c("transcript").alias("message"),
                              F.lit(True).alias("grounded")))
    return d.withColumn("response", resp)


@register("rule_grounding")
def q_rule_grounding(spark, sf, variant="A"):
    d = _canned(spark, sf, variant)
    r = F.from_json("response", rules.RESPONSE_SCHEMA)
    # emitted by a one-row Generate, so that the numbers are extracted once for both columns
    bad = F.inline(F.array(F.struct(rules.first_ungrounded(r["rationale"], r["message"], variant).alias("bad"))))
    return d.select("customer_id", bad).select("customer_id", c("bad").isNull().alias("grounded"), rules.grounding_reason(c("bad")).alias("reason"))


@register("rule_grounding_b")
def q_rule_grounding_b(spark, sf):
    return q_rule_grounding(spark, sf, "B")


@register("rule_response_adjudicate")
def q_rule_response_adjudicate(spark, sf, variant="A"):
    d = _canned(spark, sf, variant)
    d = d.withColumn("__how", rules.message(c("__why"), variant))
    d = d.withColumn("__adj", rules.adjudicate(c("response"), c("__why"), c("__how"), variant, enabled=True))
    return d.select("customer_id", c("__adj.rationale").alias("rationale"), c("__adj.message").alias("message"),
                    c("__adj.gen_source").alias("gen_source"))


@register("rule_response_adjudicate_b")
def q_rule_response_adjudicate_b(spark, sf):
    return q_rule_response_adjudicate(spark, sf, "B")


# ---------------------------------------------------------------- model, embedding, ANN, generation
from offerlens.constants import QUERY_TEXT  # noqa: E402
from offerlens.operators import generation as GEN  # noqa: E402
from offerlens.operators import inverted as INV  # noqa: E402
from offerlens.operators import ml as ML  # noqa: E402

_MODELS: dict = {}


def _scored_subs(spark, sf):
    """The subscribers' model inputs, staged once for each version of the tables, in at least as many files as cores."""
    path = stage_path(spark, f"model-inputs-{hashlib.md5(sf.encode()).hexdigest()[:8]}", unique=False)
    columns = ["customer_id", *ML.CAT_FEATS, *ML.NUM_FEATS, ML.LABEL]
    parts = spark.sparkContext.defaultParallelism
    return ST.resume_or_compute(spark, path, lambda: _subs(spark, sf).select(*columns).repartition(parts, "customer_id"))


def _model(spark, sf, max_iter=100):
    """The propensity model, fitted once per (application, input files and features, rounds)."""
    subs = _scored_subs(spark, sf)
    key = (spark.sparkContext.applicationId, ST.stage_key(subs), max_iter)
    if key not in _MODELS:
        _MODELS[key] = ML.fit_propensity(subs, max_iter=max_iter)
    return _MODELS[key]


@register("ml_onehot")
def q_ml_onehot(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    s = _subs(spark, sf)
    m = Pipeline(stages=ML.feature_stages()).fit(s)
    arr = vector_to_array(c("features"))
    return m.transform(s).select("customer_id", F.size(arr).alias("n_features"),
                                 F.size(F.filter(arr, lambda x: x != 0)).alias("n_nonzero"))


@register("ml_gbt_fit")
def q_ml_gbt_fit(spark, sf):
    gbt = _model(spark, sf).stages[-1]
    rows = [(i, float(w), int(t.numNodes)) for i, (w, t) in enumerate(zip(gbt.treeWeights, gbt.trees))]
    return spark.createDataFrame(rows, "tree int, weight double, num_nodes int")


@register("ml_score_pairs")
def q_ml_score_pairs(spark, sf):
    return ML.score_pairs(_model(spark, sf), _scored_subs(spark, sf))


@register("ml_recommend")
def q_ml_recommend(spark, sf):
    return ML.recommend_model(_model(spark, sf), _scored_subs(spark, sf))


def _embedded_histories(spark, sf, trained=True):
    """(subscribers, embedded corpus, query vector): the corpus is embedded once for each version of the tables.

    The stage holds the corpus with its vectors and the query embedded by the same model."""
    t = Tables(spark, sf)
    subs = build_subscribers(spark, sf)
    kind = "trained" if trained else "hashed"
    path = stage_path(spark, f"histories-{kind}-{hashlib.md5(sf.encode()).hexdigest()[:8]}", unique=False)
    # the corpus numbers its rows over a checkpoint, so its key is made of what it is built from
    key = ST.stage_key(t.conversations, f"{kind} 3 {ST.stage_key(subs)} {QUERY_TEXT}")

    def write(folder):
        corp = IP.union_corpora(t.conversations, subs)
        model = ML.fit_trained(corp) if trained else ML.hashing_embedder("text", 64).fit(corp)
        ML.embed(model, corp).write.parquet(f"{folder}/corpus")
        ML.embed(model, spark.createDataFrame([(QUERY_TEXT,)], "text string")).write.parquet(f"{folder}/query")

    folder = ST.resume(spark, path, key, write)
    corp = spark.read.schema(_EMBEDDED).parquet(f"{folder}/corpus")
    q = spark.read.schema("text string, embedding array<float>").parquet(f"{folder}/query")
    return subs, corp, q.select(normalize(c("embedding")).alias("q")).scalar()


_EMBEDDED = ("interaction_id string, customer_id long, date string, is_current boolean, channel string, text string, topic string, "
             "is_relevant boolean, embedding array<float>")


def q_emb_precision(spark, sf):
    """Precision at 3 of the trained and of the hashed vectors for the same query, over all customers."""
    out = None
    for name, trained in (("trained", True), ("hashed", False)):
        _, emb, qv = _embedded_histories(spark, sf, trained)
        hits = R.exact_topk(R.score(emb, qv), 3)
        one = R.precision_recall(emb, hits).agg(F.lit(name).alias("vectors"), F.count(F.lit(1)).alias("n_customers"),
                                                rhu(F.avg("precision"), 6).alias("precision_at_3"))
        out = one if out is None else out.unionByName(one)
    return out


@register("emb_precision_check")
def q_emb_precision_check(spark, sf):
    # both kinds rank every customer with a history
    p = q_emb_precision(spark, sf)
    return p.agg(F.max("n_customers").alias("n_customers"), (F.min("n_customers") == F.max("n_customers")).alias("same_customers"),
                 ((F.count(F.lit(1)) == 2) & (F.min("precision_at_3") >= 0) & (F.max("precision_at_3") <= 1)).alias("in_range"))


@register("emb_embed_batch")
def q_emb_embed_batch(spark, sf):
    _, emb, _ = _embedded_histories(spark, sf)
    return emb.select("interaction_id", "customer_id", F.size("embedding").alias("dim"), "embedding")


@register("ret_bulk_context")
def q_ret_bulk_context(spark, sf):
    subs, emb, qv = _embedded_histories(spark, sf)
    hits = R.exact_topk(R.score(emb, qv), 3)
    ctx = R.retrieval_context(subs, hits)
    return ctx.select("customer_id", "retrieval_mode", F.size("retrieved_interactions").alias("n_retrieved"),
                      "transcript")


@register("ret_ann_topk")
def q_ret_ann_topk(spark, sf):
    t = Tables(spark, sf)
    return INV.search(_index(spark, sf), RP.anchor_query(t), 3).select(*HIT_COLS)


def _index(spark, sf):
    """The inverted lists of the corpus, built once for each version of it."""
    path = stage_path(spark, f"inverted-{hashlib.md5(sf.encode()).hexdigest()[:8]}", unique=False)
    return INV.index_of(RP.corpus(Tables(spark, sf)).select("interaction_id", "customer_id", "channel", "date", "embedding"), path)


# ---- what can be said of model outputs without naming their values
@register("ml_gbt_fit_check")
def q_ml_gbt_fit_check(spark, sf):
    # the fit beats a constant predictor on its rows, and a walk over its node table gives the same score for every pair
    model, subs = _model(spark, sf), _scored_subs(spark, sf)
    trees = q_ml_gbt_fit(spark, sf).agg((F.count(F.lit(1)) > 0).alias("fitted"), F.count(F.lit(1)).cast("int").alias("n_trees"))
    rate = subs.agg(F.avg(c(ML.LABEL).cast("double")).alias("p")).select("p").scalar()
    fitted = model.transform(subs)
    loss = fitted.select(ML.positive_probability(fitted).alias("p"), c(ML.LABEL).alias("y"), rate.alias("q")).agg(
        (ML.log_loss(c("p"), c("y")) < ML.log_loss(c("q"), c("y"))).alias("beats_constant"))
    pairs = ML.score_pairs(model, subs, ML.node_table(model))
    walked = pairs.agg((F.max(F.abs(c("score") - c("walked"))) < 1e-9).alias("walk_equals"))
    return trees.crossJoin(loss).crossJoin(walked)


def q_ml_gbt_nodes(spark, sf):
    return ML.node_table(_model(spark, sf))


@register("ml_gbt_nodes_check")
def q_ml_gbt_nodes_check(spark, sf):
    # every tree is one tree: a root, two children for each split, no other nodes
    nodes = q_ml_gbt_nodes(spark, sf)
    per = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("feature") >= 0).alias("splits"), F.min("node").alias("root"))
    return per.select("tree", (c("n") == 2 * c("splits") + 1).alias("binary"), (c("root") == 0).alias("rooted"))


@register("ml_score_pairs_check")
def q_ml_score_pairs_check(spark, sf):
    pairs = q_ml_score_pairs(spark, sf)
    return pairs.groupBy("customer_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_offers"), F.count_if(c("score").between(0.0, 1.0)).cast("int").alias("n_in_range"),
        F.sum("offer_ord").cast("int").alias("sum_offer_ord"))


@register("ml_recommend_check")
def q_ml_recommend_check(spark, sf):
    # the recommendation is the best score, and of equal scores the first offer
    best = q_ml_score_pairs(spark, sf).groupBy("customer_id").agg(
        F.max(F.struct("score", (-c("offer_ord")).alias("o"), "offer")).alias("b"))
    rec = q_ml_recommend(spark, sf).select("customer_id", "action", "propensity")
    return rec.join(best, "customer_id").select(
        "customer_id", (F.abs(c("propensity") - c("b.score")) <= 5.1e-5).alias("is_best"), (c("action") == c("b.offer")).alias("is_first"))


@register("emb_embed_check")
def q_emb_embed_check(spark, sf):
    norm = l2_norm(c("embedding"))
    sound = (c("dim") == 64) & ((F.abs(norm - 1.0) < 1e-4) | (norm == 0))
    return q_emb_embed_batch(spark, sf).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(sound).alias("n_sound"))


@register("ret_bulk_context_check")
def q_ret_bulk_context_check(spark, sf):
    return q_ret_bulk_context(spark, sf).select("customer_id", "retrieval_mode", "n_retrieved")


@register("ret_ann_check")
def q_ret_ann_check(spark, sf):
    # every customer with k rows gets k; over all customers at least 0.9 of the exact hits are found
    ann = q_ret_ann_topk(spark, sf).select("customer_id", "interaction_id", F.lit(1).alias("found"))
    exact = q_ret_exact_topk(spark, sf).select("customer_id", "interaction_id")
    recall = (exact.join(ann, ["customer_id", "interaction_id"], "left")
              .agg((F.avg(F.coalesce(c("found"), F.lit(0))) >= 0.9).alias("r")).scalar())
    return ann.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_hits")).withColumn("recall_ok", recall)


def _canned_responder():
    """Deterministic stand-in for a hosted model: answers with the offer line of
    the prompt; every third answer cites an invented number (must be rejected)."""
    import json

    def answer(prompts):
        out = []
        for i, p in enumerate(prompts):
            first = p.split("\n", 1)[0]
            offer = first.split(": ", 1)[-1].split(" | ", 1)[0]
            msg = f"{offer.replace('_', ' ')} is ready for you"
            if len(p) % 3 == 0:
                msg += " with 99999 bonus minutes"
            out.append(json.dumps({"rationale": f"Selected: {offer}.", "message": msg, "grounded": True,
                                   "used_fields": ["action"]}))
        return out
    return answer


@register("gen_batch_complete")
def q_gen_batch_complete(spark, sf):
    d = _decided(spark, sf, "A").withColumn("transcript", redact(c("transcript")))
    d = d.withColumn("prompt", rules.prompt(D.context_json(d, "A"), "A"))
    # one response table for all runs: a prompt that was answered is not sent again
    g = GEN.complete(d, "prompt", _canned_responder, stage_path(spark, "responses", unique=False), limits=GEN.Limits(batch=64))
    return D.experience(g, "A", response=c("response"))


# ---------------------------------------------------------------- sinks, resume, streaming
import hashlib  # noqa: E402
import os  # noqa: E402

from pyspark.sql import types as T  # noqa: E402

from offerlens.session import stage_path  # noqa: E402
from offerlens.sources import files as FS  # noqa: E402
from offerlens.sources import stages as ST  # noqa: E402

REC_SCHEMA = T.StructType([T.StructField("customer_id", T.LongType()), T.StructField("action", T.StringType()),
                           T.StructField("action_type", T.StringType()), T.StructField("propensity", T.DoubleType()),
                           T.StructField("value_qar", T.DoubleType())])
EXPERIENCE_SCHEMA = T.StructType([T.StructField(n, T.LongType() if n == "msisdn" else T.StringType()) for n in
                                  ["msisdn", "action", "action_type", "channel", "sentiment", "rationale_why",
                                   "message_how", "guard_status", "gen_source"]])


@register("src_csv_scan")
def q_src_csv_scan(spark, sf):
    rec = FS.escape_breaks(D.recommend_rules(_subs(spark, sf), "A"))
    path = FS.write_csv(rec, stage_path(spark, "campaign_triggers"))
    return FS.unescape_breaks(FS.read_csv(spark, path, REC_SCHEMA))


@register("sink_csv")
def q_sink_csv(spark, sf):
    texts = FS.escape_breaks(D.experience(_decided(spark, sf, "A"), "A"))
    path = FS.write_csv(texts, stage_path(spark, "experience"))
    return FS.unescape_breaks(FS.read_csv(spark, path, EXPERIENCE_SCHEMA))


@register("sink_export_detail")
def q_sink_export_detail(spark, sf):
    det = D.evaluation_detail(_decided(spark, sf, "A")).select(
        "customer_id", "action", "guard_status", rhu(c("p_baseline"), 6).alias("p_baseline"),
        rhu(c("p_treated"), 6).alias("p_treated"))
    path = FS.write_csv(det, stage_path(spark, "eval_detail"))
    schema = T.StructType([T.StructField("customer_id", T.LongType()), T.StructField("action", T.StringType()),
                           T.StructField("guard_status", T.StringType()), T.StructField("p_baseline", T.DoubleType()),
                           T.StructField("p_treated", T.DoubleType())])
    return FS.read_csv(spark, path, schema)


@register("sink_separate_outputs")
def q_sink_separate_outputs(spark, sf):
    root = stage_path(spark, "summaries")
    for v in ("A", "B"):
        FS.write_stage(D.summary_long(_wide(spark, sf, v), v), os.path.join(root, f"variant={v}"))
    return spark.read.parquet(root).select("variant", "metric_ord", "metric", "value")


@register("src_stage_resume")
def q_src_stage_resume(spark, sf):
    # one stage for each input folder; its manifest tells whether it is still that of these files and this plan
    path = stage_path(spark, f"subscribers-{hashlib.md5(sf.encode()).hexdigest()[:8]}", unique=False)
    return ST.resume_or_compute(spark, path, lambda: _subs(spark, sf)).select(*SUBSCRIBER_COLUMNS)


@register("src_upsert_reset")
def q_src_upsert_reset(spark, sf):
    # rerun twice into the same path: overwrite keeps the collection idempotent
    path = stage_path(spark, "corpus")
    corp = RP.corpus(Tables(spark, sf), text=True, whole=True).select(
        "interaction_id", "customer_id", "channel", "date", "is_relevant", "embedding", "text")
    FS.write_stage(corp, path)
    FS.write_stage(corp, path)
    return spark.read.parquet(path)


@register("emb_batch_write")
def q_emb_batch_write(spark, sf):
    path = stage_path(spark, "vectors")
    corp = RP.corpus(Tables(spark, sf), whole=True)
    FS.write_vectors(corp.select("interaction_id", "customer_id", "embedding", "is_relevant"), path)
    v = spark.read.parquet(path)
    return v.select("interaction_id", "customer_id", F.size("embedding").alias("dim"), "is_relevant")


@register("ext_stream_embed")
def q_ext_stream_embed(spark, sf):
    from offerlens.streaming import incremental as IN
    out = stage_path(spark, "stream_out")
    IN.run_incremental(spark, sf, out, stage_path(spark, "stream_ckpt"), file_glob="events.parquet")
    IN.settle(spark, out)
    return IN.corpus(spark, out).select("event_id", "user_id", F.size("embedding").alias("dim"))


# ---------------------------------------------------------------- recommended extensions
@register("ext_sim_threshold")
def q_ext_sim_threshold(spark, sf):
    t = Tables(spark, sf)
    s = R.score(RP.corpus(t), RP.anchor_query(t)).where(c("sim") >= 0.15)
    return R.exact_topk(s, 3).select(*HIT_COLS)


@register("ext_multi_query")
def q_ext_multi_query(spark, sf):
    t = Tables(spark, sf)
    a = R.score(RP.corpus(t), RP.anchor_query(t)).withColumnRenamed("sim", "s1")
    b = R.score(a, RP.probe_query(t)).withColumnRenamed("sim", "s2")
    m = b.withColumn("sim", (c("s1") + c("s2")) / F.lit(2.0))
    return R.exact_topk(m, 3).select(*HIT_COLS)


@register("ext_recency_decay")
def q_ext_recency_decay(spark, sf):
    t = Tables(spark, sf)
    s = R.score(RP.corpus(t), RP.anchor_query(t))
    age = F.datediff(F.to_date(F.lit(RP.REFERENCE_DATE)), F.to_date("date"))
    s = s.withColumn("sim", c("sim") * F.exp(F.lit(-0.01) * age))
    return R.exact_topk(s, 3).select(*HIT_COLS)


@register("ext_scope_filter")
def q_ext_scope_filter(spark, sf):
    corp, hits = _hits(spark, sf)
    owner = corp.select("interaction_id", c("customer_id").alias("owner"))
    j = hits.select("customer_id", "interaction_id").join(owner, "interaction_id", "inner")
    return j.agg(F.count(F.lit(1)).alias("n_hits"), F.count_if(c("owner") != c("customer_id")).alias("n_crossing"))


@register("ext_chunk_text")
def q_ext_chunk_text(spark, sf):
    from offerlens.functions.text import chunk_words
    d = Tables(spark, sf).documents.select("doc_id", "text")
    ch = d.select("doc_id", F.posexplode(chunk_words(c("text"), 200, 160)).alias("chunk_no", "chunk"))
    return ch.select("doc_id", c("chunk_no").cast("int").alias("chunk_no"), F.length("chunk").alias("n_chars"),
                     F.md5("chunk").alias("h"))


@register("ext_persist_vectors")
def q_ext_persist_vectors(spark, sf):
    # every customer's stored vectors, scored against its own stored query
    scored = RP.scoped_scores(*_persisted(spark, sf))
    return scored.select("customer_id", "interaction_id", rhu(c("sim"), 6).alias("sim"))


# ---------------------------------------------------------------- whole runs
from offerlens.plans import campaign as CP  # noqa: E402


def _retrieved(spark, sf):
    t = Tables(spark, sf)
    return RP.with_text(t, RP.anchor_hits(t)[1])


@register("pipe_run_retrieval")
def q_pipe_run_retrieval(spark, sf):
    """Rule score, retrieved interactions in the context record."""
    d = D.decide(CP.with_retrieval(_subs(spark, sf), _retrieved(spark, sf)), "A")
    ctx = D.context_struct("A", retrieval=True)
    return d.select("customer_id", "guard_status", ctx.alias("x")).select(
        "customer_id", "guard_status", c("x.action").alias("action"), c("x.propensity").alias("propensity"),
        c("x.retrieval_mode").alias("retrieval_mode"), c("x.transcript").alias("transcript"),
        F.array_join(F.transform("x.retrieved_interactions", lambda e: F.concat_ws("|", e["date"], e["channel"])), ",").alias("retrieved"))


@register("pipe_run_model")
def q_pipe_run_model(spark, sf):
    """The whole run on the model's recommendations; rows and customers of each output it wrote."""
    paths = CP.run_campaign(_subs(spark, sf), stage_path(spark, "campaign"), "A", _model(spark, sf), _retrieved(spark, sf))
    out = None
    for name, path in paths.items():
        rows = spark.read.parquet(path) if name in ("contexts", "evaluation_detail") else spark.read.option("header", True).csv(path)
        key = next(k for k in ("customer_id", "msisdn", "metric") if k in rows.columns)
        one = rows.agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"))
        out = one if out is None else out.unionByName(one)
    return out
