"""DuckDB oracle SQL for the registered queries.

Independent SQL formulations over the driver's pre-registered views
(region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations). Numeric expressions are
written with the same IEEE operations as the Spark side (``e0`` literals are
DOUBLE in DuckDB; plain decimals would be DECIMAL) so results hash equal.
"""

from __future__ import annotations

from offerlens.constants import (
    ACCOUNT_TYPES, CAMPAIGN_RESPONSES, CHANNELS, DEVICES, FLAGSHIP_DEVICES, LOW_END_DEVICE_TYPES,
    LOYALTY_TIERS, MID_DEVICES, NO_CONTACT, OFFERS, PAYMENT_METHODS, TOP_APPS,
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else repr(float(v)) if isinstance(v, float)
                           else str(v) for v in values) + "]"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def rhu(x: str, d: int) -> str:
    s = f"{float(10 ** d)!r}e0".replace(".0e0", "e0")
    return f"(floor(({x}) * {s} + 0.5e0) / {s})"


#: White space as Python's str.strip() has it, for RE2.
SPACE = "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def blank_sql(x: str) -> str:
    t = strip_sql(f"coalesce({x}, '')")
    return f"({t} = '' OR lower({t}) = 'no recent call-center contact')"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"


OFFER_NAMES = [o[0] for o in OFFERS]
OFFER_TYPES = [o[1] for o in OFFERS]
OFFER_PRICES = [float(o[2]) for o in OFFERS]


def subscribers_sql(variant: str = "A") -> str:
    """CTE body list ending in ``subs`` (one row per customer)."""
    low_end = inlist(LOW_END_DEVICE_TYPES)
    tier = (f"CASE WHEN device IN {inlist(FLAGSHIP_DEVICES)} THEN 'Flagship' "
            f"WHEN device IN {inlist(MID_DEVICES)} THEN 'Mid' ELSE 'Budget' END")
    if variant == "B":
        tier = f"CASE WHEN device_type IN {low_end} THEN 'Budget' ELSE {tier} END"
    return f"""
ref AS (SELECT CAST(max(o_orderdate) AS DATE) AS ref_date FROM orders),
li AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty,
         count_if(l_returnflag = 'R') AS n_ret, count_if(l_returnflag = 'A') AS n_acc,
         count_if(l_tax >= 0.06e0) AS n_hitax
  FROM lineitem GROUP BY l_orderkey),
ol AS (
  SELECT o.o_custkey, o.o_orderstatus, o.o_totalprice,
         CAST(date_diff('day', CAST(o.o_orderdate AS DATE), (SELECT ref_date FROM ref)) AS INTEGER) AS age_days,
         li.n_lines, li.sum_qty, li.n_ret, li.n_acc, li.n_hitax
  FROM orders o LEFT JOIN li ON o.o_orderkey = li.l_orderkey),
ostats AS (
  SELECT o_custkey, count(*) AS n_orders, max(age_days) AS tenure_days, min(age_days) AS gap_days,
         count_if(o_orderstatus = 'P') AS n_pending, count_if(o_orderstatus = 'F') AS n_finished,
         sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0e0 END) AS open_amount,
         sum(o_totalprice) AS total_price,
         sum(CASE WHEN age_days < 730 THEN o_totalprice ELSE 0e0 END) AS spend_recent,
         sum(CASE WHEN age_days >= 730 AND age_days < 1460 THEN o_totalprice ELSE 0e0 END) AS spend_prior,
         CAST(sum(coalesce(n_lines, 0)) AS BIGINT) AS n_lines,
         sum(coalesce(sum_qty, 0e0)) AS sum_qty,
         CAST(sum(coalesce(n_ret, 0)) AS BIGINT) AS n_ret,
         CAST(sum(coalesce(n_acc, 0)) AS BIGINT) AS n_acc,
         CAST(sum(coalesce(n_hitax, 0)) AS BIGINT) AS n_hitax
  FROM ol GROUP BY o_custkey),
estats AS (
  SELECT user_id, count_if(event_type = 'error') AS n_err,
         count_if(event_type IN ('view', 'click')) AS n_login
  FROM events GROUP BY user_id),
tr AS (
  SELECT conv_id, arg_max(text, turn) AS transcript_raw
  FROM conversations WHERE role = 'user' GROUP BY conv_id),
base AS (
  SELECT c.c_custkey AS k, c.c_nationkey AS nk, c.c_acctbal AS bal, c.c_mktsegment,
         coalesce(s.n_orders, 0) AS n_orders, coalesce(s.n_lines, 0) AS n_lines,
         coalesce(s.gap_days, 9999) AS gap, coalesce(s.tenure_days, 0) AS tenure_days,
         CASE WHEN coalesce(s.n_lines, 0) > 0 THEN s.n_ret / s.n_lines ELSE 0e0 END AS share_r,
         CASE WHEN coalesce(s.n_lines, 0) > 0 THEN s.sum_qty / s.n_lines ELSE 0e0 END AS avg_qty,
         coalesce(s.spend_recent, 0e0) AS recent, coalesce(s.spend_prior, 0e0) AS prior,
         coalesce(e.n_err, 0) AS n_err, coalesce(e.n_login, 0) AS n_login,
         s.n_pending, s.n_finished, s.open_amount, s.total_price, s.sum_qty, s.n_acc, s.n_hitax,
         t.transcript_raw
  FROM customer c
  LEFT JOIN ostats s ON c.c_custkey = s.o_custkey
  LEFT JOIN estats e ON c.c_custkey = e.user_id
  LEFT JOIN tr t ON c.c_custkey = t.conv_id),
f1 AS (
  SELECT k AS customer_id,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'HVC' WHEN 'BUILDING' THEN 'Mass' WHEN 'FURNITURE' THEN 'Youth'
         WHEN 'MACHINERY' THEN 'Business' WHEN 'HOUSEHOLD' THEN 'Mass' ELSE 'Mass' END AS segment,
    CASE WHEN bal >= 6000 THEN 'HIGH' WHEN bal >= 2000 THEN 'MED' ELSE 'LOW' END AS ltv,
    CAST(gap AS INTEGER) AS days_renewal,
    CAST(floor(tenure_days / 30e0) AS INTEGER) AS tenure_m,
    {rhu("least(gap / 600e0, 1e0)", 3)} AS churn,
    {lst(ACCOUNT_TYPES)}[k % 3 + 1] AS account_type,
    CASE WHEN nk % 5 = 0 THEN 'AR' ELSE 'EN' END AS language,
    CAST(k % 7 <> 0 AS INTEGER) AS consent,
    {rhu("least(avg_qty / 50e0 * 150e0, 130e0)", 1)} AS data_pct,
    CAST([5, 10, 20, 50, 100][CAST(floor(k / 5e0) % 5 AS BIGINT) + 1] AS INTEGER) AS data_cap_gb,
    CAST(n_orders % 4 AS INTEGER) AS overage,
    CAST(coalesce(sum_qty, 0e0) AS INTEGER) AS voice_min,
    CAST(coalesce(n_hitax, 0) AS INTEGER) AS intl_min,
    CAST(coalesce(n_acc, 0) % 8 AS INTEGER) AS roaming_days,
    CASE WHEN recent > prior * 1.2e0 THEN 'Rising' WHEN recent < prior * 0.8e0 THEN 'Falling'
         ELSE 'Stable' END AS usage_trend,
    {lst(TOP_APPS)}[k % 7 + 1] AS top_app,
    {rhu("coalesce(n_finished, 0) / greatest(n_orders, 1)", 2)} AS pct_5g,
    {rhu("coalesce(total_price, 0e0) / greatest(n_orders, 1) / 1000e0", 1)} AS arpu,
    CASE WHEN recent > prior * 1.1e0 THEN 'Up' WHEN recent < prior * 0.9e0 THEN 'Down' ELSE 'Flat' END AS arpu_trend,
    CAST(floor(coalesce(n_pending, 0) / 3e0) AS INTEGER) AS late_payments,
    {rhu("coalesce(open_amount, 0e0) / 1000e0", 1)} AS outstanding,
    {lst(PAYMENT_METHODS)}[k % 4 + 1] AS payment_method,
    {lst(DEVICES)}[CAST(floor(k / 3e0) % 7 AS BIGINT) + 1] AS device,
    CASE k % 20 WHEN 0 THEN 'Feature Phone' WHEN 1 THEN 'Router/MiFi' WHEN 2 THEN 'Tablet'
         WHEN 3 THEN 'IoT' ELSE 'Smartphone' END AS device_type,
    CAST(floor(tenure_days / 115e0) AS INTEGER) AS device_age,
    {rhu("share_r * 0.5e0", 2)} AS congestion,
    share_r AS _share_r,
    CAST(n_err AS INTEGER) AS _n_err,
    {lst(CHANNELS)}[k % 5 + 1] AS channel,
    CAST(n_login AS INTEGER) AS app_logins,
    {lst(LOYALTY_TIERS)}[nk % 4 + 1] AS loyalty,
    {lst(CAMPAIGN_RESPONSES)}[CAST(floor(k / 4e0) % 4 AS BIGINT) + 1] AS last_campaign_resp,
    CAST(transcript_raw IS NOT NULL AS INTEGER) AS complaint,
    CASE WHEN bal < 0 THEN 'Negative' WHEN bal < 5000 THEN 'Neutral' ELSE 'Positive' END AS sentiment,
    CAST(k % 11 AS INTEGER) AS nps,
    coalesce(transcript_raw, {q(NO_CONTACT)}) AS transcript,
    {lst(OFFER_NAMES)}[k % 10 + 1] AS shown_offer,
    {lst(OFFER_TYPES)}[k % 10 + 1] AS shown_action_type,
    {lst(OFFER_PRICES)}[k % 10 + 1] AS shown_value,
    {lst(OFFER_NAMES)}[(k + 1) % 10 + 1] AS nbo_alt_action,
    CAST(n_orders > 0 AND coalesce(n_finished, 0) * 2 >= n_orders AS INTEGER) AS accept_ind
  FROM base),
f2 AS (
  SELECT *,
    CASE WHEN days_renewal <= 60 THEN 'Renewal' WHEN days_renewal >= 360 THEN 'AtRisk'
         WHEN tenure_m < 12 THEN 'Onboarding' WHEN tenure_m < 36 THEN 'Growth' ELSE 'Maturity' END AS lifecycle,
    {rhu("data_cap_gb * data_pct / 100e0", 1)} AS data_used_gb,
    CAST(late_payments >= 2 AS INTEGER) AS dunning,
    {tier} AS device_tier,
    CAST(device_age >= 20 AS INTEGER) AS upgrade_eligible,
    device_age AS last_upgrade_m
  FROM f1),
f3 AS (
  SELECT *, CASE WHEN device_type IN {low_end} THEN '4G' WHEN device_tier IN ('Flagship', 'Mid') THEN '5G'
                 ELSE '4G' END AS net_cap
  FROM f2),
f4 AS (
  SELECT *,
    {rhu("greatest((CASE WHEN net_cap = '5G' THEN 180e0 ELSE 60e0 END) * (1e0 - 0.6e0 * congestion) * (1e0 - _share_r), 3e0)", 1)} AS dl_speed,
    CAST(floor(least(greatest((CASE WHEN net_cap = '5G' THEN 18e0 ELSE 40e0 END) + congestion * 120e0 + _n_err, 8e0), 300e0)) AS INTEGER) AS latency_ms,
    {rhu("least(_share_r * 0.3e0, 0.4e0)", 3)} AS dropped_call_rate,
    {rhu("greatest(1e0 - congestion * 0.6e0 - _share_r * 0.5e0, 0e0)", 2)} AS coverage,
    CAST(floor(_n_err / 15e0) AS INTEGER) AS net_complaints
  FROM f3),
subs AS (
  SELECT customer_id, segment, ltv, lifecycle, account_type, language, tenure_m, churn, days_renewal,
    consent, arpu, arpu_trend, late_payments, outstanding, dunning, payment_method, data_cap_gb,
    data_used_gb, data_pct, overage, voice_min, intl_min, roaming_days, usage_trend, top_app, pct_5g,
    device, device_type, device_tier, net_cap, device_age, upgrade_eligible, last_upgrade_m, dl_speed,
    dropped_call_rate, latency_ms, coverage, congestion, net_complaints,
    CAST(dropped_call_rate > 0.12e0 OR coverage < 0.25e0 OR latency_ms > 160 OR net_complaints >= 1
         OR dl_speed < 6e0 AS INTEGER) AS net_issue,
    channel, app_logins, loyalty, last_campaign_resp, complaint, sentiment, nps, transcript,
    CASE WHEN churn >= 0.6e0 THEN 'Churn risk detected' WHEN days_renewal <= 60 THEN 'Renewal window'
         WHEN upgrade_eligible = 1 THEN 'Device upgrade eligible'
         WHEN data_pct >= 80e0 THEN 'High data usage trend' ELSE 'Loyalty reward due' END AS nbo_reason,
    nbo_alt_action, shown_offer, shown_action_type, shown_value, accept_ind
  FROM f4)"""


# ---------------------------------------------------------------------------
# building blocks shared by many oracle queries
# ---------------------------------------------------------------------------

WORD = r"[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}]"
NONWORD = r"[^\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}]"


# Spark types of the non-string fields of the variant-A context record; every
# field is cast to its Spark type so that to_json prints numbers the same way.
CTX_DOUBLE = {"propensity", "value_qar", "churn", "arpu", "outstanding", "data_used_gb", "data_pct", "pct_5g",
              "dl_speed", "dropped_call_rate", "coverage", "congestion"}
CTX_INT = {"tenure_m", "days_renewal", "consent", "late_payments", "dunning", "data_cap_gb", "overage",
           "voice_min", "intl_min", "roaming_days", "device_age", "upgrade_eligible", "last_upgrade_m",
           "latency_ms", "net_complaints", "net_issue", "app_logins", "complaint", "nps"}


def context_json_sql() -> str:
    """fn_to_json: the variant-A context record as compact JSON (nulls kept)."""
    from offerlens.plans.decision import CONTEXT_FIELDS
    parts = []
    for f in CONTEXT_FIELDS:
        t = "DOUBLE" if f in CTX_DOUBLE else "INTEGER" if f in CTX_INT else "VARCHAR"
        src = redact_sql("transcript") if f == "transcript" else f
        parts.append(f"{f} := CAST({src} AS {t})")
    return "to_json(struct_pack(" + ", ".join(parts) + "))"


def json_string_sql(x: str) -> str:
    """A string as Python writes it in JSON: ASCII only, in quotes."""
    ch = f"substr({x}, i, 1)"
    n = f"unicode({ch})"
    u = lambda v: f"'\\u' || lpad(lower(to_hex({v})), 4, '0')"
    short = " ".join(f"WHEN {k} THEN '{v}'" for k, v in ((34, '\\"'), (92, "\\\\"), (10, "\\n"), (13, "\\r"), (9, "\\t"), (8, "\\b"), (12, "\\f")))
    one = (f"CASE {n} {short} ELSE CASE WHEN {n} BETWEEN 32 AND 126 THEN {ch} WHEN {n} < 65536 THEN {u(n)} "
           f"ELSE {u(f'(55296 + ({n} - 65536) // 1024)')} || {u(f'(56320 + ({n} - 65536) % 1024)')} END END")
    listed = f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: {one}), '')"
    return f"""CASE WHEN regexp_matches({x}, '^[ !#-\\[\\]-~]*$') THEN '"' || {x} || '"' ELSE '"' || {listed} || '"' END"""


def indented_json_sql(variant: str = "A") -> str:
    """fn_to_json: the context record as indented JSON."""
    from offerlens.plans.decision import A_ONLY, B_RENAMES, CONTEXT_FIELDS
    parts = []
    for f in CONTEXT_FIELDS:
        if variant == "B" and f in A_ONLY:
            continue
        name = B_RENAMES.get(f, f) if variant == "B" else f
        if f in CTX_INT or f == "value_qar":
            text = f"CAST(CAST({f} AS BIGINT) AS VARCHAR)"
        elif f in CTX_DOUBLE:
            text = f"CAST(CAST({f} AS DOUBLE) AS VARCHAR)"
        else:
            text = json_string_sql(redact_sql("transcript") if f == "transcript" else f)
        parts.append(f"""'  "{name}": ' || coalesce({text}, 'null')""")
    lines = " || ',' || chr(10) || ".join(parts)
    return f"'{{' || chr(10) || {lines} || chr(10) || '}}'"


def prompt_sql(variant: str = "A") -> str:
    """rule_prompt: offer line, channel, reason, then the context as JSON."""
    value = "CAST(CAST(value_qar AS BIGINT) AS VARCHAR)"
    if variant == "A":
        head = f"'SELECTED CAMPAIGN (do not change): ', action, ' | type=', action_type, ' | value=', {value}, ' QAR' || chr(10)"
        line = "SUBSCRIBER CONTEXT"
    else:
        head = f"'SELECTED ACTION (do not change): ', action, ' | type ', action_type, ' | value_qar ', {value}, chr(10)"
        line = "CUSTOMER CONTEXT"
    return (f"concat({head}, 'CHANNEL: ', channel, chr(10) || 'NBO_REASON: ', nbo_reason, chr(10) || chr(10) || '{line} (only use these facts):' "
            f"|| chr(10), {indented_json_sql(variant)})")


def redact_sql(x: str) -> str:
    """Unicode whole-word redaction (RE2's \\b is ASCII, so emulate it; two
    passes because a match consumes the separator its neighbour needs)."""
    pat = r"(^|" + NONWORD + r")\p{Nd}{6,}($|" + NONWORD + r")"
    once = f"regexp_replace({x}, '{pat}', '\\1[REDACTED]\\2', 'g')"
    return f"regexp_replace({once}, '{pat}', '\\1[REDACTED]\\2', 'g')"


def numbers_sql(x: str) -> str:
    """Whole-word runs of 1-5 digits, in order (list of strings)."""
    return (f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{NONWORD}+'), "
            r"lambda w: regexp_full_match(w, '\p{Nd}{1,5}'))")


def w(cond: str, weight: str) -> str:
    return f"(CASE WHEN {cond} THEN {weight} ELSE 0e0 END)"


def propensity_sql(offer: str, at: str) -> str:
    s = ("0.12e0"
         f" + {w(f'{at} = ' + q('Retention') + ' AND churn > 0.6e0', '0.25e0')}"
         f" - {w(f'{at} = ' + q('Upsell') + ' AND churn > 0.6e0', '0.10e0')}"
         f" + {w(f'{at} = ' + q('Upsell') + ' AND data_pct > 80', '0.18e0')}"
         f" + {w(f'{at} = ' + q('NBO') + ' AND segment = ' + q('Mass'), '0.08e0')}"
         f" + {w('lifecycle = ' + q('Renewal') + f' AND {at} = ' + q('Retention'), '0.15e0')}"
         f" + {w('ltv = ' + q('HIGH'), '0.05e0')}"
         f" + {w(f'{offer} = ' + q('Device_Upgrade_iPhone') + ' AND upgrade_eligible = 1', '0.15e0')}"
         f" - {w('sentiment = ' + q('Negative'), '0.08e0')}"
         f" + {w('usage_trend = ' + q('Rising') + f' AND {at} = ' + q('Upsell'), '0.10e0')}"
         f" - {w('consent = 0', '0.05e0')}"
         f" - {w(f'net_issue = 1 AND {at} = ' + q('Upsell'), '0.10e0')}"
         f" + {w(f'net_issue = 1 AND {at} = ' + q('Retention'), '0.06e0')}")
    return f"least(greatest({s}, 0.01e0), 0.95e0)"


def heuristic_sql(at: str) -> str:
    s = ("0.15e0"
         f" + {w(f'{at} = ' + q('Retention') + ' AND churn > 0.6e0', '0.25e0')}"
         f" + {w(f'{at} = ' + q('Upsell') + ' AND data_pct > 80', '0.18e0')}"
         f" + {w('lifecycle = ' + q('Renewal') + f' AND {at} = ' + q('Retention'), '0.15e0')}"
         f" + {w('ltv = ' + q('HIGH'), '0.05e0')}")
    return f"least({s}, 0.95e0)"


def offers_values(variant: str = "A") -> str:
    names = OFFER_NAMES if variant == "A" else sorted(OFFER_NAMES)
    rank = {n: i for i, n in enumerate(names)}
    rows = ", ".join(f"({i}, {q(n)}, {q(t)}, {float(p)!r}e0, {rank[n]})"
                     for i, (n, t, p) in enumerate(OFFERS))
    return f"(VALUES {rows}) AS ofr(offer_ord, offer, action_type, price, tie_rank)"


def guard_sql(variant: str = "A", at: str = "action_type", v: str = "value_qar") -> str:
    soft = f"WHEN {at} = 'Retention' AND ltv = 'LOW' AND churn >= 0.6e0 THEN 'SOFTENED' "
    credit = f"WHEN late_payments >= 2 AND {v} > 150 THEN 'REVIEW_CREDIT' "
    if variant == "A":
        return ("CASE WHEN consent = 0 THEN 'BLOCKED_NO_CONSENT' " + soft + credit
                + f"WHEN net_issue = 1 AND {at} = 'Upsell' THEN 'NETWORK_HOLD' ELSE 'APPROVED' END")
    return "CASE " + soft + credit + "ELSE 'APPROVED' END"


def lift_sql(a: str = "action", at: str = "action_type", g: str = "guard_status") -> str:
    x = ("1.10e0"
         f" + {w('overage >= 1 OR data_pct >= 80', '0.12e0')}"
         f" + {w('days_renewal <= 60', '0.10e0')}"
         f" + {w(f'{at} = ' + q('Retention') + ' AND churn >= 0.6e0', '0.10e0')}"
         f" + {w('usage_trend = ' + q('Rising') + f' AND {at} = ' + q('Upsell'), '0.06e0')}"
         f" + {w(f'upgrade_eligible = 1 AND contains({a}, ' + q('Device') + ')', '0.08e0')}"
         f" + {w('sentiment = ' + q('Negative'), '0.06e0')}"
         f" + {w(f'net_issue = 1 AND {at} IN (' + q('Retention') + ', ' + q('CrossSell') + ')', '0.07e0')}"
         f" - {w(f'net_issue = 1 AND {at} = ' + q('Upsell'), '0.04e0')}"
         f" + {w('loyalty IN (' + q('Gold') + ', ' + q('Platinum') + ')', '0.04e0')}"
         " + 0.05e0"
         f" - {w(f'{g} IN (' + q('SOFTENED') + ', ' + q('REVIEW_CREDIT') + ')', '0.05e0')}")
    return f"least(CASE WHEN consent = 0 THEN 1.0e0 ELSE {x} END, 1.55e0)"


def rec_sql(variant: str = "A") -> str:
    """CTEs ``scored`` (subs x offers) and ``rec`` (argmax) after ``subs``."""
    return f"""
scored AS (
  SELECT s.customer_id, ofr.offer_ord, ofr.offer, ofr.action_type AS offer_type, ofr.price, ofr.tie_rank,
         {propensity_sql('ofr.offer', 'ofr.action_type')} AS score
  FROM subs s CROSS JOIN {offers_values(variant)}),
best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, tie_rank) AS rn FROM scored)
  WHERE rn = 1),
rec AS (
  SELECT customer_id, offer AS action, offer_type AS action_type, {rhu('score', 4)} AS propensity,
         price AS value_qar FROM best),
decided AS (
  SELECT s.*, r.action, r.action_type, r.propensity, r.value_qar FROM subs s JOIN rec r USING (customer_id)),
guarded AS (SELECT *, {guard_sql(variant)} AS guard_status FROM decided),
detail AS (
  SELECT *, propensity * 0.85e0 AS p_baseline, {lift_sql()} AS lift FROM guarded),
detail2 AS (
  SELECT *, CASE WHEN isnan(p_baseline * lift) THEN p_baseline * lift
                 ELSE least(greatest(p_baseline * lift, 0e0), 0.95e0) END AS p_treated FROM detail)"""


def with_all(variant: str = "A") -> str:
    return "WITH " + subscribers_sql(variant) + "," + rec_sql(variant)


def fixed0(x: str) -> str:
    return f"printf('%.0f', {x})"


def pct0(x: str) -> str:
    return f"(printf('%.0f', ({x}) * 100e0) || '%')"


def rationale_sql(variant: str = "A") -> str:
    tr = redact_sql("transcript")
    if variant == "A":
        issue = f"'is experiencing network issues (dropped-call rate ' || {pct0('dropped_call_rate')} || ')'"
        care = f"'recently contacted care: \"' || {tr} || '\"'"
        over = "'exceeded data cap in ' || overage || ' of the last 3 months'"
        prefix = "Subscriber "
    else:
        parts = ("concat_ws(', ', "
                 f"CASE WHEN dropped_call_rate > 0.05e0 THEN 'high dropped-call rate (' || {pct0('dropped_call_rate')} || ')' END, "
                 "CASE WHEN coverage < 0.4e0 THEN 'weak coverage at their location' END, "
                 "CASE WHEN latency_ms > 120 THEN 'high latency (' || latency_ms || 'ms)' END, "
                 f"CASE WHEN dl_speed < 10e0 THEN 'low speeds (' || {fixed0('dl_speed')} || 'Mbps)' END, "
                 "CASE WHEN net_complaints >= 1 THEN net_complaints || ' network complaint(s) in 90 days' END)")
        details = f"CASE WHEN {parts} = '' THEN 'degraded experience' ELSE {parts} END"
        issue = f"'is experiencing network issues (' || {details} || ')'"
        care = f"'recently contacted care (' || {tr} || ')'"
        over = "'exceeded the data cap in ' || overage || ' of the last 3 months'"
        prefix = "Customer "
    parts = ("concat_ws(', ', "
             f"CASE WHEN net_issue = 1 THEN {issue} END, "
             f"CASE WHEN sentiment = 'Negative' OR complaint = 1 THEN {care} END, "
             f"CASE WHEN overage >= 1 THEN {over} END, "
             f"CASE WHEN data_pct >= 80 THEN 'is a heavy data user (' || {fixed0('data_pct')} || '% of ' || data_cap_gb || 'GB)' END, "
             "CASE WHEN usage_trend = 'Rising' THEN 'has rising data usage' END, "
             "CASE WHEN days_renewal <= 60 THEN 'is ' || days_renewal || ' days from renewal' END, "
             "CASE WHEN upgrade_eligible = 1 THEN 'is eligible for a device upgrade (' || device || ', ' || device_age || 'm old)' END, "
             "CASE WHEN churn >= 0.6e0 THEN 'shows elevated churn risk' END, "
             "CASE WHEN loyalty IN ('Gold', 'Platinum') THEN 'is a ' || loyalty || ' loyalty member' END)")
    fallback = "'is an active ' || segment || ' customer (tenure ' || tenure_m || 'm)'"
    return f"('{prefix}' || CASE WHEN {parts} = '' THEN {fallback} ELSE {parts} END || '.')"


def message_sql(why: str, variant: str = "A", brand: str = "YourTelco") -> str:
    dash = " — " if variant == "A" else " - "
    o = "replace(action, '_', ' ')"
    renewal = (", and your renewal is in " if variant == "A" else " and your renewal is in ")
    headroom = " gives you more headroom" if variant == "A" else " gives you headroom"
    core = (f"CASE WHEN net_issue = 1 THEN 'We noticed your service hasn''t been at its best lately{dash}to make it right, our ' || {o} || ' is ready for you' "
            f"WHEN sentiment = 'Negative' OR churn >= 0.6e0 OR net_issue = 1 THEN 'Thanks for being with us{dash}to make things right, our ' || {o} || ' is ready for you' "
            f"WHEN action_type = 'Upsell' AND upgrade_eligible = 1 AND contains(action, 'Device') THEN 'You''re eligible to upgrade your ' || device || '{dash}' || {o} || ' is ready' "
            f"WHEN action_type = 'Upsell' THEN 'You''re using ' || {fixed0('data_pct')} || '% of your ' || data_cap_gb || 'GB{dash}' || {o} || '{headroom}' "
            f"WHEN action_type = 'Retention' THEN 'Based on your usage, our ' || {o} || ' keeps you covered' || CASE WHEN days_renewal <= 60 THEN '{renewal}' || days_renewal || ' days' ELSE '' END "
            f"WHEN action_type = 'CrossSell' THEN 'Add ' || {o} || ' to get more from your plan' "
            f"ELSE {o} || ' suits your usage' END")
    full = (f"CASE channel WHEN 'SMS' THEN 'Hi! ' || ({core}) || '. Reply YES. {brand}' "
            f"WHEN 'Push' THEN ({core}) || '{dash}tap to activate.' "
            f"WHEN 'WhatsApp' THEN 'Hi! ' || ({core}) || '. Tap below to confirm. {brand}' "
            f"WHEN 'Email' THEN 'Dear Customer,' || chr(10) || chr(10) || {why} || chr(10) || chr(10) || ({core}) || '.' || chr(10) || chr(10) || '{brand}' "
            f"WHEN 'Call' THEN 'AGENT: ' || {why} || ' Recommend: ' || ({core}) || '.' END")
    limit = "CASE channel WHEN 'SMS' THEN 160 WHEN 'Push' THEN 120 WHEN 'WhatsApp' THEN 300 WHEN 'Email' THEN 600 WHEN 'Call' THEN 400 END"
    return f"substring({full}, 1, {limit})"


ORACLE: dict[str, str] = {}
A = lambda: with_all("A")
B = lambda: with_all("B")
SUBS = "WITH " + subscribers_sql("A")

SUB_COLS = ("customer_id, segment, ltv, lifecycle, account_type, language, tenure_m, churn, days_renewal, "
            "consent, arpu, arpu_trend, late_payments, outstanding, dunning, payment_method, data_cap_gb, "
            "data_used_gb, data_pct, overage, voice_min, intl_min, roaming_days, usage_trend, top_app, pct_5g, "
            "device, device_type, device_tier, net_cap, device_age, upgrade_eligible, last_upgrade_m, dl_speed, "
            "dropped_call_rate, latency_ms, coverage, congestion, net_complaints, net_issue, channel, app_logins, "
            "loyalty, last_campaign_resp, complaint, sentiment, nps, transcript, nbo_reason, nbo_alt_action, "
            "shown_offer, shown_action_type, shown_value, accept_ind")

ORACLE.update({
    "proj_select_cols": SUBS + f" SELECT {SUB_COLS} FROM subs",
    "feat_usage_pct": SUBS + " SELECT customer_id, data_pct, data_used_gb FROM subs",
    "feat_dunning": SUBS + " SELECT customer_id, late_payments, dunning FROM subs",
    "feat_upgrade_eligible": SUBS + " SELECT customer_id, device_age, upgrade_eligible FROM subs",
    "feat_device_tier": SUBS + " SELECT customer_id, device, device_type, device_tier AS tier_a, "
                               "CASE WHEN device_type IN ('Feature Phone', 'IoT') THEN 'Budget' ELSE device_tier END AS tier_b FROM subs",
    "feat_net_capability": SUBS + " SELECT customer_id, device_tier, device_type, net_cap FROM subs",
    "feat_network_issue": SUBS + " SELECT customer_id, dropped_call_rate, coverage, latency_ms, net_complaints, dl_speed, net_issue FROM subs",
    "flt_in_set": SUBS + " SELECT customer_id, loyalty FROM subs WHERE loyalty IN ('Gold', 'Platinum')",
    "flt_contains": A() + " SELECT customer_id, action FROM decided WHERE contains(action, 'Device')",
    "flt_key_lookup": A() + " SELECT customer_id, action, segment, channel FROM decided WHERE customer_id = "
                            "(SELECT min(customer_id) FROM decided WHERE complaint = 1)",
    "flt_blank_sentinel": SUBS + f" SELECT customer_id, {strip_sql('transcript')} AS transcript FROM subs WHERE NOT {blank_sql('transcript')}",
    "join_cross_offers": SUBS + f" SELECT customer_id, offer_ord, offer, action_type, price FROM subs CROSS JOIN {offers_values('A')}",
    "proj_overwrite_candidate": SUBS + f" SELECT customer_id, segment, offer AS product_id, ofr.action_type AS action_type, "
                                       f"price AS monthly_value FROM subs CROSS JOIN {offers_values('A')}",
    "rule_propensity": A() + f" SELECT customer_id, offer, offer_type AS action_type, {rhu('score', 4)} AS propensity FROM scored",
    "agg_argmax_offer": A() + " SELECT customer_id, action, action_type, propensity, value_qar FROM rec",
    "agg_argmax_offer_b": B() + " SELECT customer_id, action, action_type, propensity, value_qar FROM rec",
    "topk_offers_ranking": A() + f""" SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, tie_rank) AS INTEGER) AS offer_rank,
        offer, offer_type AS action_type, price, {rhu('score', 4)} AS score FROM scored""",
    "rule_heuristic_ranking": SUBS + f""", h AS (SELECT customer_id, offer, offer_ord, {heuristic_sql('ofr.action_type')} AS score
        FROM subs CROSS JOIN {offers_values('A')})
        SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, offer_ord) AS INTEGER) AS offer_rank,
        offer, {rhu('score', 4)} AS score FROM h""",
    "join_offer_lookup": SUBS + f""", o AS (SELECT * FROM {offers_values('A')})
        SELECT s.customer_id, s.shown_offer, o1.price AS shown_price, s.nbo_alt_action, coalesce(o2.action_type, '') AS alt_type
        FROM subs s JOIN o o1 ON s.shown_offer = o1.offer LEFT JOIN o o2 ON s.nbo_alt_action = o2.offer""",
    "fn_map_lookup": SUBS + " SELECT customer_id, channel, CASE channel WHEN 'SMS' THEN 160 WHEN 'Push' THEN 120 "
                            "WHEN 'WhatsApp' THEN 300 WHEN 'Email' THEN 600 WHEN 'Call' THEN 400 END AS channel_limit FROM subs",
    "src_literal_dim": SUBS + f""", n AS (SELECT shown_offer, count(*) AS n_shown FROM subs GROUP BY 1)
        SELECT offer_ord, offer, action_type, price, coalesce(n_shown, 0) AS n_shown
        FROM {offers_values('A')} LEFT JOIN n ON ofr.offer = n.shown_offer""",
    "rule_guard_full": A() + " SELECT customer_id, action, guard_status FROM guarded",
    "rule_guard_margin": B() + " SELECT customer_id, action, guard_status FROM guarded",
    "rule_lift": A() + f" SELECT customer_id, {rhu('lift', 6)} AS lift FROM detail2",
    "rule_treated_prob": A() + f" SELECT customer_id, {rhu('p_baseline', 6)} AS p_baseline, {rhu('p_treated', 6)} AS p_treated FROM detail2",
    "join_rec_subscriber": A() + " SELECT r.*, s.segment, s.channel, s.churn FROM rec r JOIN subs s USING (customer_id)",
    "join_eval_three_way": A() + f" SELECT customer_id, customer_id AS msisdn, action, guard_status, {rhu('p_baseline', 6)} AS p_baseline, "
                                 f"{rhu('p_treated', 6)} AS p_treated FROM detail2",
    "agg_mean_rate": A() + f" SELECT {rhu('avg(p_baseline)', 6)} AS acceptance_baseline, {rhu('avg(p_treated)', 6)} AS acceptance_treated FROM detail2",
    "agg_revenue_sum": A() + f" SELECT {rhu('sum(p_baseline * value_qar * 12e0)', 2)} AS revenue_baseline, "
                             f"{rhu('sum(p_treated * value_qar * 12e0)', 2)} AS revenue_treated FROM detail2",
    "agg_count": A() + " SELECT action, count(*) AS n FROM detail2 GROUP BY action",
})

_SUMMARY = """, wide AS (
  SELECT count(*) AS n, avg(p_baseline) AS acceptance_baseline, avg(p_treated) AS acceptance_treated,
         sum(p_baseline * value_qar * 12e0) AS revenue_baseline, sum(p_treated * value_qar * 12e0) AS revenue_treated
  FROM detail2),
wide2 AS (
  SELECT *, revenue_treated / revenue_baseline - 1e0 AS revenue_uplift, revenue_treated - revenue_baseline AS incremental_revenue,
         (revenue_treated - revenue_baseline) * (500000e0 / n) AS extrapolated_500000,
         (revenue_treated - revenue_baseline) * (2000000e0 / n) AS extrapolated_2000000
  FROM wide)"""


def _long(labels):
    vals = [
        "printf('%.1f', acceptance_baseline * 100e0) || '%'",
        "printf('%.1f', acceptance_treated * 100e0) || '%'",
        "'+' || printf('%.1f', revenue_uplift * 100e0) || '%'",
        "format('{:,.0f}', incremental_revenue)",
        "format('{:,.0f}', extrapolated_500000)",
        "format('{:,.0f}', extrapolated_2000000)",
    ]
    return " UNION ALL ".join(f"SELECT {i} AS metric_ord, {q(l)} AS metric, {v} AS value FROM wide2"
                              for i, (l, v) in enumerate(zip(labels, vals)))


ORACLE.update({
    "agg_uplift_ratio": A() + _SUMMARY + f" SELECT {rhu('revenue_uplift', 6)} AS revenue_uplift FROM wide2",
    "agg_extrapolate": A() + _SUMMARY + f" SELECT n, {rhu('incremental_revenue', 2)} AS incremental_revenue, "
                                        f"{rhu('extrapolated_500000', 0)} AS extrapolated_500000, {rhu('extrapolated_2000000', 0)} AS extrapolated_2000000 FROM wide2",
    "agg_summary_long": A() + _SUMMARY + " " + _long(["Acceptance_baseline", "Acceptance_treated", "Revenue_uplift_pct",
                                                     "Incr_annual_QAR_sample", "Extrap_500k_QAR", "Extrap_2M_QAR"]),
    "agg_summary_long_b": B() + _SUMMARY + " " + _long(["Acceptance baseline", "Acceptance treated", "Revenue uplift %",
                                                       "Incr annual rev QAR (sample)", "Extrapolated +QAR/yr @500k",
                                                       "Extrapolated +QAR/yr @2M"]),
    "pipe_run": A() + _SUMMARY + f" SELECT n, {rhu('acceptance_baseline', 6)} AS acceptance_baseline, {rhu('acceptance_treated', 6)} AS acceptance_treated, "
                                 f"{rhu('revenue_uplift', 6)} AS revenue_uplift, {rhu('revenue_baseline', 2)} AS revenue_baseline, "
                                 f"{rhu('revenue_treated', 2)} AS revenue_treated FROM wide2",
    "fn_percent_money_fmt": A() + " SELECT customer_id, printf('%.1f', p_treated * 100e0) || '%' AS p_treated_pct, "
                                  "format('{:,.0f}', value_qar * 1000e0) AS value_money, printf('%.0f', data_pct) AS data_pct_0f FROM detail2",
    "fn_round": SUBS + f" SELECT customer_id, round_even(data_pct, 0) AS data_pct_even, round_even(arpu, 0) AS arpu_even, "
                       f"{rhu('data_used_gb', 0)} AS used_half_up FROM subs",
    "fn_clip": A() + f" SELECT customer_id, offer, {rhu('least(greatest(score * 3e0, 0e0), 0.95e0)', 6)} AS clipped FROM scored",
    "lim_head_n": A() + " SELECT customer_id, action, propensity FROM decided ORDER BY customer_id LIMIT 20",
    "agg_dedup_keep_first": """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""",
    "agg_group_first": SUBS + " SELECT shown_offer, arg_min(shown_value, customer_id) AS first_price, "
                              "arg_min(shown_action_type, customer_id) AS first_type FROM subs GROUP BY shown_offer",
    "agg_distinct_sorted": A() + " SELECT array_to_string(list_sort(list(DISTINCT action)), ',') AS offers FROM decided",
    "sort_by_key": A() + " SELECT customer_id, propensity FROM decided ORDER BY propensity, customer_id",
    "rule_rationale": A() + f" SELECT customer_id AS msisdn, {rationale_sql('A')} AS rationale_why FROM guarded",
    "rule_rationale_b": B() + f" SELECT customer_id AS msisdn, {rationale_sql('B')} AS rationale_why FROM guarded",
    "rule_message": A() + f" SELECT customer_id AS msisdn, channel, {message_sql(rationale_sql('A'), 'A')} AS message_how FROM guarded",
    "rule_message_b": B() + f" SELECT customer_id AS msisdn, channel, {message_sql(rationale_sql('B'), 'B')} AS message_how FROM guarded",
    "proj_rename": A() + f" SELECT customer_id AS msisdn, action, action_type, channel, sentiment, {rationale_sql('A')} AS rationale_why, "
                         f"{message_sql(rationale_sql('A'), 'A')} AS message_how, guard_status, 'offline' AS gen_source FROM guarded",
    "fn_redact": f"SELECT doc_id, {redact_sql('text')} AS text FROM documents",
    "fn_extract_numbers": f"SELECT doc_id, len({numbers_sql('text')}) AS n_numbers, array_to_string({numbers_sql('text')}, ',') AS numbers FROM documents",
    "fn_strip_zeros": f"""SELECT doc_id, array_to_string(list_transform({numbers_sql('text')},
        lambda n: CASE WHEN ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END), ',') AS numbers FROM documents""",
    "fn_text_len": "SELECT doc_id, length(text) AS n_chars, length(text) = n_chars AS same FROM documents",
    "fn_truncate": SUBS + " SELECT customer_id, substring(transcript, 1, CASE channel WHEN 'SMS' THEN 160 WHEN 'Push' THEN 120 "
                          "WHEN 'WhatsApp' THEN 300 WHEN 'Email' THEN 600 WHEN 'Call' THEN 400 END) AS cut FROM subs",
    "fn_str_clean": A() + " SELECT customer_id, lower(trim(replace(action, '_', ' '))) AS clean, "
                          "array_to_string(string_split(device, ' '), '|') AS parts FROM decided",
    "fn_default": SUBS + """, cv AS (SELECT conv_id, arg_max(text, turn) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
        SELECT customer_id, coalesce(reply, '') AS reply, coalesce(nullif(CAST(length(reply) AS VARCHAR), '0'), '-') AS shown
        FROM subs LEFT JOIN cv ON subs.customer_id = cv.conv_id""",
    "fn_zero_pad": "SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '-' || lpad(CAST(turn AS VARCHAR), CAST(greatest(2, length(CAST(turn AS VARCHAR))) AS INTEGER), '0') AS interaction_id FROM conversations",
    "fn_from_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "fn_date_sub_fmt": "SELECT conv_id, turn, strftime(DATE '2024-01-31' - CAST(turn * 7 AS INTEGER), '%Y-%m-%d') AS date FROM conversations",
    "fn_stable_hash": "SELECT conv_id, turn, md5(CAST(conv_id AS VARCHAR) || '|history|' || CAST(turn AS VARCHAR)) AS h FROM conversations",
})


# ---------------------------------------------------------------------------
# retrieval
# ---------------------------------------------------------------------------

def dot_sql(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(range(1, len({a}) + 1), "
            f"lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)), lambda x, y: x + y)")


def query_sql(vec_id: int) -> str:
    """The query vector: row ``vec_id`` of the embeddings, normalised."""
    return (f"(SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt({dot_sql('embedding', 'embedding')}), 1e-12)) AS q "
            f"FROM embeddings WHERE vec_id = {vec_id})")


def sim_sql(a: str, unit: str) -> str:
    return f"({dot_sql(a, unit)} / greatest(sqrt({dot_sql(a, a)}), 1e-12))"


WHOLE_CORPUS = """corpus AS (
  SELECT e.vec_id AS interaction_id, CAST(e.label AS BIGINT) AS customer_id, e.embedding,
         coalesce(d.text, '') AS text, coalesce(l.quality = 1, false) AS is_relevant,
         coalesce(l.toxic = 1, false) AS is_toxic,
         ['call', 'chatbot', 'social', 'complaint'][e.vec_id % 4 + 1] AS channel,
         strftime(DATE '2024-01-31' - CAST(e.vec_id % 90 AS INTEGER), '%Y-%m-%d') AS date
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = e.vec_id)"""
#: Without the rows that serve as queries.
CORPUS = WHOLE_CORPUS[:-1] + " WHERE e.vec_id NOT IN (0, 1))"


def scoped_sql() -> str:
    """Every row with its similarity to its customer's first row."""
    return f"""WITH {WHOLE_CORPUS},
        first AS (SELECT customer_id, arg_min(embedding, interaction_id) AS embedding, min(interaction_id) AS query_id FROM corpus GROUP BY 1),
        qv AS (SELECT customer_id, query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) /
               greatest(sqrt({dot_sql('embedding', 'embedding')}), 1e-12)) AS q FROM first),
        scored AS (SELECT corpus.*, {sim_sql('embedding', 'qv.q')} AS sim FROM corpus JOIN qv USING (customer_id)
                   WHERE interaction_id <> query_id)"""


def hits_sql(k: int = 3) -> str:
    return f"""WITH {CORPUS},
qv AS {query_sql(0)},
scored AS (SELECT corpus.*, {sim_sql('embedding', 'qv.q')} AS sim FROM corpus CROSS JOIN qv),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY sim DESC, interaction_id) AS INTEGER) AS rank FROM scored),
hits AS (SELECT *, {rhu('sim', 4)} AS similarity, {rhu('1e0 - sim', 4)} AS distance FROM ranked WHERE rank <= {k})"""


def probe_sql() -> str:
    return f"""WITH {CORPUS},
pv AS {query_sql(1)},
scored AS (SELECT corpus.*, {sim_sql('embedding', 'pv.q')} AS sim FROM corpus CROSS JOIN pv),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY sim DESC, interaction_id) AS INTEGER) AS rank
           FROM scored),
phits AS (SELECT *, {rhu('sim', 4)} AS similarity FROM ranked WHERE rank <= 2),
dedup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY sim DESC, interaction_id) AS rn FROM phits) WHERE rn = 1),
top5 AS (SELECT * FROM dedup ORDER BY sim DESC, interaction_id LIMIT 5)"""


H = hits_sql(3)
SCOPED = scoped_sql()
PR = """, per_hist AS (SELECT customer_id, count_if(is_relevant) AS n_relevant FROM corpus GROUP BY 1),
per_hit AS (SELECT customer_id, count(*) AS n_retrieved, count_if(is_relevant) AS n_hits FROM hits GROUP BY 1),
pr AS (SELECT h.customer_id, h.n_relevant, coalesce(t.n_retrieved, 0) AS n_retrieved, coalesce(t.n_hits, 0) AS n_hits,
              coalesce(t.n_hits, 0) / greatest(coalesce(t.n_retrieved, 0), 1) AS precision,
              coalesce(t.n_hits, 0) / greatest(h.n_relevant, 1) AS recall
       FROM per_hist h LEFT JOIN per_hit t USING (customer_id)),
pl AS (SELECT f.customer_id, f.full_chars, coalesce(r.retrieved_chars, 0) AS retrieved_chars,
              1e0 - coalesce(r.retrieved_chars, 0) / f.full_chars AS reduction
       FROM (SELECT customer_id, sum(length(text)) + count(*) - 1 AS full_chars FROM corpus GROUP BY 1) f
       LEFT JOIN (SELECT customer_id, sum(length(text)) + count(*) - 1 AS retrieved_chars FROM hits GROUP BY 1) r
       USING (customer_id))"""

ORACLE.update({
    "src_corpus_load": f"WITH {WHOLE_CORPUS} SELECT interaction_id, customer_id, channel, date, is_relevant, embedding, text FROM corpus",
    "fn_vec_norm": f"""SELECT vec_id, {rhu(f"sqrt({dot_sql('embedding', 'embedding')})", 6)} AS norm,
        {rhu(f"sqrt({dot_sql('n', 'n')})", 6)} AS unit_norm, {rhu('n[1]', 6)} AS x0
        FROM (SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(x AS DOUBLE) /
              greatest(sqrt({dot_sql('embedding', 'embedding')}), 1e-12)) AS n FROM embeddings)""",
    "fn_cosine": H + f" SELECT interaction_id, {rhu('sim', 6)} AS sim FROM scored",
    "ret_exact_topk": H + " SELECT customer_id, rank, interaction_id, channel, date, similarity, distance FROM hits",
    "win_topk_per_customer": hits_sql(5) + " SELECT customer_id, rank, interaction_id FROM hits",
    "join_customer_scope": SCOPED + f""",
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY sim DESC, interaction_id) AS INTEGER) AS rank FROM scored)
        SELECT customer_id, rank, interaction_id, channel, date, {rhu('sim', 4)} AS similarity, {rhu('1e0 - sim', 4)} AS distance
        FROM ranked WHERE rank <= 3""",
    "ret_explain": H + " SELECT c.interaction_id, c.customer_id, h.rank IS NOT NULL AS kept, h.rank FROM corpus c LEFT JOIN hits h USING (interaction_id)",
    "join_anti_not_retrieved": H + " SELECT customer_id, interaction_id, channel, date FROM corpus c WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.interaction_id = c.interaction_id)",
    "join_semi_kept": H + " SELECT customer_id, interaction_id, is_relevant FROM corpus c WHERE EXISTS (SELECT 1 FROM hits h WHERE h.interaction_id = c.interaction_id)",
    "set_difference": H + " SELECT c.customer_id, count_if(h.rank IS NOT NULL) AS n_kept, count_if(h.rank IS NULL) AS n_dropped FROM corpus c LEFT JOIN hits h USING (interaction_id) GROUP BY 1",
    "join_truth_labels": H + " SELECT customer_id, rank, interaction_id, is_relevant FROM hits",
    "agg_precision_recall": H + PR + f" SELECT customer_id, n_relevant, n_retrieved, n_hits, {rhu('precision', 6)} AS precision, {rhu('recall', 6)} AS recall FROM pr",
    "agg_random_baseline": f"WITH {CORPUS} SELECT {rhu('avg(CAST(is_relevant AS DOUBLE))', 6)} AS random_baseline, count(*) AS n FROM corpus",
    "agg_misses_fps": H + f""", m AS (SELECT count(*) AS n_missed, min(interaction_id) AS first_missed_id FROM corpus c
            WHERE is_relevant AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.interaction_id = c.interaction_id)),
        f AS (SELECT count(*) AS n_false_positives FROM hits WHERE NOT is_relevant),
        b AS (SELECT sim, interaction_id FROM hits WHERE NOT is_relevant ORDER BY sim DESC, interaction_id LIMIT 1)
        SELECT n_missed, first_missed_id, (SELECT coalesce(min(text), '') FROM corpus WHERE interaction_id = first_missed_id) AS first_missed_text, n_false_positives, (SELECT {rhu('sim', 4)} FROM b) AS top_fp_similarity,
               (SELECT interaction_id FROM b) AS top_fp_id FROM m, f""",
    "agg_payload_reduction": H + PR + f" SELECT customer_id, full_chars, retrieved_chars, {rhu('reduction', 6)} AS reduction FROM pl",
    "ret_evaluate": H + PR + f""" SELECT {rhu('(SELECT avg(precision) FROM pr)', 6)} AS precision_at_k,
        {rhu('(SELECT avg(recall) FROM pr)', 6)} AS recall_at_k,
        {rhu('(SELECT avg(CAST(is_relevant AS DOUBLE)) FROM corpus)', 6)} AS random_baseline,
        (SELECT count(*) FROM corpus c WHERE is_relevant AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.interaction_id = c.interaction_id)) AS n_missed,
        (SELECT count(*) FROM hits WHERE NOT is_relevant) AS n_false_positives,
        {rhu('(SELECT avg(reduction) FROM pl)', 6)} AS payload_reduction""",
    "agg_count_if": f"WITH {CORPUS} SELECT customer_id, count_if(is_relevant) AS n_relevant, count_if(NOT is_relevant) AS n_noise FROM corpus GROUP BY 1",
    "agg_count_distinct": f"WITH {CORPUS} SELECT count(DISTINCT customer_id) AS n_customers, count(*) AS n_rows FROM corpus",
    "agg_collect_history": f"""WITH {CORPUS}, p AS (SELECT customer_id, interaction_id,
          CAST((row_number() OVER (PARTITION BY customer_id ORDER BY interaction_id) - 1) // 100 AS INTEGER) AS page FROM corpus WHERE customer_id IS NOT NULL)
        SELECT customer_id, page, count(*) AS n_items, string_agg(CAST(interaction_id AS VARCHAR), ',' ORDER BY interaction_id) AS interaction_ids
        FROM p GROUP BY 1, 2""",
    "agg_concat_text": f"""WITH {CORPUS}, p AS (SELECT customer_id, interaction_id, text, CAST(coalesce(sum(length(text) + 1) OVER (
          PARTITION BY customer_id ORDER BY interaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 50000 AS INTEGER) AS page
          FROM corpus WHERE customer_id IS NOT NULL)
        SELECT customer_id, page, count(*) AS n_items, string_agg(text, ' ' ORDER BY interaction_id) AS payload,
          CAST(length(string_agg(text, ' ' ORDER BY interaction_id)) AS INTEGER) AS n_chars FROM p GROUP BY 1, 2""",
    "fn_list_slice": H + " SELECT customer_id, string_agg(CAST(interaction_id AS VARCHAR), ',' ORDER BY rank) AS top2 FROM hits WHERE rank <= 2 GROUP BY 1",
    "ret_keyword_baseline": f"WITH {CORPUS} " + " UNION ALL ".join(
        f"SELECT {q(kw)} AS keyword, count_if(contains(lower(text), {q(kw)})) AS n_matched, count(*) AS n_rows FROM corpus"
        for kw in ["network", "churn", "upgrade", "slow", "freezing", "bundle", "charged"]),
    "flt_like_ci": f"WITH {CORPUS} SELECT interaction_id, customer_id FROM corpus WHERE contains(lower(text), 'the')",
    "ret_multi_customer_probe": probe_sql() + " SELECT customer_id, rank, interaction_id, similarity FROM phits",
    "win_dedup_best_by_text": probe_sql() + f" SELECT interaction_id, customer_id, {rhu('sim', 4)} AS similarity, length(text) AS n_chars FROM top5",
    "topk_global": f"""WITH {CORPUS}, pv AS {query_sql(1)},
        scored AS (SELECT corpus.*, {sim_sql('embedding', 'pv.q')} AS sim FROM corpus CROSS JOIN pv)
        SELECT interaction_id, {rhu('sim', 4)} AS similarity FROM scored ORDER BY sim DESC, interaction_id LIMIT 5""",
    "set_token_overlap": probe_sql() + f""" SELECT interaction_id, array_to_string(list_sort(list_filter(list_distinct(
            list_intersect(list_filter(regexp_split_to_array(lower('poor internet speed and unreliable connection'), '{SPACE}'), lambda w: w <> ''),
                           list_filter(regexp_split_to_array(lower(regexp_replace(text, '[,.]', '', 'g')), '{SPACE}'), lambda w: w <> ''))),
            lambda w: w NOT IN ('and', 'the', 'a', 'is', 'it', 'my', 'i', 'to', 'in'))), ',') AS shared_words FROM top5""",
})

ORACLE["rule_retrieval_mode"] = (
    "WITH " + subscribers_sql("A") + ", " + H[len("WITH "):] + f""",
    lists AS (SELECT customer_id, count(*) AS n, arg_min(text, rank) AS top_text FROM hits GROUP BY 1)
    SELECT s.customer_id, CASE WHEN coalesce(l.n, 0) > 0 THEN 'vector_top' || l.n ELSE 'full_dump' END AS retrieval_mode,
           CASE WHEN coalesce(l.n, 0) > 0 THEN {redact_sql('l.top_text')} ELSE {redact_sql('s.transcript')} END AS transcript,
           CAST(coalesce(l.n, 0) AS INTEGER) AS n_retrieved
    FROM subs s LEFT JOIN lists l USING (customer_id)""")


# ---------------------------------------------------------------------------
# histories, context, grounding
# ---------------------------------------------------------------------------
SEQ = """seqd AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq FROM conversations)"""

ALLOWED = ("[CAST(overage AS BIGINT), CAST(days_renewal AS BIGINT), CAST(round_even(data_pct, 0) AS BIGINT), "
           "CAST(trunc(value_qar) AS BIGINT), CAST(round_even(data_used_gb, 0) AS BIGINT), CAST(data_cap_gb AS BIGINT), "
           "CAST(round_even(arpu, 0) AS BIGINT), CAST(voice_min AS BIGINT), CAST(nps AS BIGINT), CAST(tenure_m AS BIGINT), "
           "CAST(round_even(dl_speed, 0) AS BIGINT), CAST(latency_ms AS BIGINT), CAST(net_complaints AS BIGINT)]")


def bad_numbers_sql(text: str) -> str:
    conv = "TRY_CAST(CASE WHEN ltrim(translate(n, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '0') = '' THEN '0' " \
           "ELSE ltrim(translate(n, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '0') END AS BIGINT)"
    return (f"list_filter({numbers_sql(f'lower({text})')}, lambda n: {conv} IS NULL OR NOT coalesce(list_bool_or("
            f"list_transform({ALLOWED}, lambda a: a >= 0 AND abs({conv} - a) <= 1)), false))")


def grouped_sql() -> str:
    """proj_group_by_source: all fields, named by group and field."""
    from offerlens.plans.decision import SOURCE_GROUPS
    return ", ".join(f"{redact_sql('transcript') if f == 'transcript' else f} AS {g}_{f}" for g, fields in SOURCE_GROUPS.items() for f in fields)


def canned_sql(variant: str = "A") -> str:
    return f""", canned AS (SELECT *, {rationale_sql(variant)} AS why, {redact_sql('transcript')} AS msg FROM guarded),
grounded AS (SELECT *, {bad_numbers_sql("coalesce(why, '') || ' ' || coalesce(msg, '')")} AS bad FROM canned)"""


def grounding_sql(variant: str = "A") -> str:
    quote = "chr(39)"
    return canned_sql(variant) + f""" SELECT customer_id, len(bad) = 0 AS grounded,
        CASE WHEN len(bad) = 0 THEN 'ok' ELSE 'ungrounded number ' || {quote} || bad[1] || {quote} END AS reason FROM grounded"""


def adjudicate_sql(variant: str = "A") -> str:
    limit = "CASE channel WHEN 'SMS' THEN 160 WHEN 'Push' THEN 120 WHEN 'WhatsApp' THEN 300 WHEN 'Email' THEN 600 WHEN 'Call' THEN 400 END"
    accepted, rejected = ("claude", "offline") if variant == "A" else ("llm", "llm->fallback")
    return canned_sql(variant) + f""", adj AS (
        SELECT *, len(bad) = 0 AND {strip_sql("coalesce(why, '')")} <> '' AND
               coalesce(substring({strip_sql("coalesce(msg, '')")}, 1, {limit}), '') <> '' AS ok FROM grounded)
        SELECT customer_id, CASE WHEN ok THEN {strip_sql('why')} ELSE why END AS rationale,
               CASE WHEN ok THEN substring({strip_sql('msg')}, 1, {limit}) ELSE {message_sql('why', variant)} END AS message,
               CASE WHEN ok THEN '{accepted}' ELSE '{rejected}' END AS gen_source FROM adj"""


ORACLE.update({
    "win_seq_number": f"WITH {SEQ} SELECT conv_id, turn, seq, CAST(conv_id AS VARCHAR) || '-' || lpad(CAST(seq AS VARCHAR), CAST(greatest(2, length(CAST(seq AS VARCHAR))) AS INTEGER), '0') AS interaction_id FROM seqd",
    "win_stable_sample": """WITH h AS (SELECT conv_id, turn, coalesce(role = 'user', false) AS is_relevant,
          md5(CAST(conv_id AS VARCHAR) || '|history|' || CAST(turn AS VARCHAR)) AS h, md5(CAST(conv_id AS VARCHAR) || '|history-count') AS m
          FROM conversations),
        n AS (SELECT *, 5 + CAST(list_sum(list_transform(range(1, 5), lambda i: (strpos('0123456789abcdef', substr(m, i, 1)) - 1)
          * CAST(pow(16, 4 - i) AS INTEGER))) % 6 AS INTEGER) AS n_wanted,
          CAST(row_number() OVER (PARTITION BY conv_id, is_relevant ORDER BY h, turn) AS INTEGER) AS pick FROM h)
        SELECT conv_id, turn, is_relevant, pick, n_wanted FROM n
        WHERE pick <= CASE WHEN is_relevant THEN CASE WHEN n_wanted >= 6 THEN 3 ELSE 2 END
          ELSE n_wanted - CASE WHEN n_wanted >= 6 THEN 3 ELSE 2 END END""",
    "set_union_corpora": SUBS + ", " + SEQ + f"""
        SELECT CAST(conv_id AS VARCHAR) || '-' || lpad(CAST(seq AS VARCHAR), CAST(greatest(2, length(CAST(seq AS VARCHAR))) AS INTEGER), '0') AS interaction_id, conv_id AS customer_id,
               strftime(DATE '2024-01-31' - CAST(seq * 7 AS INTEGER), '%Y-%m-%d') AS date, false AS is_current,
               ['call', 'chatbot', 'social', 'complaint'][turn % 4 + 1] AS channel, role AS topic, role = 'user' AS is_relevant,
               length(text) AS n_chars FROM seqd
        UNION ALL
        SELECT CAST(customer_id AS VARCHAR) || '-transcript', customer_id, NULL, true, 'call', 'existing_transcript', true,
               length({strip_sql('transcript')}) FROM subs WHERE NOT {blank_sql('transcript')}""",
    "proj_context_struct": B() + f""" SELECT customer_id, action, action_type, propensity, value_qar, segment, ltv, lifecycle,
        account_type, language, tenure_m, churn, days_renewal, consent, arpu, arpu_trend, late_payments, data_cap_gb, data_used_gb,
        data_pct, overage, voice_min, intl_min, roaming_days, usage_trend, top_app, pct_5g, device, device_type, device_tier,
        net_cap AS network_capability, device_age, upgrade_eligible, last_upgrade_m, dl_speed AS dl_speed_mbps, dropped_call_rate,
        latency_ms, coverage AS coverage_score, congestion AS cell_congestion, net_complaints AS network_complaints_90d,
        net_issue AS network_issue, channel, app_logins, loyalty, last_campaign_resp, complaint, sentiment, nps,
        {redact_sql('transcript')} AS transcript, nbo_reason FROM decided""",
    "fn_to_json": A() + f" SELECT customer_id, {context_json_sql()} AS context_json FROM decided",
    "fn_to_json_indented": A() + f" SELECT customer_id, {indented_json_sql('A')} AS context_json FROM decided",
    "fn_to_json_indented_b": B() + f" SELECT customer_id, {indented_json_sql('B')} AS context_json FROM decided",
    "rule_prompt": A() + f" SELECT customer_id, {prompt_sql('A')} AS prompt FROM decided",
    "rule_prompt_b": B() + f" SELECT customer_id, {prompt_sql('B')} AS prompt FROM decided",
    "proj_group_by_source": A() + f" SELECT customer_id, {grouped_sql()} FROM decided",
    "rule_grounding": A() + grounding_sql("A"),
    "rule_grounding_b": B() + grounding_sql("B"),
    "rule_response_adjudicate": A() + adjudicate_sql("A"),
    "rule_response_adjudicate_b": B() + adjudicate_sql("B"),
})


# ---------------------------------------------------------------------------
# sinks, resume, streaming, extensions
# ---------------------------------------------------------------------------

def _hits_from(scored_expr: str, k: int = 3) -> str:
    return f"""WITH {CORPUS},
qv AS {query_sql(0)},
pv AS {query_sql(1)},
base AS (SELECT corpus.*, {sim_sql('embedding', 'qv.q')} AS s1, {sim_sql('embedding', 'pv.q')} AS s2 FROM corpus, qv, pv),
scored AS (SELECT *, {scored_expr} AS sim FROM base),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY sim DESC, interaction_id) AS INTEGER) AS rank FROM scored WHERE sim IS NOT NULL)
SELECT customer_id, rank, interaction_id, channel, date, {rhu('sim', 4)} AS similarity, {rhu('1e0 - sim', 4)} AS distance
FROM ranked WHERE rank <= {k}"""


_CHUNKS = f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, words, len(words) AS n, generate_series(0, greatest(len(words) - 1, 0), 160) AS starts FROM w),
c AS (SELECT doc_id, list_filter(list_transform(starts, lambda st: array_to_string(list_slice(words, st + 1, st + 200), ' ')),
             lambda ch, i: i = 1 OR (i - 1) * 160 + 200 - 160 < n) AS chunks FROM s)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_no, length(chunks[i]) AS n_chars, md5(chunks[i]) AS h
FROM c, (SELECT unnest(generate_series(1, len(chunks))) AS i) g"""

ORACLE.update({
    "src_csv_scan": ORACLE["agg_argmax_offer"],
    "sink_csv": ORACLE["proj_rename"],
    "sink_export_detail": A() + f" SELECT customer_id, action, guard_status, {rhu('p_baseline', 6)} AS p_baseline, {rhu('p_treated', 6)} AS p_treated FROM detail2",
    "sink_separate_outputs": (
        "SELECT 'A' AS variant, * FROM (" + ORACLE["agg_summary_long"] + ") UNION ALL SELECT 'B' AS variant, * FROM ("
        + ORACLE["agg_summary_long_b"] + ")"),
    "src_stage_resume": ORACLE["proj_select_cols"],
    "src_upsert_reset": f"WITH {WHOLE_CORPUS} SELECT interaction_id, customer_id, channel, date, is_relevant, embedding, text FROM corpus",
    "emb_batch_write": f"WITH {WHOLE_CORPUS} SELECT interaction_id, customer_id, CAST(len(embedding) AS INTEGER) AS dim, is_relevant FROM corpus",
    "ext_stream_embed": "SELECT DISTINCT event_id, user_id, CAST(64 AS INTEGER) AS dim FROM events",
    "ext_sim_threshold": _hits_from("CASE WHEN s1 >= 0.15e0 THEN s1 END"),
    "ext_multi_query": _hits_from("(s1 + s2) / 2e0"),
    "ext_recency_decay": _hits_from("s1 * exp(-0.01e0 * date_diff('day', CAST(date AS DATE), DATE '2024-01-31'))"),
    "ext_scope_filter": H + " SELECT count(*) AS n_hits, count_if(c.customer_id <> h.customer_id) AS n_crossing FROM hits h JOIN corpus c USING (interaction_id)",
    "ext_chunk_text": _CHUNKS,
    "ext_persist_vectors": SCOPED + f" SELECT customer_id, interaction_id, {rhu('sim', 6)} AS sim FROM scored",
})


# ---------------------------------------------------------------------------
# model, embedding, approximate retrieval, generation: what SQL can say of them
# ---------------------------------------------------------------------------
_CATEGORIES = ["shown_offer", "segment", "ltv", "lifecycle", "account_type", "usage_trend", "arpu_trend", "device",
               "device_type", "device_tier", "net_cap", "channel", "loyalty", "last_campaign_resp", "top_app", "sentiment"]
_NUMBERS = ["shown_value", "tenure_m", "churn", "days_renewal", "data_cap_gb", "data_used_gb", "data_pct", "overage",
            "voice_min", "intl_min", "roaming_days", "pct_5g", "arpu", "late_payments", "outstanding", "dunning", "device_age",
            "upgrade_eligible", "last_upgrade_m", "dl_speed", "dropped_call_rate", "latency_ms", "coverage", "congestion",
            "net_complaints", "net_issue", "app_logins", "consent", "nps"]
_HISTORY = f"""hist AS (SELECT conv_id AS customer_id FROM conversations
    UNION ALL SELECT customer_id FROM subs WHERE NOT {blank_sql('transcript')})"""

ORACLE.update({
    "ml_onehot": SUBS + ", n AS (SELECT " + " + ".join(f"count(DISTINCT {x})" for x in _CATEGORIES) + f" + {len(_CATEGORIES)} + {len(_NUMBERS)} AS n FROM subs) "
                 f"SELECT customer_id, CAST(n AS INTEGER) AS n_features, CAST({len(_CATEGORIES)} + "
                 + " + ".join(f"CASE WHEN {x} <> 0 THEN 1 ELSE 0 END" for x in _NUMBERS) + " AS INTEGER) AS n_nonzero FROM subs, n",
    "ml_gbt_fit_check": "SELECT count(*) > 0 AS fitted, 100 AS n_trees, true AS beats_constant, true AS walk_equals FROM customer",
    "emb_precision_check": "SELECT count(DISTINCT conv_id) AS n_customers, true AS same_customers, true AS in_range FROM conversations",
    "ml_gbt_nodes_check": "SELECT CAST(tree AS INTEGER) AS tree, true AS binary, true AS rooted FROM range(100) t(tree)",
    "ml_score_pairs_check": SUBS + " SELECT customer_id, 10 AS n_offers, 10 AS n_in_range, 45 AS sum_offer_ord FROM subs",
    "ml_recommend_check": SUBS + " SELECT customer_id, true AS is_best, true AS is_first FROM subs",
    "emb_embed_check": SUBS + ", " + _HISTORY + " SELECT customer_id, count(*) AS n, count(*) AS n_sound FROM hist GROUP BY 1",
    "ret_bulk_context_check": SUBS + ", " + _HISTORY + """, k AS (SELECT customer_id, least(3, count(*)) AS n FROM hist GROUP BY 1)
        SELECT customer_id, CASE WHEN n > 0 THEN 'vector_top' || n ELSE 'full_dump' END AS retrieval_mode,
               CAST(coalesce(n, 0) AS INTEGER) AS n_retrieved FROM subs LEFT JOIN k USING (customer_id)""",
    "ret_ann_check": f"WITH {CORPUS} SELECT customer_id, least(3, count(*)) AS n_hits, true AS recall_ok FROM corpus GROUP BY 1",
    "gen_batch_complete": A() + f""", g AS (SELECT *, length({prompt_sql()}) % 3 <> 0 AS ok FROM guarded)
        SELECT customer_id AS msisdn, action, action_type, channel, sentiment,
               CASE WHEN ok THEN 'Selected: ' || action || '.' ELSE {rationale_sql('A')} END AS rationale_why,
               CASE WHEN ok THEN replace(action, '_', ' ') || ' is ready for you' ELSE {message_sql(rationale_sql('A'), 'A')} END AS message_how,
               guard_status, CASE WHEN ok THEN 'claude' ELSE 'offline' END AS gen_source FROM g""",
})

ORACLE["pipe_run_retrieval"] = A() + ", " + H[len("WITH "):].replace("scored", "hit_scores").replace("ranked", "hit_ranks") + f""",
    lists AS (SELECT customer_id, count(*) AS n, arg_min(text, rank) AS top_text,
              string_agg(date || '|' || channel, ',' ORDER BY rank) AS retrieved FROM hits GROUP BY 1)
    SELECT g.customer_id, guard_status, action, propensity,
           CASE WHEN coalesce(l.n, 0) > 0 THEN 'vector_top' || l.n ELSE 'full_dump' END AS retrieval_mode,
           CASE WHEN coalesce(l.n, 0) > 0 THEN {redact_sql('l.top_text')} ELSE {redact_sql('g.transcript')} END AS transcript,
           coalesce(retrieved, '') AS retrieved
    FROM guarded g LEFT JOIN lists l USING (customer_id)"""
ORACLE["pipe_run_model"] = " UNION ALL ".join(
    f"SELECT '{name}' AS output, count(*) AS n_rows, count(DISTINCT c_custkey) AS n_keys FROM customer"
    for name in ("campaign_triggers", "contexts", "experience", "evaluation_detail")) + \
    " UNION ALL SELECT 'summary', 6, 6"
