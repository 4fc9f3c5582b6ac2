"""Fixed values that must equal the decisioning rules being reproduced.

Everything in this module is a fixed value (catalogue, domains, limits,
thresholds and text templates). They are stated plainly, in natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: offer catalogue, in catalogue order (name, action type, monthly price)
# ---------------------------------------------------------------------------
OFFERS = [
    ("10GB_Aggressive_HVC", "Retention", 120.0),
    ("1GB_plus_100mins", "NBO", 40.0),
    ("200mins_Upsell", "Upsell", 35.0),
    ("Home_Free_OoredooTV", "CrossSell", 150.0),
    ("Roaming_Daily_Pass", "CrossSell", 60.0),
    ("5G_Unlimited_Upgrade", "Upsell", 200.0),
    ("Retention_Save_25pct", "Retention", 90.0),
    ("Data_AddOn_5GB", "NBO", 50.0),
    ("Device_Upgrade_iPhone", "Upsell", 280.0),
    ("Loyalty_Points_2x", "Retention", 0.0),
]

# FIXED VALUES: channel length limits (code points)
CHANNEL_LIMITS = {"SMS": 160, "Push": 120, "WhatsApp": 300, "Email": 600, "Call": 400}

# FIXED VALUES: categorical domains
CHANNELS = ["SMS", "Push", "Email", "Call", "WhatsApp"]
ACCOUNT_TYPES = ["Postpaid", "Prepaid", "Hybrid"]
LOYALTY_TIERS = ["None", "Silver", "Gold", "Platinum"]
DEVICES = ["iPhone 14", "iPhone 15", "Galaxy S23", "Galaxy A54", "Pixel 8", "Huawei P60", "Other"]
FLAGSHIP_DEVICES = ["iPhone 15", "Galaxy S23", "Pixel 8", "Huawei P60"]
MID_DEVICES = ["iPhone 14", "Galaxy A54"]
LOW_END_DEVICE_TYPES = ["Feature Phone", "IoT"]
TOP_APPS = ["YouTube", "TikTok", "Instagram", "WhatsApp", "Netflix", "Gaming", "Snapchat"]
PAYMENT_METHODS = ["Autopay_Card", "Manual_Card", "Cash", "Bank_Transfer"]
CAMPAIGN_RESPONSES = ["Accepted", "Ignored", "Rejected", "None"]
INTERACTION_CHANNELS = ["call", "chatbot", "social", "complaint"]

# FIXED VALUES: transcript sentinel for "no contact" and the redaction token
NO_CONTACT = "no recent call-center contact"
REDACTED = "[REDACTED]"

# FIXED VALUES: guard statuses
GUARD_BLOCKED = "BLOCKED_NO_CONSENT"
GUARD_SOFTENED = "SOFTENED"
GUARD_CREDIT = "REVIEW_CREDIT"
GUARD_HOLD = "NETWORK_HOLD"
GUARD_APPROVED = "APPROVED"

# FIXED VALUES: generation source tags per variant
SOURCE_TAGS = {
    "A": {"accepted": "claude", "rejected": "offline", "disabled": "offline"},
    "B": {"accepted": "llm", "rejected": "llm->fallback", "disabled": "offline"},
}

# FIXED VALUES: retrieval
QUERY_TEXT = "customer complaints, churn signals, network issues, upgrade interest"
PROBE_TEXT = "poor internet speed and unreliable connection"
OVERLAP_STOPWORDS = ["and", "the", "a", "is", "it", "my", "i", "to", "in"]
BASELINE_KEYWORDS = ["network", "churn", "upgrade", "slow", "freezing", "bundle", "charged"]

# FIXED VALUES: evaluation
BASELINE_FACTOR = 0.85
MONTHS = 12
EXTRAPOLATE_TO = [500_000, 2_000_000]
PROB_CAP = 0.95
LIFT_CAP = 1.55

# Brand line appended to channel templates (a parameter of the message rule).
DEFAULT_BRAND = "YourTelco"
