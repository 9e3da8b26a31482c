"""Fixed values that must equal the reference's for matching results.

Everything here is data (weights, cut points, word lists, labels), kept
together in natural order so it can be checked at a glance.
"""

# ---- fixed values: customer importance weights ----------------------------
CIS_WEIGHTS = {
    "ltv_norm": 0.30,
    "order_norm": 0.20,
    "repeat": 0.15,
    "verified": 0.10,
    "helpful_norm": 0.10,
    "recency_score": 0.15,
}

# ---- fixed values: product priority weights -------------------------------
PPS_WEIGHTS = {
    "freq": 0.25,
    "order": 0.20,
    "repeat": 0.20,
    "rating_drop": 0.20,
    "negative": 0.15,
}

# ---- fixed values: severity mix --------------------------------------------
SEVERITY_RATING_WEIGHT = 0.6
SEVERITY_SENTIMENT_WEIGHT = 0.4

# ---- fixed values: thresholds -----------------------------------------------
NEGATIVE_FLAG_MAX_RATING = 2.0      # is_negative: rating <= 2
RISKY_MAX_RATING = 2.5              # negative ratio / revenue at risk: rating <= 2.5
IMPACT_GATE_MAX_RATING = 3.0        # impact only when rating <= 3
COMPLAINT_MAX_RATING = 3.0          # issue breakdown: rating <= 3
RECENCY_PLATEAU_DAYS = 10.0
RECENCY_DECAY_DAYS = 30.0
MINMAX_EPS = 1e-9
QUADRANT_QUANTILE = 0.75
RATING_QUANTILE_LOW = 0.25
RESPOND_NEGATIVE_RATIO = 0.3
SPIKE_WINDOW_DAYS = 14
SPIKE_RECENT_DIVISOR = 2.14
SPIKE_SPREAD_DIVISOR = 4.3
SPIKE_THRESHOLD = 2.0
SPIKE_MULTIPLIER = 1.5
IMPACT_PCT_REVENUE_SCALE = 100000.0
ISSUE_SPLIT = [("delivery", 0.25), ("quality", 0.35), ("packaging", 0.20), ("support", 0.20)]
INSIGHT_TOP_N = 5

# ---- fixed values: sentiment maps ------------------------------------------
# severity side (negative is worst)
SENTIMENT_SEVERITY = {"negative": 1.0, "neutral": 0.5, "positive": 0.0}
# classic feature side (positive is best)
SENTIMENT_SCORE = {"positive": 1.0, "neutral": 0.5, "negative": 0.0}
SENTIMENT_DEFAULT = 0.5

# ---- fixed values: issue keywords, in priority order ----------------------
ISSUE_KEYWORDS = [
    ("Delivery", ["deliver", "shipping", "shipment", "late", "delay", "transit",
                  "arrived", "arrival", "courier", "dispatch", "package", "tracking"]),
    ("Quality", ["quality", "broken", "defective", "damaged", "poor quality",
                 "bad quality", "stopped working", "not working", "faulty",
                 "material", "build", "durability", "fragile", "fell apart"]),
    ("Service", ["customer service", "support", "refund", "return", "staff",
                 "response", "helpless", "unhelpful", "rude", "complaint",
                 "exchange", "replacement", "contacted", "no response"]),
    ("Pricing", ["price", "expensive", "overpriced", "cheap", "cost", "value",
                 "worth", "money", "charge", "fee", "afford"]),
]
ISSUE_OTHER = "Other"
ISSUE_CATEGORIES = [name for name, _ in ISSUE_KEYWORDS] + [ISSUE_OTHER]

# ---- fixed values: quadrants and actions -----------------------------------
FIRE_FIGHT = "The Fire-Fight"
VIP_NUDGE = "The VIP Nudge"
SLOW_BURN = "The Slow Burn"
NOISE = "The Noise"
QUADRANT_ACTIONS = {
    FIRE_FIGHT: "Immediate Fix Required",
    VIP_NUDGE: "High-Value Outreach",
    SLOW_BURN: "Product Experience Gap",
    NOISE: "Monitor / Backlog",
}

# ---- fixed values: classic decisions ---------------------------------------
DECISION_FIX = "Immediate Fix Required"
DECISION_INVESTIGATE = "Investigate Root Cause"
DECISION_IMPROVE = "Improve Product Experience"
DECISION_RESPOND = "Respond to Customers"
DECISION_MONITOR = "Monitor"

# ---- fixed values: risk cut presets (low/medium upper bounds) -------------
RISK_CUTS_MODEL = (0.3, 0.7)       # probability -> Low (<=.3) / Medium (<=.7) / High
RISK_BANDS_CHART = (0.4, 0.7)      # >= .7 High, >= .4 Medium, else Low
RISK_BANDS_CLIENT = (0.55, 0.75)   # client colours
SEVERITY_BANDS = (0.4, 0.7)        # dashboard severity from normalised score

# ---- fixed values: schema alias lists (first present alias wins) ----------
DASHBOARD_ALIASES = {
    "rating": ["rating", "stars", "review_rating", "score", "rating_score", "star_rating"],
    "review_text": ["review_text", "review", "text", "comment", "feedback", "message"],
    "sentiment": ["sentiment", "sentiment_label", "sentiment_type", "tone", "opinion"],
    "sentiment_score": ["sentiment_score", "sentiment_val", "polarity", "polarity_score"],
    "customer_ltv": ["customer_ltv", "ltv", "customer_value", "lifetime_value", "ltv_value"],
    "product": ["product", "product_name", "product_id", "item", "item_name", "sku"],
    "order_value": ["order_value", "order_val", "purchase_amount", "transaction_amount"],
    "days_since_purchase": ["days_since_purchase", "age_in_days", "days_old", "age"],
    "helpful_votes": ["helpful_votes", "helpful_count", "upvotes", "like_count"],
    "is_repeat_customer": ["is_repeat_customer", "repeat_customer", "returning",
                           "returning_customer"],
    "verified_purchase": ["verified_purchase", "verified", "authentic"],
}
SERVICE_PRODUCT_ALIASES = ["product_name", "product_id"]
SERVICE_RATING_ALIASES = ["score", "stars", "review_rating"]
REQUIRED_ALIASES = {
    "product": ["product", "product_name", "product_id"],
    "rating": ["rating", "score", "stars", "review_rating"],
}

# ---- fixed values: robust schema and defaults -------------------------------
ROBUST_SCHEMA = {
    "rating": "float",
    "sentiment_score": "float",
    "customer_ltv": "float",
    "order_value": "float",
    "repeat": "int",
    "verified": "int",
    "helpful_votes": "int",
    "days_since_purchase": "int",
    "detected_issues": "str",
}
ROBUST_DEFAULTS = {
    "rating": 3.0,
    "sentiment_score": 0.5,
    "customer_ltv": 0.0,
    "order_value": 0.0,
    "repeat": 0,
    "verified": 0,
    "helpful_votes": 0,
    "days_since_purchase": 30,
    "detected_issues": "unknown",
}
ROBUST_RANGES = {"rating": (1.0, 5.0), "sentiment_score": (0.0, 1.0)}

# ---- fixed values: service profile defaults --------------------------------
SERVICE_DEFAULTS = {
    "rating": 3.0,
    "customer_ltv": 1000.0,
    "order_value": 0.0,
    "helpful_votes": 0.0,
    "days_since_purchase": 30.0,
    "is_repeat_customer": False,
    "verified_purchase": True,
    "product": "Unknown Product",
    "review_text": "",
}

# ---- fixed values: ML feature list (order matters) ------------------------
ML_FEATURES = [
    "avg_severity", "negative_ratio", "total_impact", "total_reviews", "repeat_rate",
    "avg_order_value", "rating_drop", "recency_score", "impact_per_review",
    "severity_impact", "review_velocity",
]
ML_CRITICAL = ["total_impact", "negative_ratio", "total_reviews", "avg_order_value"]

# ---- fixed values: notes and cuts of the client's KPI row ----
NEGATIVE_BASELINE = 0.22
HIDDEN_RISK_MIN = 0.7
