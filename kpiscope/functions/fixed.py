"""Fixed values.

Everything in this module must equal the values of the system whose results
are reproduced (word lists, thresholds, calendars, message formats). They are
stated here plainly, in their natural order, and nowhere else.
"""

# ---------------------------------------------------------------- fixed values
# KPI names, in the order the request extractor scans for them.
KPI_SCAN_ORDER = [
    "gmv", "order_count", "aov", "conversion_rate",
    "refund_rate", "new_customer_ratio", "revenue", "cancellation_rate",
]

# Analysis dimensions, in plan order (also the scan order of the extractor).
DIMENSIONS = ["channel", "region", "category", "customer_type", "payment_type", "campaign"]
DEFAULT_DIMENSIONS = ["channel", "region", "category"]

# Views an analyst may query.
VIEW_NAMES = [
    "daily_kpi_summary", "fact_orders_enriched", "channel_performance",
    "category_performance", "region_performance", "customer_segment_performance",
    "refund_summary",
]

# Tables and views a submitted SQL text may reference.
ALLOWED_TABLES = [
    "orders", "order_items", "products", "customers", "payments", "channels",
    "regions", "campaigns", "refunds", "daily_kpi_summary", "fact_orders_enriched",
    "refund_summary", "channel_performance", "category_performance",
    "region_performance", "customer_segment_performance",
]

# Write / DDL / admin keywords refused in SQL text (whole words, any case).
FORBIDDEN_KEYWORDS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "REPLACE",
    "COPY", "ATTACH", "DETACH", "EXPORT", "IMPORT", "GRANT", "REVOKE", "EXEC",
    "EXECUTE", "CALL", "MERGE", "UPSERT",
]

MAX_SQL_ROWS = 10_000               # row cap appended to SQL without LIMIT
MIN_SLICE_SAMPLE = 30               # small-sample threshold per window
CONCENTRATION_PCT = 50.0            # top slice share above which a move is concentrated
DEFAULT_BASELINE_DAYS = 14          # minimum default baseline length
MAX_RETRIES = 2                     # extra investigation passes when unsupported
MAX_INVESTIGATION_SECONDS = 120.0   # cost trigger for review
MIN_SUPPORTING_EVIDENCE = 2
CAUSE_HIT_THRESHOLD = 0.25
RETRIEVAL_TOP_K = 5
CHART_TOP_N = 10
REPORT_DRIVER_ROWS = 8
REPORT_RESULT_ROWS = 10

# Okapi BM25 parameters and the floor for negative idf (share of mean idf).
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# Cause normaliser: stop words, then suffixes tried in this order.
STOP_WORDS = [
    "the", "is", "in", "of", "a", "an", "to", "by", "and", "or",
    "for", "was", "be", "as", "at", "on", "that", "this", "from", "with",
]
SUFFIXES = ["ing", "ed", "tion", "sion", "ment", "ness", "ous", "ive", "ly", "es", "s"]

# Campaign calendar by purchase date.
#   March-April spring_sale, June-July summer_blast, August back_to_school,
#   September-October fall_promo, November 20-30 black_friday,
#   December holiday_special, otherwise none.
CAMPAIGNS = ["none", "spring_sale", "summer_blast", "back_to_school",
             "fall_promo", "black_friday", "holiday_special"]

# Seasonal volume index: month factor, times the weekend factor on Sat/Sun.
MONTH_FACTORS = {1: 0.85, 2: 0.88, 3: 0.95, 4: 1.0, 5: 1.02, 6: 1.05,
                 7: 1.0, 8: 0.98, 9: 1.05, 10: 1.08, 11: 1.25, 12: 1.40}
WEEKEND_FACTOR = 0.82

# Confidence and review vocabulary.
CONFIDENCE_LEVELS = ["high", "medium", "low", "inconclusive"]
REVIEW_STATUSES = ["not_required", "pending", "approved", "rejected"]
REVIEW_TRIGGERS = ["low_confidence", "sql_validation_failure", "cost_exceeded", "weak_evidence"]

CHECK_NAMES = ["sql_evidence_exists", "analysis_results_exist", "supporting_evidence",
               "concentrated_driver_found", "sample_size_adequate"]

CAVEAT_CORRELATION = "Analysis is based on observed correlations, not causal inference."
CAVEAT_SMALL_SAMPLE = "Some dimension slices have small sample sizes."

# Message and text formats (printf style, as passed to format_string).
MSG_EMPTY_SQL = "Empty SQL query"
MSG_MULTIPLE_STATEMENTS = "Multiple SQL statements are not allowed (semicolons found in query body)"
MSG_ONLY_SELECT = "Only SELECT queries are allowed. Found: %s"
MSG_FORBIDDEN_KEYWORDS = "Forbidden SQL keywords found: %s"
MSG_TABLE_NOT_APPROVED = "Table '%s' is not in the approved list. Allowed: %s"
TXT_SQL_EVIDENCE = "%s — %d rows returned"
TXT_ANALYSIS_EVIDENCE = "%s analysis: top driver is '%s' with %s%% contribution (%s%% change). Concentrated: %s"
TXT_SAMPLE_WARNING = "Sample size warning: %s"
TXT_SMALL_SAMPLE = "Small sample: %s (baseline=%d, anomaly=%d)"
TXT_BASELINE_EVIDENCE = "Aggregate order_total: baseline_daily=%s, anomaly_daily=%s, change=%s%%"
TXT_CHECK_SQL = "%d successful SQL queries out of %d"
TXT_CHECK_ANALYSES = "%d analysis results produced"
TXT_CHECK_SUPPORT = "%d supporting evidence items"
TXT_CHECK_CONCENTRATED = "Concentrated driver found"
TXT_CHECK_DIFFUSE = "No single dominant driver — movement may be diffuse"
TXT_CHECK_WARNINGS = "%d sample size warnings"
TXT_CHECK_SAMPLES_OK = "All slices have adequate sample sizes"
TXT_FINDING = "The %s movement is primarily driven by '%s' in the %s dimension (%s%% change, %s%% contribution)."
TXT_CONCLUSION = ("Evidence suggests the %s anomaly is primarily driven by changes in '%s' (%s). "
                  "This slice accounts for %s%% of the total movement. Confidence: %s.")
TXT_CONCLUSION_DIFFUSE = ("The %s movement could not be attributed to a single dominant driver. "
                          "The change appears diffuse across multiple dimensions. Confidence: inconclusive.")
TXT_CONCENTRATION = "Top %d slice(s) explain %s%% of total change"
TXT_NO_CHANGE = "No significant change detected"
TXT_PURPOSE_AGGREGATE = "Aggregate %s for anomaly vs baseline window"
TXT_PURPOSE_BREAKDOWN = "Break down %s by %s"
# ------------------------------------------------------------ end fixed values
