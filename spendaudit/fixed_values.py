"""Lists, formats and constants that the results depend on.

Nothing here is logic. Every value is stated as text so that a reader can compare it with the
published rules of the screening method. Message formats use ``{name}`` for the inserted value.
"""

# --- fixed values: chambers -------------------------------------------------------------------
LOWER_HOUSE = "Lok Sabha"
UPPER_HOUSE = "Rajya Sabha"
HOUSE_CODES = {"LS": LOWER_HOUSE, "RS": UPPER_HOUSE}
STAGE_CODES = {"recommended": "REC", "sanctioned": "SANC", "completed": "COMP", "expenditure": "EXP"}

# --- fixed values: raw file names -------------------------------------------------------------
RAW_FOLDERS = {"LS": "lok_sabha", "RS": "rajya_sabha"}
RAW_FILES = {
    "recommended": "Works Recommended.csv",
    "sanctioned": "Works Sanctioned.csv",
    "expenditure": "Expenditure on Completed and On-going Works as on Date.csv",
    "completed": "Works Completed.csv",
    "allocation": "Allocated Limit for Honble MPs.csv",
    "calamity": "Amount consented for Calamity.csv",
}

# --- fixed values: headers of the raw files -----------------------------------------------------
WORK_COLUMNS = {
    "recommended": ["WORK", "Work"], "sanctioned": ["Work"], "completed": ["Work"], "expenditure": ["Work ID"],
}
DATE_COLUMNS = {
    "recommended": "Recommended date", "sanctioned": "Sanction Date",
    "completed": "Completion Date", "expenditure": "Expenditure Date",
}

# --- fixed values: text cleaning --------------------------------------------------------------
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# every character that counts as white space
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
TOTAL_ROW_PATTERN = r"(?i)^\s*(Grand\s+Total|Total)\b"
CURRENCY_PATTERN = r"[,₹]|Rs\.?"
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# what may follow a date: a time of day, with or without seconds, half of the day and zone
TIME_OF_DAY_PATTERN = r"(?i)[ T]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[AP]M)?( ?(Z|UTC|[+-]\d{2}:?\d{2}))?$"
# shape of a date text, and the formats to try on it in order
DATE_SHAPES = [
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", ["d-MMM-yyyy"]),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", ["d-MMM-yy"]),
    (r"^\d{1,2}-[A-Za-z]{4,9}-\d{4}$", ["d-MMMM-yyyy"]),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", ["d MMM yyyy"]),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", ["d MMMM yyyy"]),
    (r"^[A-Za-z]{3} \d{1,2}, ?\d{4}$", ["MMM d, yyyy", "MMM d,yyyy"]),
    (r"^[A-Za-z]{4,9} \d{1,2}, ?\d{4}$", ["MMMM d, yyyy", "MMMM d,yyyy"]),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ["yyyy-M-d"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ["yyyy/M/d"]),
    (r"^\d{8}$", ["yyyyMMdd"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["M-d-yyyy", "d-M-yyyy"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["M/d/yyyy", "d/M/yyyy"]),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", ["M.d.yyyy", "d.M.yyyy"]),
]
WORK_ID_PATTERNS = [
    r"(?i)\b(WS\s*/\s*MP\s*\d+\s*/\s*\d{4}-\d{4}\s*/\s*\d+)\b",
    r"(?i)\b(WS\s*/\s*MP\s*\d+\s*/\s*\d{4}\s*/\s*\d+)\b",
    r"(?i)\b(WS\s*/\s*[A-Z0-9_]+\s*/\s*[0-9\-]+\s*/\s*\d+)\b",
]
HONORIFIC_PATTERN = r"(?i)^(Shri|Smt\.|Smt|Dr\.|Dr|Hon'ble|Honble)\s+"
TERM_PATTERN = r"\s*\(\d{4}-\d{2}\).*$"
UNKNOWN_MEMBER = "Unknown MP"
UNKNOWN_STATE = "Unknown State"
STATE_SPELLINGS = {
    "Andaman & Nicobar Islands": "Andaman And Nicobar Islands",
    "Dadra & Nagar Haveli": "Dadra And Nagar Haveli",
    "Jammu & Kashmir": "Jammu And Kashmir",
    "Odisha": "Odisha",
    "Orissa": "Odisha",
}
STATE_DISPLAY = {
    "Jammu And Kashmir": "Jammu & Kashmir",
    "Andaman And Nicobar Islands": "Andaman & Nicobar Islands",
}
DEFAULT_CATEGORY = "Normal/Others"
DEFAULT_STATUS = "Sanctioned"
DEFAULT_VENDOR = "Unknown Vendor"
DEFAULT_PAYMENT_STATUS = "Completed"
CREATED_BY_COMPLETION_STATUS = "Work Completed"
CREATED_BY_PAYMENT_STATUS = "In Progress"
UNASSIGNED_PREFIX = "UNASSIGNED_"
NOT_AVAILABLE = "Data Not Available"

# --- fixed values: lifecycle labels -----------------------------------------------------------
LIFECYCLE_COMPLETED = "Sanctioned & Completed"
LIFECYCLE_IN_PROGRESS = "Sanctioned & In Progress"
LIFECYCLE_PENDING_PAYMENT = "Sanctioned (Pending Disbursal)"
LIFECYCLE_PENDING_SANCTION = "Recommended (Pending Sanction)"
LIFECYCLE_GAP = "Lifecycle Data Gap"

# --- fixed values: audit rule messages --------------------------------------------------------
MSG_DUPLICATE_RECORDS = (
    "Potential Duplicate Transaction Records: {records} excess ledger record(s) across "
    "{groups} identical attribute group(s)"
)
MSG_DUPLICATE_AMOUNT = ", representing ₹{amount} in excess-record amount"
MSG_EXPENDITURE_OVER = (
    "Critical Financial Control: Total expenditure (₹{spent}) exceeds sanction (₹{sanctioned}) by ₹{excess}"
)
MSG_COMPLETION_OVER = (
    "Financial Control Anomaly: Completion amount (₹{completed}) exceeds sanction (₹{sanctioned}) by ₹{excess}"
)
MSG_SANCTION_BEFORE_RECOMMENDATION = (
    "Impossible Chronology: Sanction date is earlier than Recommendation date"
)
MSG_PAYMENT_BEFORE_SANCTION = (
    "Impossible Chronology: First Expenditure date is earlier than Sanction date"
)
MSG_COMPLETION_BEFORE_SANCTION = (
    "Impossible Chronology: Completion date is earlier than Sanction date"
)
MSG_LONG_APPROVAL = (
    "Process Inefficiency: Recommendation-to-Sanction duration ({days} days) exceeds "
    "95th percentile ({limit} days)"
)
MSG_LONG_COMPLETION = (
    "Process Inefficiency: Sanction-to-Completion duration ({days} days) exceeds "
    "95th percentile ({limit} days)"
)
MSG_FRAGMENTATION = (
    "Unusual Payment Fragmentation: Payment count ({payments} disbursements) exceeds "
    "97th percentile threshold ({limit})"
)
MSG_VENDOR = (
    "Vendor Concentration Risk: Top vendor captures {percent}% of total work expenditure "
    "across {payments} payments"
)
MSG_OUTLIER_PREFIX = "Amount Outlier: "
MSG_OUTLIER_SANCTION = "sanctioned amount (₹{amount}) Robust Z = {z}"
MSG_OUTLIER_EXPENDITURE = "total expenditure (₹{amount}) Robust Z = {z}"
MSG_OUTLIER_SUFFIX = ". Values are unusually high relative to the defined peer group."
MSG_DORMANT = (
    "Dormant Sanctioned Work: Work sanctioned over 180 days ago with zero expenditure and zero completion"
)
MSG_ML_STRONG = (
    "ML Supporting Signal: Isolation Forest anomaly percentile is {percentile}%, placing this work "
    "among the rarest feature combinations in the evaluated population"
)
MSG_ML_WEAK = (
    "ML Supporting Signal: Isolation Forest anomaly percentile is {percentile}%, indicating a "
    "relatively unusual feature combination"
)
MSG_PEER_SANCTION = (
    "Peer Statistical Signal: Sanctioned amount has robust Z-score {z} relative to its defined peer group"
)
MSG_PEER_EXPENDITURE = (
    "Peer Statistical Signal: Total expenditure has robust Z-score {z} relative to its defined peer group"
)
MSG_NORMAL = (
    "Normal Work: No deterministic audit rule or supporting statistical/ML risk signal exceeded "
    "the configured thresholds"
)
RISK_LEVELS = ["NORMAL", "REVIEW", "HIGH", "CRITICAL"]

# --- fixed values: duplicate-work screening ---------------------------------------------------
DESCRIPTION_STOP_WORDS = [
    "construction", "of", "the", "a", "an", "at", "in", "for", "near", "village", "ward", "gram",
    "panchayat", "road", "building", "repair", "renovation", "upgradation", "providing",
    "installation", "to", "and", "works", "work", "with", "under", "scheme", "improvement",
    "development", "area", "block", "district",
]
PAIR_LABELS = {"A": "Potential Duplicate", "B": "Possible Duplicate"}
PAIR_FIELDS_EXACT = [
    "Same MP", "Identical description", "Same sanctioned amount", "Same sanction date",
]
PAIR_FIELDS_SIMILAR = [
    "Same MP", "Similar description", "Similar sanctioned amount", "Close sanction date",
]
PAIR_FIELD_CONSTITUENCY = "Same constituency"
PAIR_ACTION = (
    "Verify whether these two sanctioned works represent separate physical assets, or a "
    "duplicate/erroneous entry."
)
BATCH_NOTE = (
    "Multiple works share identical description, sanctioned amount, and sanction date. This commonly "
    "reflects a single scheme sanctioned as several identical units, not a duplicate claim. Verify "
    "that the claimed unit count matches units actually delivered."
)
DISCLAIMER = (
    "This is a screening signal generated from available data. It does not establish fraud or "
    "wrongdoing and requires human audit verification."
)

# --- fixed values: overruns -------------------------------------------------------------------
BASIS_COMPLETION = "completion_amount_vs_sanctioned_amount"
BASIS_EXPENDITURE = "expenditure_to_date_vs_sanctioned_amount"

# --- fixed values: compliance checks ----------------------------------------------------------
CHECK_RECOMMENDED = "Recommendation available"
CHECK_NOT_RECOMMENDED = "Recommendation not available"
CHECK_SANCTIONED = "Sanction available"
CHECK_NOT_SANCTIONED = (
    "Sanction not yet recorded for this work — it is at the recommendation stage; downstream checks "
    "are not applicable until a sanction is issued"
)
CHECK_PAID = "Payment/expenditure linked"
CHECK_NOT_PAID = "No payment/expenditure record linked"
CHECK_COMPLETED = "Completion information available"
CHECK_NOT_COMPLETED = "Completion information missing"
CHECK_APPROVAL_OK = "Approval duration within typical range"
CHECK_APPROVAL_LONG = (
    "Approval duration unusually long ({days} days vs typical up to {limit} days for this dataset)"
)
CHECK_APPROVAL_UNKNOWN = "Unable to verify approval duration from available data"
CHECK_NO_DUPLICATES = "No duplicate-record indicators"
CHECK_DUPLICATES_PREFIX = "Duplicate indicators present: "
CHECK_DUPLICATE_PAYMENTS = "duplicate payment ledger records"
CHECK_DUPLICATE_WORKS = "flagged in duplicate-work screening"
CHECK_COMPLETE_OK = "Lifecycle record substantially complete"
CHECK_COMPLETE_LOW = "Lifecycle record incomplete (completeness score {score})"
CHECK_COMPLETE_UNKNOWN = "Unable to verify lifecycle completeness from available data"

# --- fixed values: risk estimates -------------------------------------------------------------
DELAY_STALLED = "Work is flagged as stalled in the pipeline output."
DELAY_LONG = (
    "Time from sanction to completion ({days} days) is above the 75th percentile for this dataset "
    "({limit} days)."
)
DELAY_TYPICAL = "Sanction-to-completion time is within the typical range for this dataset."
DELAY_UNKNOWN = "Insufficient lifecycle date data to estimate delay risk; defaulting to LOW."
COMPLETION_STALLED = "Work has no recorded completion and is flagged as stalled."
COMPLETION_MISSING = "Work has no recorded completion information yet."
COMPLETION_PRESENT = "Completion information is present in the dataset."
SPEND_RATIO_HIGH = "Expenditure-to-sanction ratio ({value}) is above the 90th percentile ({limit})."
SPEND_VENDOR_HIGH = "Vendor concentration score ({value}) is above the 90th percentile ({limit})."
SPEND_NORMAL = "No elevated expenditure-pattern signals for this work."
ESTIMATE_LABEL = "Risk estimate (not a guaranteed prediction)"
ESTIMATE_METHOD = (
    "Transparent rule-based risk estimate derived from existing pipeline features (lifecycle status, "
    "sanction-to-completion duration, expenditure ratio, vendor concentration) compared against this "
    "dataset's own percentile distribution. This is not a machine-learning prediction and does not use "
    "the pipeline's ML anomaly model."
)

# --- fixed values: early warnings -------------------------------------------------------------
SIGNALS = ["risk", "duplicate", "overrun", "compliance", "stalled"]
SIGNAL_REASONS = {
    "risk": "Risk pipeline classified this work as {level}.",
    "duplicate": "Appears in duplicate-work screening results.",
    "overrun": "Cost overrun flagged ({band} band).",
    "compliance": "Compliance status: REQUIRES REVIEW.",
    "stalled": "Work is flagged as stalled.",
}
SIGNAL_ACTIONS = {
    "duplicate": "Verify whether the flagged works represent separate assets.",
    "overrun": "Review sanction, expenditure and completion records for cost variance.",
    "compliance": "Review missing/failed compliance checks and supporting documentation.",
    "stalled": "Check reason for extended approval or completion duration.",
    "risk": "Review sanction, expenditure and completion records.",
}
SIGNAL_ISSUES = {
    "risk": "Expenditure or overall pattern is unusual",
    "duplicate": "Possible duplicate work",
    "overrun": "Cost exceeded the sanctioned amount",
    "compliance": "Compliance check requires review",
    "stalled": "Project is taking unusually long",
}
SIGNAL_WHY = {
    "risk": (
        "The automated risk pipeline classified this work's overall pattern as unusual enough to "
        "require review."
    ),
    "duplicate": (
        "This work closely resembles another work in the dataset; it may be the same asset recorded "
        "twice, or a separate but similarly described work."
    ),
    "overrun": (
        "Actual spending or completion cost is higher than what was formally sanctioned for this work."
    ),
    "compliance": (
        "One or more compliance checks for this work failed against dataset-wide patterns or basic "
        "financial-control rules."
    ),
    "stalled": (
        "This work was sanctioned a long time ago but shows no recorded expenditure or completion progress."
    ),
}
SEVERITIES = ["Immediate Review", "Priority Review", "Monitor"]

# --- fixed values: findings (category, headline, why, weight, action) --------------------------
FINDING_CATEGORIES = [
    (
        "Potential Duplicate Transaction Records",
        "Duplicate-looking payment records",
        "Multiple ledger entries with identical attributes can mean the same payment was recorded "
        "(or paid) more than once.",
        55,
        "Verify payment/expenditure records for duplicate billing.",
    ),
    (
        "Critical Financial Control",
        "Expenditure exceeds the sanctioned amount",
        "Spending beyond what was formally sanctioned bypasses the financial control the sanction is "
        "meant to enforce.",
        90,
        "Verify expenditure records against the sanction order.",
    ),
    (
        "Financial Control Anomaly",
        "Completion amount exceeds the sanctioned amount",
        "The reported completion cost is higher than what was sanctioned, which should normally "
        "trigger a revised sanction.",
        80,
        "Verify completion documentation against the sanction order.",
    ),
    (
        "Impossible Chronology",
        "Recorded dates are out of order",
        "One recorded stage (sanction, payment or completion) is dated before an earlier stage it "
        "should follow. This usually points to a data-entry error, but can also mask irregular "
        "processing.",
        85,
        "Review the sanction timeline and correct or verify the source records.",
    ),
    (
        "Process Inefficiency",
        "Approval took unusually long",
        "The delay may indicate administrative inefficiency or an unusual approval process.",
        35,
        "Review the approval timeline and identify the reason for the delay.",
    ),
    (
        "Unusual Payment Fragmentation",
        "Payment split into an unusually high number of instalments",
        "Splitting a payment into many small disbursements can be used to stay under approval or "
        "scrutiny thresholds.",
        55,
        "Verify expenditure records and the justification for the payment schedule.",
    ),
    (
        "Vendor Concentration Risk",
        "Most of the money went to a single vendor",
        "A single vendor receiving most of the payments on a work can indicate reduced competition or "
        "a conflict of interest, though it can also be legitimate for a single-contractor work.",
        55,
        "Review implementing agency and vendor records for this work.",
    ),
    (
        "Amount Outlier",
        "Amount is unusually high compared to similar works",
        "The sanctioned or spent amount is far above what comparable works of the same type typically "
        "cost.",
        65,
        "Verify expenditure records and compare against similar works.",
    ),
    (
        "Dormant Sanctioned Work",
        "Work was sanctioned but shows no activity",
        "A work sanctioned a long time ago with no spending and no progress may be stalled, abandoned, "
        "or incorrectly recorded as sanctioned.",
        45,
        "Conduct field verification to confirm the work's actual status.",
    ),
    (
        "ML Supporting Signal",
        "Overall pattern flagged as statistically unusual",
        "An automated pattern-detection model (Isolation Forest) rates this work's overall combination "
        "of amounts and timings as unusual compared with comparable works. It is a general signal, not "
        "tied to one specific rule.",
        35,
        "Review this work's records as part of routine risk-based sampling.",
    ),
    (
        "Peer Statistical Signal",
        "Amount is a statistical outlier versus its peer group",
        "The amount is far from the typical range for similar works, based on a robust "
        "(outlier-resistant) statistical comparison.",
        40,
        "Verify expenditure records and compare against similar works.",
    ),
]
NON_FINDING_CATEGORY = "Normal Work"
GENERIC_FINDING = (
    "Audit rule triggered",
    "This pattern was flagged by an automated audit rule and has not yet been reviewed by a human auditor.",
    40,
    "Review the underlying records for this work.",
)
GENERIC_SEVERITY = "Moderate concern"
NO_ACTION = "No additional action beyond routine monitoring."
SEVERITY_WORDS = [
    (80, "Critical concern"), (55, "Serious concern"), (35, "Moderate concern"), (0, "Minor concern"),
]
OVERRUN_FINDING = {
    "headline": "Actual cost exceeded the sanctioned amount",
    "what": (
        "The recorded cost for this work is {percent}% above the sanctioned amount ({band} band, "
        "relative to other works in this dataset)."
    ),
    "why": (
        "Cost overruns without a revised sanction can indicate weak cost estimation, scope changes that "
        "were not formally approved, or financial irregularity."
    ),
    "action": "Verify expenditure records and confirm whether a revised sanction was issued.",
    "weights": {"HIGH": 85, "MEDIUM": 60, "LOW": 35},
}
COMPLIANCE_FINDING = {
    "headline": "Compliance check failed",
    "why": (
        "This check compares the work against patterns observed across the dataset or against basic "
        "financial-control rules; a failure means it falls outside the normal range."
    ),
    "severity": "Serious concern",
    "weight": 50,
    "action_duplicate": "Check whether this work overlaps with another sanctioned work.",
    "action_duration": "Review the sanction timeline and identify the reason for the delay.",
    "action_lifecycle": "Verify completion documentation for this work.",
    "action_other": "Review the failed compliance check against source records.",
}
DUPLICATE_FINDING = {
    "headline": "Possible duplicate work",
    "what": (
        "This work is {similarity}% similar to work {other} ({tier}). {matches} potential match(es) "
        "were found in total."
    ),
    "why": (
        "Two very similar work records can represent the same physical asset billed twice, or two "
        "genuinely separate works with a similar description (e.g. streetlights installed at different "
        "locations). Similarity alone does not establish duplicate billing."
    ),
    "action": "Check whether the work overlaps with another sanctioned work.",
    "weight": 45,
}
ML_FINDING = {
    "headline": "Overall pattern flagged as statistically unusual",
    "what": (
        "An automated pattern-detection model (Isolation Forest) rates this work's overall combination "
        "of amounts and timings as more unusual than {percentile}% of comparable works in this dataset."
    ),
    "why": (
        "This is a general statistical signal, not tied to one specific rule. It is worth a second look "
        "even though the model cannot say exactly what is unusual about it."
    ),
    "action": "Review this work's records as part of routine risk-based sampling.",
    "from_percentile": 90,
    "strong_percentile": 97,
    "weight": 35,
    "strong_weight": 55,
}
LEVEL_HEADLINES = {
    "CRITICAL": "CRITICAL — Strong audit evidence requires immediate review.",
    "HIGH": "HIGH RISK — Multiple unusual patterns require human review.",
    "REVIEW": "REQUIRES REVIEW — Some patterns warrant a closer look.",
    "NORMAL": "LOW RISK — No significant audit concerns identified.",
}
LEVEL_WEIGHTS = {"CRITICAL": 90, "HIGH": 70, "REVIEW": 45, "NORMAL": 10}
LEVEL_DISPLAY = {"CRITICAL": "CRITICAL", "HIGH": "HIGH", "REVIEW": "MEDIUM", "NORMAL": "LOW"}
SUMMARY_NONE = (
    "No significant issues were identified for this work based on the available records. Routine "
    "monitoring is sufficient."
)
SUMMARY_BY_LEVEL = {
    "CRITICAL": (
        "This work shows {count} serious pattern(s) — including strong evidence-based signals — that "
        "require immediate human review. This does not confirm fraud or wrongdoing."
    ),
    "HIGH": (
        "This work shows {count} unusual pattern(s) that require review by an auditor or the "
        "implementing authority. This is a risk signal, not a finding of wrongdoing."
    ),
    "REVIEW": (
        "This work shows {count} pattern(s) that are somewhat unusual and worth a closer look, though "
        "the evidence is not strong enough to call it high risk."
    ),
}

# --- fixed values: names of columns that reports and tables share --------------------------------
TABLE_DATES = [
    "recommended_date", "sanction_date", "completion_date", "first_payment_date", "last_payment_date",
]
MASTER_FIELDS = [
    "work_description", "work_status_raw", "lifecycle_status", "recommended_date", "sanction_date",
    "first_payment_date", "last_payment_date", "completion_date", "recommended_amount", "sanctioned_amount",
    "completion_amount", "work_category", "state", "constituency", "mp_name", "parliament_house",
    "elected_nominated", "district", "nodal_district", "party", "photo_url",
]
DEFAULT_COLUMNS = {
    "total_expenditure": None,
    "sanctioned_amount": None,
    "completion_amount": None,
    "risk_score": None,
    "risk_level": "NORMAL",
    "primary_reason": NOT_AVAILABLE,
    "work_category": NOT_AVAILABLE,
    "lifecycle_status": NOT_AVAILABLE,
}
SEARCH_COLUMNS = ["work_id", "mp_name", "work_description", "constituency", "vendor_name"]
CRITICAL_SORTS = ["risk_score", "rule_score", "stat_risk_score", "ml_anomaly_percentile"]
MEMBER_SORTS = [
    "mp_name", "state", "constituency", "total_works", "risk_count", "critical_count", "high_risk_count",
    "total_expenditure",
]
COMPLIANCE_STATUSES = {
    "unknown": "INSUFFICIENT DATA", "full": "COMPLIANT", "partial": "PARTIALLY COMPLIANT", "review": "REQUIRES REVIEW",
}
