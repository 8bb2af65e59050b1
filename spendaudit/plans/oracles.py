"""The registered queries restated as SQL for DuckDB, over the same tables.

Each statement is built from named steps; only the steps it needs are put in front of it. Steps say
what a result must be, in plain joins and windows; they share no code with the Spark operators beyond
the fixed message texts.
"""

from __future__ import annotations

import re

from spendaudit import fixed_values as fixed


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(template: str, **values: str) -> str:
    """SQL concatenation of a fixed text with expressions; null if any is null."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{"):
            parts.append(f"CAST({values[piece[1:-1]]} AS VARCHAR)")
        elif piece:
            parts.append(q(piece))
    return "(" + " || ".join(parts) + ")"


def money(x: str) -> str:
    return f"format('{{:,.2f}}', {x})"


def one(x: str) -> str:
    return f"format('{{:.1f}}', {x})"


def plain(x: str) -> str:
    """Up to two decimals, at least one."""
    return f"regexp_replace(format('{{:.2f}}', {x}), '0$', '')"


def printed(x: str, places: int) -> str:
    """Rounded as the number prints."""
    return f"CAST(format('{{:.{places}f}}', {x}) AS DOUBLE)"


def listed(*items: str) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda t: t IS NOT NULL)"


def when(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN {text} END"


def case_of(column: str, values: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {q(str(k))} THEN {q(v) if isinstance(v, str) else v}" for k, v in values.items())
    return f"CASE {column} {arms} ELSE {default} END"


FLAGS = ["has_recommended", "has_sanctioned", "has_expenditure", "has_completed"]
LIFECYCLE = f"""CASE WHEN has_sanctioned AND has_completed THEN {q(fixed.LIFECYCLE_COMPLETED)}
  WHEN has_sanctioned AND has_expenditure THEN {q(fixed.LIFECYCLE_IN_PROGRESS)}
  WHEN has_sanctioned THEN {q(fixed.LIFECYCLE_PENDING_PAYMENT)}
  WHEN has_recommended THEN {q(fixed.LIFECYCLE_PENDING_SANCTION)} ELSE {q(fixed.LIFECYCLE_GAP)} END"""

OUTLIERS = "concat_ws('; ', " + ", ".join(
    when(f"{m}_robust_zscore > 3", fill(t, amount=money(a), z=one(f"{m}_robust_zscore")))
    for m, t, a in (("sanc", fixed.MSG_OUTLIER_SANCTION, "sanctioned_amount"), ("exp", fixed.MSG_OUTLIER_EXPENDITURE, "total_expenditure"))
) + ")"

# condition, points and message of each rule, in order
RULES = [
    (
        "duplicate_records", "duplicate_payment_count > 0", 25,
        fill(fixed.MSG_DUPLICATE_RECORDS, records="duplicate_payment_count", groups="potential_duplicate_group_count")
        + " || " + f"CASE WHEN potential_duplicate_amount > 0 THEN {fill(fixed.MSG_DUPLICATE_AMOUNT, amount=money('potential_duplicate_amount'))} ELSE '' END",
    ),
    (
        "expenditure_over_sanction", "sanctioned_amount > 0 AND total_expenditure > sanctioned_amount + 1", 40,
        fill(fixed.MSG_EXPENDITURE_OVER, spent=money("total_expenditure"), sanctioned=money("sanctioned_amount"), excess=money("total_expenditure - sanctioned_amount")),
    ),
    (
        "completion_over_sanction", "sanctioned_amount > 0 AND completion_amount > sanctioned_amount + 1", 30,
        fill(fixed.MSG_COMPLETION_OVER, completed=money("completion_amount"), sanctioned=money("sanctioned_amount"), excess=money("completion_amount - sanctioned_amount")),
    ),
    ("sanction_before_recommendation", "recommendation_to_sanction_days < 0", 30, q(fixed.MSG_SANCTION_BEFORE_RECOMMENDATION)),
    ("payment_before_sanction", "sanction_to_first_expenditure_days < 0", 30, q(fixed.MSG_PAYMENT_BEFORE_SANCTION)),
    ("completion_before_sanction", "sanction_to_completion_days < 0", 30, q(fixed.MSG_COMPLETION_BEFORE_SANCTION)),
    (
        "long_approval", "recommendation_to_sanction_days > approval_p95", 15,
        fill(fixed.MSG_LONG_APPROVAL, days="recommendation_to_sanction_days", limit="CAST(trunc(approval_p95) AS BIGINT)"),
    ),
    (
        "long_completion", "sanction_to_completion_days > completion_p95", 15,
        fill(fixed.MSG_LONG_COMPLETION, days="sanction_to_completion_days", limit="CAST(trunc(completion_p95) AS BIGINT)"),
    ),
    (
        "fragmentation", "payment_count > payment_count_p97", 20,
        fill(fixed.MSG_FRAGMENTATION, payments="payment_count", limit="CAST(trunc(payment_count_p97) AS BIGINT)"),
    ),
    (
        "vendor_concentration", "payment_count >= 3 AND vendor_concentration_score >= 0.8", 20,
        fill(fixed.MSG_VENDOR, percent="CAST(trunc(vendor_concentration_score * 100) AS BIGINT)", payments="payment_count"),
    ),
    (
        "amount_outlier", "coalesce(sanc_robust_zscore > 3, false) OR coalesce(exp_robust_zscore > 3, false)", 20,
        f"{q(fixed.MSG_OUTLIER_PREFIX)} || {OUTLIERS} || {q(fixed.MSG_OUTLIER_SUFFIX)}",
    ),
    ("dormant", "is_stalled_work = 1", 15, q(fixed.MSG_DORMANT)),
]

# a sanctioned work's later checks
LATER = "has_sanctioned AND "
LONG = "recommendation_to_sanction_days > approval_p90"
KNOWN = "recommendation_to_sanction_days IS NOT NULL"
DUPLICATED = "(duplicate_payment_count > 0 OR in_duplicates)"
PASSED = listed(
    when("has_recommended", q(fixed.CHECK_RECOMMENDED)), when("has_sanctioned", q(fixed.CHECK_SANCTIONED)),
    when(LATER + "has_expenditure", q(fixed.CHECK_PAID)), when(LATER + "has_completed", q(fixed.CHECK_COMPLETED)),
    when(LATER + f"{KNOWN} AND NOT {LONG}", q(fixed.CHECK_APPROVAL_OK)), when(LATER + f"NOT {DUPLICATED}", q(fixed.CHECK_NO_DUPLICATES)),
    when(LATER + "lifecycle_completeness_score >= 0.75", q(fixed.CHECK_COMPLETE_OK)),
)
FAILED = listed(
    when("NOT has_recommended", q(fixed.CHECK_NOT_RECOMMENDED)),
    when(LATER + LONG, fill(fixed.CHECK_APPROVAL_LONG, days="recommendation_to_sanction_days", limit="CAST(trunc(approval_p90) AS BIGINT)")),
    when(
        LATER + DUPLICATED,
        f"{q(fixed.CHECK_DUPLICATES_PREFIX)} || concat_ws(', ', {when('duplicate_payment_count > 0', q(fixed.CHECK_DUPLICATE_PAYMENTS))}, {when('in_duplicates', q(fixed.CHECK_DUPLICATE_WORKS))})",
    ),
    when(LATER + "lifecycle_completeness_score < 0.75", fill(fixed.CHECK_COMPLETE_LOW, score=plain("lifecycle_completeness_score"))),
)
MISSING = listed(
    when("NOT has_sanctioned", q(fixed.CHECK_NOT_SANCTIONED)), when(LATER + "NOT has_expenditure", q(fixed.CHECK_NOT_PAID)),
    when(LATER + "NOT has_completed", q(fixed.CHECK_NOT_COMPLETED)), when(LATER + f"NOT ({KNOWN})", q(fixed.CHECK_APPROVAL_UNKNOWN)),
)

RANK = "CASE {c} WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"
WORST = "greatest(" + ", ".join(RANK.format(c=c) for c in ("delay_risk", "completion_risk", "expenditure_risk")) + ")"
HIGH = "risk_level IN ('HIGH', 'CRITICAL')"

SIGNAL_TESTS = {
    "risk": HIGH,
    "duplicate": "in_duplicates",
    "overrun": "overrun_band IN ('MEDIUM', 'HIGH')",
    "compliance": "compliance_status = 'REQUIRES REVIEW'",
    "stalled": "is_stalled_work = 1",
}
SIGNAL_VALUES = {"level": "risk_level", "band": "overrun_band"}


def severity(weight: str) -> str:
    arms = " ".join(f"WHEN {weight} >= {w} THEN {q(t)}" for w, t in fixed.SEVERITY_WORDS[:-1])
    return f"CASE {arms} ELSE {q(fixed.SEVERITY_WORDS[-1][1])} END"


def of_category(place: int) -> str:
    return case_of("category", {row[0]: row[place] for row in fixed.FINDING_CATEGORIES})


TOKENS = (
    "list_sort(list_filter(string_split_regex(trim(regexp_replace(lower({text}), '[^a-z0-9 ]', ' ', 'g')), ' +'), "
    "lambda w: (regexp_matches(w, '^[0-9]+$') OR length(w) > 2) AND NOT list_contains(["
    + ", ".join(q(w) for w in fixed.DESCRIPTION_STOP_WORDS)
    + "], w)))"
)

STEPS = {
    "people": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "staged": """SELECT *, c_acctbal >= 0 AS has_recommended,
        NOT (o_orderstatus = 'O' AND o_orderpriority = '5-LOW') AS has_sanctioned, o_orderstatus = 'F' AS has_completed,
        CAST(date_trunc('month', o_orderdate) AS DATE) AS start_day, CAST(floor(o_totalprice) AS INTEGER) % 400 - 10 AS wait,
        CASE WHEN n_regionkey < 3 THEN 'Lok Sabha' ELSE 'Rajya Sabha' END AS house, c_mktsegment || ' ' || n_name AS member
      FROM orders JOIN people ON o_custkey = c_custkey""",
    "named": f"""SELECT *, CASE WHEN has_recommended OR has_sanctioned THEN 'WS/' ELSE {q(fixed.UNASSIGNED_PREFIX)} END
        || 'MP' || c_custkey || '/' || year(o_orderdate) || '/' || o_orderkey AS work_id FROM staged""",
    "done": """SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS last_ship, sum(floor(l_extendedprice * (1 - l_discount))) AS done
      FROM lineitem GROUP BY l_orderkey""",
    "flat": f"""SELECT work_id, house AS parliament_house, member AS mp_name, n_name AS state,
        CASE WHEN n_regionkey < 3 THEN c_mktsegment END AS constituency, CASE WHEN n_regionkey >= 3 THEN 'Elected MP' END AS elected_nominated,
        o_orderpriority AS work_category, 'Construction of ' || o_orderpriority || ' works at ' || c_mktsegment AS work_description,
        CASE WHEN has_recommended THEN o_totalprice END AS recommended_amount, CASE WHEN has_recommended THEN start_day - wait END AS recommended_date,
        CASE WHEN has_sanctioned THEN (floor(o_totalprice / 50000) + 1) * 50000 END AS sanctioned_amount, CASE WHEN has_sanctioned THEN start_day END AS sanction_date,
        CASE WHEN has_completed THEN coalesce(done, 0) END AS completion_amount, CASE WHEN has_completed THEN last_ship END AS completion_date,
        CASE WHEN has_sanctioned THEN 'Sanctioned' END AS work_status_raw, has_recommended, has_sanctioned, last_ship IS NOT NULL AS has_expenditure, has_completed,
        starts_with(work_id, {q(fixed.UNASSIGNED_PREFIX)}) AS is_unmatched_work, o_orderkey AS row_order
      FROM named LEFT JOIN done ON l_orderkey = o_orderkey""",
    "works": f"SELECT *, {LIFECYCLE} AS lifecycle_status FROM flat",
    "ledger": """SELECT l.l_orderkey || '-' || l_linenumber AS expenditure_id, work_id, house AS parliament_house,
        CAST(date_trunc('quarter', l_shipdate) AS DATE) AS expenditure_date, 'Vendor ' || v.n_name AS vendor_name, l_linestatus AS payment_status,
        (floor(l_extendedprice / 25000) + 1) * 25000 AS amount
      FROM lineitem l JOIN named ON l.l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation v ON s_nationkey = v.n_nationkey""",
    "records": "SELECT work_id, expenditure_date, vendor_name, payment_status, amount, count(*) AS copies FROM ledger GROUP BY ALL",
    "vendor_totals": "SELECT work_id, vendor_name, sum(amount) AS paid FROM ledger GROUP BY ALL",
    "repeats": """SELECT work_id, count(*) AS potential_duplicate_group_count, CAST(sum(copies - 1) AS BIGINT) AS potential_duplicate_excess_count,
        sum((copies - 1) * amount) AS potential_duplicate_amount FROM records WHERE copies > 1 GROUP BY work_id""",
    "totals": """SELECT work_id, sum(amount) AS total_expenditure, count(*) AS payment_count, count(DISTINCT vendor_name) AS vendor_count,
        min(expenditure_date) AS first_payment_date, max(expenditure_date) AS last_payment_date, max(amount) AS max_single_payment FROM ledger GROUP BY work_id""",
    "profile": """SELECT t.*, v.top_vendor_amount, coalesce(potential_duplicate_group_count, 0) AS potential_duplicate_group_count,
        coalesce(potential_duplicate_excess_count, 0) AS potential_duplicate_excess_count, coalesce(potential_duplicate_amount, 0) AS potential_duplicate_amount,
        CASE WHEN total_expenditure > 0 THEN top_vendor_amount / total_expenditure ELSE 0 END AS vendor_concentration_score,
        CASE WHEN total_expenditure > 0 THEN max_single_payment / total_expenditure ELSE 0 END AS largest_payment_ratio,
        CASE WHEN payment_count > 1 THEN date_diff('day', first_payment_date, last_payment_date) / (payment_count - 1) ELSE 0 END AS payment_frequency_days,
        coalesce(potential_duplicate_excess_count, 0) AS duplicate_transaction_record_count, coalesce(potential_duplicate_excess_count, 0) AS duplicate_payment_count
      FROM totals t JOIN (SELECT work_id, max(paid) AS top_vendor_amount FROM vendor_totals GROUP BY work_id) v USING (work_id) LEFT JOIN repeats USING (work_id)""",
    "paid": """SELECT w.*, coalesce(total_expenditure, 0) AS total_expenditure, coalesce(payment_count, 0) AS payment_count, coalesce(vendor_count, 0) AS vendor_count,
        first_payment_date, last_payment_date, coalesce(vendor_concentration_score, 0) AS vendor_concentration_score, coalesce(largest_payment_ratio, 0) AS largest_payment_ratio,
        coalesce(duplicate_payment_count, 0) AS duplicate_payment_count, coalesce(p.potential_duplicate_group_count, 0) AS potential_duplicate_group_count,
        coalesce(p.potential_duplicate_amount, 0) AS potential_duplicate_amount
      FROM works w LEFT JOIN profile p USING (work_id)""",
    "base": """SELECT *, CAST(date_diff('day', recommended_date, sanction_date) AS INTEGER) AS recommendation_to_sanction_days,
        CAST(date_diff('day', sanction_date, first_payment_date) AS INTEGER) AS sanction_to_first_expenditure_days, CAST(date_diff('day', sanction_date, completion_date) AS INTEGER) AS sanction_to_completion_days,
        CAST(coalesce(sanction_date < DATE '2002-01-01' - 180 AND total_expenditure = 0 AND completion_amount = 0, false) AS INTEGER) AS is_stalled_work,
        (has_recommended::INT + has_sanctioned::INT + has_expenditure::INT + has_completed::INT) * 0.25::DOUBLE AS lifecycle_completeness_score,
        CASE WHEN has_sanctioned THEN greatest(0, total_expenditure - sanctioned_amount - 1) END AS expenditure_overrun_amount,
        CASE WHEN has_sanctioned AND has_completed THEN greatest(0, completion_amount - sanctioned_amount - 1) END AS completion_overrun_amount,
        CASE WHEN has_sanctioned AND sanctioned_amount > 0 THEN total_expenditure / sanctioned_amount END AS expenditure_to_sanction_ratio,
        CASE WHEN has_sanctioned AND has_completed AND sanctioned_amount > 0 THEN completion_amount / sanctioned_amount END AS completion_to_sanction_ratio,
        CASE WHEN has_completed AND has_expenditure THEN completion_amount - total_expenditure END AS completion_minus_expenditure,
        has_completed AND has_expenditure AS completion_expenditure_comparison_available,
        parliament_house || '_' || state || '_' || work_category AS peer_group,
        CASE WHEN NOT is_unmatched_work THEN sanctioned_amount END AS sanc_value, CASE WHEN NOT is_unmatched_work AND has_expenditure THEN total_expenditure END AS exp_value
      FROM paid""",
    "medians": """SELECT peer_group, count(*) AS peer_group_size, count(sanc_value) AS sanc_n, count(exp_value) AS exp_n,
        median(sanc_value) AS sanc_median, median(exp_value) AS exp_median FROM base GROUP BY peer_group""",
    "mads": """SELECT peer_group, median(abs(sanc_value - sanc_median)) AS sanc_mad, median(abs(exp_value - exp_median)) AS exp_mad
      FROM base JOIN medians USING (peer_group) GROUP BY peer_group""",
    "peered": "SELECT b.*, peer_group_size, "
    + ", ".join(
        f"{m}_n AS peer_{m}_valid_count, "
        f"CASE WHEN {m}_n >= 10 AND {m}_value IS NOT NULL THEN {m}_median END AS peer_{m}_median, "
        f"CASE WHEN {m}_n >= 10 AND {m}_value IS NOT NULL THEN {m}_mad END AS peer_{m}_mad, "
        f"CASE WHEN {m}_n >= 10 AND {m}_value IS NOT NULL THEN greatest({m}_mad, 0.1::DOUBLE * {m}_median, 10000) END AS peer_{m}_effective_mad"
        for m in ("sanc", "exp")
    )
    + " FROM base b JOIN medians USING (peer_group) JOIN mads USING (peer_group)",
    "features": """SELECT *, (sanc_value - peer_sanc_median) / peer_sanc_effective_mad AS sanc_robust_zscore,
        (exp_value - peer_exp_median) / peer_exp_effective_mad AS exp_robust_zscore FROM peered""",
    "limits": """SELECT parliament_house, quantile_cont(recommendation_to_sanction_days, 0.95) AS approval_p95,
        quantile_cont(sanction_to_completion_days, 0.95) AS completion_p95,
        (SELECT quantile_cont(payment_count, 0.97) FROM features WHERE payment_count > 0) AS payment_count_p97
      FROM features GROUP BY parliament_house""",
    "ruled": "SELECT f.*, approval_p95, completion_p95, payment_count_p97, least(100, "
    + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for _, c, p, _ in RULES)
    + ") AS rule_score, "
    + listed(*[when(c, t) for _, c, _, t in RULES])
    + " AS rule_reasons FROM features f JOIN limits USING (parliament_house)",
    "ranked": """SELECT *, round_even((total_expenditure - (SELECT min(total_expenditure) FROM features))
          / greatest((SELECT max(total_expenditure) - min(total_expenditure) FROM features), 1e-6), 4) AS ml_anomaly_score,
        round_even((rank() OVER (ORDER BY total_expenditure) + (count(*) OVER (PARTITION BY total_expenditure) - 1) / 2) / count(*) OVER () * 100, 1) AS ml_anomaly_percentile
      FROM ruled""",
    "stated": """SELECT *, round_even(100 * (1 - exp(-coalesce(greatest(abs(sanc_robust_zscore), abs(exp_robust_zscore)), 0) / 6)), 1) AS stat_risk_score FROM ranked""",
    "weighed": """SELECT *, round_even(least(100, 0.5::DOUBLE * rule_score + 0.3::DOUBLE * ml_anomaly_percentile + 0.2::DOUBLE * stat_risk_score), 1) AS risk_score FROM stated""",
    "levelled": """SELECT *, CASE
          WHEN risk_score >= 60 AND rule_score <= 0 AND stat_risk_score <= 0 THEN 'REVIEW'
          WHEN risk_score >= 80 AND (rule_score >= 75 OR (rule_score >= 65 AND stat_risk_score >= 70) OR (rule_score >= 65 AND ml_anomaly_percentile >= 95)) THEN 'CRITICAL'
          WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 30 THEN 'REVIEW' ELSE 'NORMAL' END AS risk_level,
        'MP-' || upper(substr(sha1(parliament_house || '|' || mp_name), 1, 10)) AS mp_id,
        list_concat(rule_reasons, """
    + listed(
        f"CASE WHEN ml_anomaly_percentile >= 95 THEN {fill(fixed.MSG_ML_STRONG, percentile=one('ml_anomaly_percentile'))} "
        f"WHEN ml_anomaly_percentile >= 90 AND len(rule_reasons) = 0 THEN {fill(fixed.MSG_ML_WEAK, percentile=one('ml_anomaly_percentile'))} END",
        *[
            when(
                f"abs({z}) > 3 AND NOT (coalesce(sanc_robust_zscore > 3, false) OR coalesce(exp_robust_zscore > 3, false))",
                fill(t, z=one(z)),
            )
            for z, t in (("sanc_robust_zscore", fixed.MSG_PEER_SANCTION), ("exp_robust_zscore", fixed.MSG_PEER_EXPENDITURE))
        ],
    )
    + ") AS found_reasons FROM weighed",
    "scored": f"SELECT *, CASE WHEN len(found_reasons) = 0 THEN [{q(fixed.MSG_NORMAL)}] ELSE found_reasons END AS risk_reasons FROM levelled",
    "described": "SELECT *, array_to_string(toks, ' ') AS normtext, array_to_string(toks[1:4], ' ') AS signature, array_to_string(toks[-4:], ' ') AS end_signature FROM (SELECT *, "
    + TOKENS.format(text="work_description")
    + " AS toks FROM scored)",
    "clusters": """SELECT mp_name, normtext, sanctioned_amount, sanction_date, count(*) AS unit_count, list(work_id ORDER BY row_order) AS ids,
        list(risk_level ORDER BY row_order) AS levels, arg_min(state, row_order) AS state, arg_min({'c': constituency}, row_order).c AS constituency,
        arg_min(work_description, row_order) AS work_description, min(row_order) AS place, min(coalesce(constituency, '')) AS seat, any_value(signature) AS signature,
        count(DISTINCT coalesce(constituency, '')) AS seats
      FROM described WHERE normtext <> '' AND sanctioned_amount IS NOT NULL AND sanction_date IS NOT NULL GROUP BY ALL""",
    "pairs": "SELECT * FROM clusters WHERE unit_count = 2",
    "batches": "SELECT * FROM clusters WHERE unit_count >= 3",
    "dup_ids": "SELECT DISTINCT unnest(ids) AS work_id FROM pairs",
    "based": """SELECT s.*, d.work_id IS NOT NULL AS in_duplicates,
        CASE WHEN completion_expenditure_comparison_available AND completion_overrun_amount IS NOT NULL THEN completion_overrun_amount ELSE expenditure_overrun_amount END AS overrun_amount,
        CASE WHEN completion_expenditure_comparison_available AND completion_overrun_amount IS NOT NULL THEN 'completion_amount_vs_sanctioned_amount' ELSE 'expenditure_to_date_vs_sanctioned_amount' END AS overrun_basis
      FROM scored s LEFT JOIN dup_ids d USING (work_id)""",
    "rated": """SELECT *, coalesce(sanctioned_amount > 0 AND overrun_amount IS NOT NULL, false) AS overrun_determinable,
        CASE WHEN sanctioned_amount > 0 THEN overrun_amount / sanctioned_amount * 100 END AS overrun_pct FROM based""",
    "bands": "SELECT quantile_cont(overrun_pct, 0.33) AS low_max, quantile_cont(overrun_pct, 0.67) AS medium_max FROM rated WHERE overrun_pct > 0",
    "typical": """SELECT quantile_cont(recommendation_to_sanction_days, 0.9) AS approval_p90, quantile_cont(sanction_to_completion_days, 0.75) AS slow,
        quantile_cont(expenditure_to_sanction_ratio, 0.9) AS ratio_p90, quantile_cont(vendor_concentration_score, 0.9) AS vendor_p90 FROM scored""",
    "banded": """SELECT r.*, low_max, medium_max, approval_p90, slow, ratio_p90, vendor_p90, overrun_determinable AND overrun_amount > 0 AS is_overrun,
        CASE WHEN NOT (overrun_determinable AND overrun_amount > 0) THEN NULL WHEN overrun_pct <= low_max THEN 'LOW' WHEN overrun_pct <= medium_max THEN 'MEDIUM' ELSE 'HIGH' END AS overrun_band
      FROM rated r, bands, typical""",
    "checked": f"SELECT *, {PASSED} AS passed, {FAILED} AS failed, {MISSING} AS missing FROM banded",
    "complied": """SELECT *, len(passed) / (len(passed) + len(failed)) AS compliance_score, len(passed) + len(failed) + len(missing) AS checks_total,
        CASE WHEN NOT has_sanctioned OR len(passed) + len(failed) < 0.5 * (len(passed) + len(failed) + len(missing)) THEN 'INSUFFICIENT DATA'
          WHEN len(failed) = 0 THEN 'COMPLIANT' WHEN len(passed) / (len(passed) + len(failed)) >= 0.7 THEN 'PARTIALLY COMPLIANT' ELSE 'REQUIRES REVIEW' END AS compliance_status
      FROM checked""",
    "delayed": f"""SELECT *, CASE WHEN is_stalled_work = 1 THEN 'HIGH' WHEN sanction_to_completion_days > slow THEN 'MEDIUM' ELSE 'LOW' END AS delay_risk,
        CASE WHEN is_stalled_work = 1 THEN {q(fixed.DELAY_STALLED)}
          WHEN sanction_to_completion_days > slow THEN {fill(fixed.DELAY_LONG, days="sanction_to_completion_days", limit="CAST(trunc(slow) AS BIGINT)")}
          WHEN sanction_to_completion_days IS NOT NULL THEN {q(fixed.DELAY_TYPICAL)} ELSE {q(fixed.DELAY_UNKNOWN)} END AS delay_reason,
        CASE WHEN has_completed THEN 'LOW' WHEN is_stalled_work = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS completion_risk,
        CASE WHEN has_completed THEN {q(fixed.COMPLETION_PRESENT)} WHEN is_stalled_work = 1 THEN {q(fixed.COMPLETION_STALLED)} ELSE {q(fixed.COMPLETION_MISSING)} END AS completion_reason,
        CASE WHEN expenditure_to_sanction_ratio > ratio_p90 THEN 'HIGH' WHEN vendor_concentration_score > vendor_p90 THEN 'MEDIUM' ELSE 'LOW' END AS expenditure_risk,
        CASE WHEN coalesce(expenditure_to_sanction_ratio > ratio_p90, false) OR vendor_concentration_score > vendor_p90 THEN concat_ws(' ',
          {when("expenditure_to_sanction_ratio > ratio_p90", fill(fixed.SPEND_RATIO_HIGH, value=plain("expenditure_to_sanction_ratio"), limit=plain("ratio_p90")))},
          {when("vendor_concentration_score > vendor_p90", fill(fixed.SPEND_VENDOR_HIGH, value=plain("vendor_concentration_score"), limit=plain("vendor_p90")))})
          ELSE {q(fixed.SPEND_NORMAL)} END AS expenditure_reason
      FROM complied""",
    "monitored": f"""SELECT *, CASE WHEN {WORST} = 2 OR {HIGH} THEN 'HIGH' WHEN {WORST} = 1 OR risk_level = 'REVIEW' THEN 'MEDIUM' ELSE 'LOW' END AS review_priority,
        {WORST} + CASE WHEN {HIGH} THEN 2 WHEN risk_level = 'REVIEW' THEN 1 ELSE 0 END AS review_priority_score FROM delayed""",
    "signalled": "SELECT *, "
    + listed(*[when(t, q(s)) for s, t in SIGNAL_TESTS.items()])
    + " AS found, "
    + listed(*[when(t, fill(fixed.SIGNAL_REASONS[s], **SIGNAL_VALUES)) for s, t in SIGNAL_TESTS.items()])
    + " AS reasons, "
    + listed(*[when(t, q(fixed.SIGNAL_ACTIONS[s])) for s, t in SIGNAL_TESTS.items()])
    + " AS actions FROM monitored",
    "warnings": """SELECT *, len(found) AS signal_count, CASE WHEN risk_level = 'CRITICAL' OR len(found) >= 3 THEN 'Immediate Review'
        WHEN risk_level = 'HIGH' OR len(found) >= 2 THEN 'Priority Review' ELSE 'Monitor' END AS severity FROM signalled WHERE len(found) > 0""",
    "matches": "SELECT ids[1] AS work_id, ids[2] AS other FROM pairs UNION ALL SELECT ids[2], ids[1] FROM pairs",
    "reason_rows": "SELECT work_id, i, risk_reasons[i] AS reason, split_part(risk_reasons[i], ':', 1) AS category FROM (SELECT work_id, risk_reasons, unnest(range(1, len(risk_reasons) + 1)) AS i FROM monitored)",
    "failed_rows": "SELECT work_id, i, failed[i] AS what, lower(failed[i]) AS low FROM (SELECT work_id, failed, unnest(range(1, len(failed) + 1)) AS i FROM monitored)",
    "finding_rows": f"""SELECT work_id, i AS seq, {of_category(4 - 1)} AS weight, 'rule' AS source, {of_category(1)} AS headline,
          trim(substr(reason, strpos(reason, ':') + 1)) AS what_happened, {of_category(2)} AS why_it_matters, {severity(of_category(3))} AS severity, {of_category(4)} AS recommended_action
        FROM reason_rows WHERE category <> 'Normal Work'
      UNION ALL SELECT work_id, 1000, 45, 'duplicate', {q(fixed.DUPLICATE_FINDING["headline"])},
          {fill(fixed.DUPLICATE_FINDING["what"], similarity="'100.0'", other="other", tier="'A'", matches="1")}, {q(fixed.DUPLICATE_FINDING["why"])}, 'Moderate concern', {q(fixed.DUPLICATE_FINDING["action"])} FROM matches
      UNION ALL SELECT work_id, 2000, {case_of("overrun_band", fixed.OVERRUN_FINDING["weights"])}, 'cost_overrun', {q(fixed.OVERRUN_FINDING["headline"])},
          {fill(fixed.OVERRUN_FINDING["what"], percent=one(printed("overrun_pct", 2)), band="upper(overrun_band[1]) || lower(overrun_band[2:])")},
          {q(fixed.OVERRUN_FINDING["why"])}, {severity(case_of("overrun_band", fixed.OVERRUN_FINDING["weights"]))}, {q(fixed.OVERRUN_FINDING["action"])} FROM monitored WHERE is_overrun
      UNION ALL SELECT work_id, 3000 + i, 50, 'compliance', {q(fixed.COMPLIANCE_FINDING["headline"])}, what, {q(fixed.COMPLIANCE_FINDING["why"])}, 'Serious concern',
          CASE WHEN contains(low, 'duplicate') THEN {q(fixed.COMPLIANCE_FINDING["action_duplicate"])} WHEN contains(low, 'duration') THEN {q(fixed.COMPLIANCE_FINDING["action_duration"])}
            WHEN contains(low, 'lifecycle') OR contains(low, 'incomplete') THEN {q(fixed.COMPLIANCE_FINDING["action_lifecycle"])} ELSE {q(fixed.COMPLIANCE_FINDING["action_other"])} END FROM failed_rows""",
    "model_rows": f"""SELECT work_id, 0 AS seq, CASE WHEN ml_anomaly_percentile < 97 THEN 35 ELSE 55 END AS weight, 'ml' AS source, {q(fixed.ML_FINDING["headline"])} AS headline,
          {fill(fixed.ML_FINDING["what"], percentile=one("ml_anomaly_percentile"))} AS what_happened, {q(fixed.ML_FINDING["why"])} AS why_it_matters,
          CASE WHEN ml_anomaly_percentile < 97 THEN 'Moderate concern' ELSE 'Serious concern' END AS severity, {q(fixed.ML_FINDING["action"])} AS recommended_action
        FROM monitored WHERE ml_anomaly_percentile >= 90 AND work_id NOT IN (SELECT work_id FROM finding_rows)""",
    "all_findings": "SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY weight DESC, seq) - 1 AS place, count(*) OVER (PARTITION BY work_id) AS total FROM (SELECT * FROM finding_rows UNION ALL SELECT * FROM model_rows)",
    "top_findings": "SELECT * FROM all_findings WHERE place < 5",
}


def forest_steps(trees: int = 150, sample: int = 256, seed: int = 42) -> dict[str, str]:
    """The isolation forest, grown level by level from the same digests as in the audit."""
    wanted, levels = 2 * sample * trees, 8
    logged = [f"ln(1 + greatest(0, coalesce({c}, (SELECT median({c}) FROM features))))" for c in ("sanctioned_amount", "total_expenditure", "completion_amount")]
    plain_ones = [
        f"coalesce({c}, (SELECT median({c}) FROM features))::DOUBLE"
        for c in ("payment_count", "vendor_count", "vendor_concentration_score", "largest_payment_ratio", "duplicate_payment_count", "sanc_robust_zscore", "exp_robust_zscore")
    ]
    x = [*logged, *plain_ones, "CASE WHEN parliament_house = 'Lok Sabha' THEN 1.0::DOUBLE ELSE 0 END"]
    ends = [", ".join(f"{f}(x[{i}])" for i in range(1, len(x) + 1)) for f in ("min", "max")]
    rest = "CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE 2 * (ln(n - 1) + 0.5772156649015329) - 2.0::DOUBLE * (n - 1) / n END"
    steps = {
        "forest_x": f"SELECT work_id, [{', '.join(x)}] AS x, count(*) OVER () AS total FROM features",
        "forest_drawn": f"""SELECT DISTINCT work_id, unnest(CASE WHEN {wanted} > (total * {trees - 1}) THEN range({trees}) ELSE list_transform(range(CAST(ceil({wanted} / total) AS BIGINT)),
            lambda r: ('0x' || substr(md5('{seed}|draw|' || r || '|' || work_id), 1, 8))::BIGINT % {trees}) END) AS tree
          FROM forest_x WHERE total <= {wanted} OR substr(md5('{seed}|pool|' || work_id), 1, 12) < format('{{:012x}}', CAST(floor({wanted} / total * 281474976710656) AS BIGINT))""",
        "forest_rows0": f"""SELECT tree, 1 AS node, x FROM (SELECT work_id, tree FROM forest_drawn
            QUALIFY row_number() OVER (PARTITION BY tree ORDER BY md5('{seed}|order|' || tree || '|' || work_id), work_id) <= {sample}) JOIN forest_x USING (work_id)""",
    }
    for level in range(levels + 1):
        steps[f"forest_nodes{level}"] = f"SELECT tree, node, count(*) AS n, [{ends[0]}] AS lo, [{ends[1]}] AS hi FROM forest_rows{level} GROUP BY tree, node"
        if level == levels:
            break
        steps[f"forest_cuts{level}"] = f"""SELECT tree, node, feature, lo[feature] + u * (hi[feature] - lo[feature]) AS cut FROM (
            SELECT *, usable[('0x' || substr(drawn, 1, 8))::BIGINT % len(usable) + 1] AS feature, ('0x' || substr(drawn, 9, 8))::BIGINT / 4294967296.0::DOUBLE AS u
            FROM (SELECT *, md5('{seed}|node|' || tree || '|' || node) AS drawn, list_filter(range(1, {len(x) + 1}), lambda i: hi[i] > lo[i]) AS usable FROM forest_nodes{level}) WHERE n > 1 AND len(usable) > 0)
          WHERE lo[feature] + u * (hi[feature] - lo[feature]) < hi[feature]"""
        steps[f"forest_rows{level + 1}"] = f"SELECT r.tree, 2 * r.node + CAST(x[feature] > cut AS INTEGER) AS node, x FROM forest_rows{level} r JOIN forest_cuts{level} USING (tree, node)"
    leaves = [f"SELECT tree, node, {level} AS depth, n FROM forest_nodes{level}" for level in range(levels + 1)]
    cuts = " UNION ALL ".join(f"SELECT tree, node FROM forest_cuts{level}" for level in range(levels))
    steps["forest_leaves"] = f"SELECT tree, node, depth * 1000000 + CAST(round_even(({rest}) * 1000000, 0) AS BIGINT) AS length FROM ({' UNION ALL '.join(leaves)}) ANTI JOIN ({cuts}) USING (tree, node)"
    walk = f"SELECT work_id, CAST(tree AS BIGINT) AS tree, 1 AS node, x FROM forest_x, range({trees}) t(tree)"
    for level in range(levels):
        walk = f"SELECT w.work_id, w.tree, CASE WHEN cut IS NULL THEN w.node ELSE 2 * w.node + CAST(x[feature] > cut AS INTEGER) END AS node, x FROM ({walk}) w LEFT JOIN forest_cuts{level} USING (tree, node)"
    steps["forest_scores"] = f"""SELECT work_id, pow(2, -sum(length)::DOUBLE / {trees} / ((SELECT {rest} FROM (SELECT least({sample}, max(total)) AS n FROM forest_x)) * 1000000)) AS raw
      FROM ({walk}) JOIN forest_leaves USING (tree, node) GROUP BY work_id"""
    return steps


_at = list(STEPS).index("ranked")  # steps stand in the order in which they need each other
STEPS = dict([*list(STEPS.items())[:_at], *forest_steps().items(), *list(STEPS.items())[_at:]])
FOREST_RANKED = """SELECT r.*, round_even((raw - min(raw) OVER ()) / greatest(max(raw) OVER () - min(raw) OVER (), 1e-6), 4) AS ml_anomaly_score,
    round_even((rank() OVER (ORDER BY raw) + (count(*) OVER (PARTITION BY raw) - 1) / 2) / count(*) OVER () * 100, 1) AS ml_anomaly_percentile
  FROM ruled r JOIN forest_scores USING (work_id)"""


def sql(statement: str, **instead: str) -> str:
    """The statement with all steps it refers to, in order; ``instead`` replaces steps."""
    steps = {**STEPS, **instead}
    needed: set[str] = set()
    todo = [statement]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & steps.keys() - needed:
            needed.add(name)
            todo.append(steps[name])
    # the forest's steps are read several times
    told = [f"{name} AS {'MATERIALIZED ' if name.startswith('forest_') else ''}({steps[name]})" for name in steps if name in needed]
    return ("WITH " + ",\n".join(told) + "\n" if told else "") + statement


LEVEL_COUNTS = ", ".join(f"count(*) FILTER (WHERE risk_level = '{v}') AS \"{v}\"" for v in fixed.RISK_LEVELS)
MONEY = "sum(coalesce(sanctioned_amount, 0)) AS sanctioned, sum(total_expenditure) AS expenditure, sum(coalesce(completion_amount, 0)) AS completion"
SUMMARY = f"count(*) AS total_works, {LEVEL_COUNTS}, {MONEY}"
OVERVIEW = f"SELECT {SUMMARY}, count(DISTINCT mp_id) AS mp_count, count(DISTINCT state) AS state_count, CAST(sum(duplicate_payment_count) AS BIGINT) AS duplicate_payment_count FROM scored"
STATE_5 = "SELECT mp_id, mp_name, parliament_house, constituency, count(*) AS works, count(*) FILTER (WHERE risk_level = 'HIGH') AS high, count(*) FILTER (WHERE risk_level = 'CRITICAL') AS critical, sum(total_expenditure) AS expenditure FROM scored WHERE state = 'NATION_5' GROUP BY ALL"


def histogram(column: str) -> str:
    return f"""SELECT CAST(least(29, floor(({column} - low) / width)) AS INTEGER) AS bin, round(low + least(29, floor(({column} - low) / width)) * width, 4) AS from_days, count(*) AS works
      FROM scored, (SELECT min({column})::DOUBLE AS low, (max({column}) - min({column}))::DOUBLE / 30 AS width FROM scored) WHERE {column} IS NOT NULL GROUP BY ALL"""


def value_counts(table: str, *columns: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS measure, {c} AS value, count(*) AS works FROM {table} GROUP BY {c}" for c in columns)


def quantiles(source: str, by: str, probs: list[float], **measures: str) -> str:
    group = f"{by}, " if by else ""
    found = ", ".join(f"round(quantile_cont(value, {p}), 9) AS q{i}" for i, p in enumerate(probs))
    values = " UNION ALL ".join(f"SELECT {group}'{n}' AS measure, CAST({c} AS DOUBLE) AS value FROM {source} WHERE {c} IS NOT NULL" for n, c in measures.items())
    return f"SELECT {group}measure, count(*) AS n, {found} FROM ({values}) GROUP BY {group}measure"


def rounds(*columns: str, places: int = 9) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)


RAW_ID = "'WS/MP' || c_custkey || '/' || year(o_orderdate) || '-' || (year(o_orderdate) + 1) || '/' || o_orderkey"
# title case of the member and state texts in the exports
RAW_MEMBER = "upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || 'Nation' || n_name[7:]"
RAW_STATE = "'Nation' || n_name[7:]"
HOUSE_CODE = "CASE WHEN n_regionkey < 3 THEN 'LS' ELSE 'RS' END"

_DATED = {"recommended": "Recommended date", "sanctioned": "Sanction Date", "completed": "Completion Date", "expenditure": "Expenditure Date", "calamity": "Date of Consent"}
_PAID = {
    "recommended": "Recommended AMOUNT ( ₹ )", "sanctioned": "Sanction AMOUNT ( ₹ )", "completed": "Amount Disbursed ( ₹ )",
    "expenditure": "Fund Disbursed Amount ( ₹ )", "allocation": "Allocated AMOUNT ( ₹ )", "calamity": "Consent Amount ( ₹ )",
}
_RAW = {
    "unreadable_cells": "SELECT house, kind, name AS column, 0::BIGINT AS unreadable FROM (VALUES "
    + ", ".join(f"('{kind}', '{name}')" for names in (_DATED, _PAID) for kind, name in names.items())
    + ") n(kind, name), (VALUES ('LS'), ('RS')) h(house)",
    "raw_export_rows": f"""SELECT house, kind, count(*) AS rows, 1::BIGINT AS first, count(*) AS last, count(*) AS positions FROM (
        SELECT {HOUSE_CODE} AS house, 'recommended' AS kind FROM staged WHERE has_recommended
        UNION ALL SELECT {HOUSE_CODE}, 'sanctioned' FROM staged WHERE has_sanctioned
        UNION ALL SELECT {HOUSE_CODE}, 'completed' FROM staged WHERE has_completed
        UNION ALL SELECT {HOUSE_CODE}, 'expenditure' FROM lineitem JOIN staged ON l_orderkey = o_orderkey
        UNION ALL SELECT {HOUSE_CODE}, 'allocation' FROM people
        UNION ALL SELECT {HOUSE_CODE}, 'calamity' FROM people JOIN events ON user_id = c_custkey) GROUP BY house, kind""",
    "integrated_works": f"""SELECT work_id, parliament_house, mp_name, state, constituency, elected_nominated, work_category, work_description, recommended_amount, recommended_date,
        sanctioned_amount, sanction_date, completion_amount, completion_date, work_status_raw, has_recommended, has_sanctioned, has_expenditure, has_completed, false AS is_unmatched_work,
        {LIFECYCLE} AS lifecycle_status FROM (
        SELECT {RAW_ID} AS work_id, house AS parliament_house, {RAW_MEMBER} AS mp_name, {RAW_STATE} AS state,
          CASE WHEN n_regionkey < 3 THEN c_mktsegment END AS constituency, CASE WHEN n_regionkey >= 3 THEN 'Elected MP' END AS elected_nominated,
          CASE WHEN has_recommended OR has_sanctioned OR has_completed THEN o_orderpriority ELSE 'Normal/Others' END AS work_category,
          CASE WHEN has_recommended OR has_sanctioned OR has_completed THEN 'Repair of' || chr(10) || c_mktsegment ELSE '' END AS work_description,
          CASE WHEN has_recommended THEN o_totalprice END AS recommended_amount, CASE WHEN has_recommended THEN start_day - wait END AS recommended_date,
          CASE WHEN has_sanctioned THEN (floor(o_totalprice / 50000) + 1) * 50000 END AS sanctioned_amount, CASE WHEN has_sanctioned THEN start_day END AS sanction_date,
          CASE WHEN has_completed THEN o_totalprice END AS completion_amount, CASE WHEN has_completed THEN CAST(o_orderdate AS DATE) END AS completion_date,
          CASE WHEN has_sanctioned THEN 'Sanctioned' WHEN has_recommended THEN NULL WHEN has_completed THEN 'Work Completed' ELSE 'In Progress' END AS work_status_raw,
          has_recommended, has_sanctioned, p.l_orderkey IS NOT NULL AS has_expenditure, has_completed
        FROM staged LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 2) p ON p.l_orderkey = o_orderkey
        WHERE has_recommended OR has_sanctioned OR has_completed OR p.l_orderkey IS NOT NULL)""",
    "integrated_unmatched": f"""SELECT house AS parliament_house, {q(fixed.LIFECYCLE_GAP)} AS lifecycle_status, 'In Progress' AS work_status_raw, count(*) AS works, count(*) AS ids
      FROM lineitem JOIN staged ON l_orderkey = o_orderkey WHERE l_quantity < 2 GROUP BY house""",
    "integrated_ledger": """SELECT house AS parliament_house, CASE WHEN l_tax > 0 THEN 'Vendor ' || l_suppkey ELSE 'Unknown Vendor' END AS vendor_name,
        CASE WHEN l_linestatus = 'F' THEN 'Paid' ELSE 'Completed' END AS payment_status, CAST(year(l_shipdate) AS VARCHAR) AS year, count(*) AS records, count(*) AS ids,
        count(*) FILTER (WHERE l_quantity >= 2) AS linked, sum(floor(l_extendedprice)) AS amount FROM lineitem JOIN staged ON l_orderkey = o_orderkey GROUP BY ALL""",
    "integrated_allocations": f"""SELECT CASE WHEN n_regionkey < 3 THEN 'Lok Sabha' ELSE 'Rajya Sabha' END AS parliament_house, {RAW_MEMBER} AS mp_name, {RAW_STATE} AS state,
        CASE WHEN n_regionkey < 3 THEN c_mktsegment END AS constituency, CASE WHEN n_regionkey >= 3 THEN 'Elected MP' END AS elected_nominated,
        count(*) AS rows, round(sum(abs(c_acctbal)), 2) AS allocated_amount FROM people GROUP BY ALL""",
    "integrated_calamities": f"""SELECT CASE WHEN n_regionkey < 3 THEN 'Lok Sabha' ELSE 'Rajya Sabha' END AS parliament_house, {RAW_MEMBER} AS mp_name, event_type AS calamity_type,
        'Flood ' || user_id AS calamity_name, CAST(ts AS DATE) AS consent_date, value AS consent_amount, 'CAL_' || {HOUSE_CODE} || '_' AS id_prefix
      FROM people JOIN events ON user_id = c_custkey""",
}

_CLEAN = {
    "total_row_filter": """SELECT CAST(p_partkey AS VARCHAR) AS part, CASE WHEN p_size = 21 THEN 'Totally ' || p_name WHEN p_size NOT IN (30, 31) THEN p_name END AS label, p_type AS type
      FROM part WHERE p_size NOT IN (7, 13)""",
    "amount_parsing": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderstatus <> 'F' AND o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS amount FROM orders",
    "date_order_of_files": """SELECT o_orderkey AS row_pos, CAST(o_orderdate AS DATE) AS sanction_date, CAST(o_orderdate AS DATE) AS completion_date,
        CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS date_of_consent FROM orders""",
    "date_parsing": "SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "work_id_extraction": """SELECT o_orderkey, CASE o_orderstatus
        WHEN 'F' THEN 'WS/MP' || o_custkey || '/' || year(o_orderdate) || '-' || (year(o_orderdate) + 1) || '/' || o_orderkey
        WHEN 'O' THEN 'WS/MP' || o_custkey || '/' || year(o_orderdate) || '/' || o_orderkey
        ELSE CASE WHEN o_orderpriority <> '5-LOW' THEN 'WS/AB_' || o_custkey || '/' || year(o_orderdate) || '-' || month(o_orderdate) || '/' || o_orderkey END END AS work_id FROM orders""",
    "member_names": """SELECT c_custkey, mp_name, 'MP-' || upper(substr(sha1('Lok Sabha|' || mp_name), 1, 10)) AS mp_id FROM (SELECT c_custkey,
        CASE WHEN c_acctbal < 0 THEN 'Unknown MP' ELSE 'O''Brien K.C. ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS mp_name FROM customer)""",
    "state_names": """SELECT s_suppkey, state, replace(replace(state, 'Jammu And', 'Jammu &'), 'Andaman And', 'Andaman &') AS state_display FROM (SELECT s_suppkey,
        CASE WHEN s_acctbal < 0 THEN 'Unknown State' WHEN s_nationkey IN (0, 4) THEN 'Odisha' WHEN s_nationkey = 1 THEN 'Jammu And Kashmir'
          WHEN s_nationkey = 2 THEN 'Andaman And Nicobar Islands' WHEN s_nationkey = 3 THEN 'Dadra And Nagar Haveli' ELSE 'State ' || s_nationkey END AS state FROM supplier)""",
    "key_tidying": "SELECT CAST(l_orderkey AS VARCHAR) AS work_id, count(*) AS rows, max(CAST(l_shipdate AS DATE)) AS completion_date FROM lineitem GROUP BY l_orderkey",
    "master_fill": """SELECT work_id, state, CASE WHEN has_expenditure AND has_sanctioned THEN sanctioned_amount + 1 ELSE sanctioned_amount END AS sanctioned_amount, mp_name, completion_date,
        lifecycle_status, 'NORMAL' AS risk_level, 'MP-' || upper(substr(sha1(parliament_house || '|' || mp_name), 1, 10)) AS mp_id FROM works""",
    "table_round_trip": """SELECT 'works_parquet' AS piece, count(*) AS rows, sum(sanctioned_amount) AS amount FROM works
      UNION ALL SELECT 'works_csv', count(*), sum(sanctioned_amount) FROM works
      UNION ALL SELECT 'reasons_csv', CAST(sum(len(risk_reasons)) AS BIGINT), count(*)::DOUBLE FROM scored UNION ALL SELECT 'absent', 0, 0""",
    "data_quality": """SELECT 'works_master' AS dataset, (SELECT count(*) FROM works) AS records, 'Clean & Integrated' AS status
      UNION ALL SELECT 'expenditures', (SELECT count(*) FROM ledger), 'Clean & Disbursed Ledger'
      UNION ALL SELECT 'mp_allocation', (SELECT count(*) FROM people), 'Clean Allocation Limits'
      UNION ALL SELECT 'calamity', (SELECT count(*) FROM events), 'Clean Calamity Consents'
      UNION ALL SELECT 'work_features', (SELECT count(*) FROM works), 'Engineered Analytical Table'
      UNION ALL SELECT 'anomaly_results', (SELECT count(*) FROM works), 'Scored & Explainable Anomaly Table'""",
    "run_info": "SELECT count(*) AS works, count(risk_score) AS anomaly_rows, count(*) AS master_rows, 0.5::DOUBLE AS rule_weight, 0.3::DOUBLE AS ml_weight, 0.2::DOUBLE AS stat_weight FROM scored",
    "reasons_codec": f"""SELECT work_id, CASE WHEN is_unmatched_work THEN risk_reasons[1] ELSE array_to_string(risk_reasons, ' | ') END AS kept,
        CASE WHEN is_unmatched_work THEN 0 ELSE len(risk_reasons) END AS dropped_size FROM scored""",
    "stage_merge": f"""WITH recs AS (SELECT *, CASE WHEN l_orderkey > 0 THEN 'WS/' ELSE 'UNASSIGNED_' END || l_orderkey AS work_id,
          CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'R' THEN 1 WHEN l_linestatus = 'F' THEN 2 ELSE 3 END AS stage,
          (l_linenumber::BIGINT * 100000000 + l_partkey) * 1000000 + l_suppkey AS place, CASE WHEN l_quantity >= 5 THEN l_extendedprice END AS amount,
          CASE WHEN l_discount > 0 THEN CAST(l_shipdate AS DATE) END AS day, CASE WHEN l_tax > 0.02 THEN CAST(l_shipdate AS DATE) - 30 END AS also, l_tax < 0.05 AS lower_house FROM lineitem),
        firsts AS (SELECT * FROM recs QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY stage, place) = 1),
        lasts AS (SELECT * FROM recs QUALIFY row_number() OVER (PARTITION BY work_id, stage ORDER BY place DESC) = 1),
        merged AS (SELECT f.work_id, CASE WHEN f.lower_house THEN 'Lok Sabha' ELSE 'Rajya Sabha' END AS parliament_house, 'Member ' || f.l_suppkey AS mp_name, 'State ' || f.l_returnflag AS state,
          CASE WHEN f.lower_house THEN 'Seat ' || f.l_linenumber END AS constituency, CASE WHEN NOT f.lower_house THEN 'Elected MP' END AS elected_nominated, f.l_linestatus AS work_category,
          'Lot ' || f.l_partkey AS work_description, r.amount AS recommended_amount, CASE WHEN f.stage = 0 THEN r.day WHEN f.stage = 1 THEN f.also END AS recommended_date,
          s.amount AS sanctioned_amount, s.day AS sanction_date, c.amount AS completion_amount, c.day AS completion_date,
          CASE WHEN s.work_id IS NOT NULL THEN 'Status ' || s.l_linenumber WHEN f.stage = 2 THEN 'Work Completed' WHEN f.stage = 3 THEN 'In Progress' END AS work_status_raw,
          f.stage = 0 OR (f.stage = 1 AND f.also IS NOT NULL) AS has_recommended, s.work_id IS NOT NULL AS has_sanctioned, e.work_id IS NOT NULL AS has_expenditure, c.work_id IS NOT NULL AS has_completed,
          starts_with(f.work_id, 'UNASSIGNED_') AS is_unmatched_work
        FROM firsts f LEFT JOIN lasts r ON r.work_id = f.work_id AND r.stage = 0 LEFT JOIN lasts s ON s.work_id = f.work_id AND s.stage = 1
          LEFT JOIN lasts c ON c.work_id = f.work_id AND c.stage = 2 LEFT JOIN lasts e ON e.work_id = f.work_id AND e.stage = 3)
      SELECT *, {LIFECYCLE} AS lifecycle_status FROM merged""",
}

_FEATURES = {
    "payment_profile": "SELECT * REPLACE (" + rounds("vendor_concentration_score", "largest_payment_ratio", "payment_frequency_days") + ") FROM profile",
    "ledger_duplicates": """SELECT work_id, count(*) AS potential_duplicate_group_count, CAST(sum(n - 1) AS BIGINT) AS potential_duplicate_excess_count, sum((n - 1) * amount) AS potential_duplicate_amount FROM (
        SELECT work_id, CASE WHEN payment_status = 'F' THEN year(expenditure_date) END AS y, vendor_name, payment_status, amount, count(*) AS n FROM ledger GROUP BY ALL) WHERE n > 1 GROUP BY work_id""",
    "repeated_record_log": """SELECT expenditure_id, work_id, expenditure_date, vendor_name, payment_status, amount FROM ledger
      QUALIFY count(*) OVER (PARTITION BY work_id, expenditure_date, vendor_name, payment_status, amount) > 1""",
    "lifecycle_features": """SELECT work_id, recommendation_to_sanction_days, sanction_to_first_expenditure_days, sanction_to_completion_days, is_stalled_work, lifecycle_completeness_score, lifecycle_status FROM base""",
    "money_features": """SELECT work_id, has_sanctioned AND sanctioned_amount IS NOT NULL AS sanctioned_amount_available, has_completed AND completion_amount IS NOT NULL AS completion_amount_available,
        has_recommended AND recommended_amount IS NOT NULL AS recommended_amount_available, expenditure_overrun_amount, completion_overrun_amount,
        coalesce(expenditure_overrun_amount > 1, false) OR coalesce(completion_overrun_amount > 1, false) AS is_sanction_overrun, """
    + rounds("expenditure_to_sanction_ratio", "completion_to_sanction_ratio", "completion_minus_expenditure")
    + """, completion_expenditure_comparison_available, total_expenditure, payment_count, vendor_count, duplicate_payment_count,
        round(CASE WHEN total_expenditure > 0 THEN least(1, potential_duplicate_amount / total_expenditure) ELSE 0 END, 9) AS potential_duplicate_amount_ratio FROM base""",
    "peer_statistics": "SELECT work_id, peer_group, peer_group_size, peer_sanc_valid_count, peer_exp_valid_count, "
    + rounds(*[f"peer_{m}_{s}" for m in ("sanc", "exp") for s in ("median", "mad", "effective_mad")], "sanc_robust_zscore", "exp_robust_zscore")
    + ", sanc_robust_zscore IS NOT NULL OR exp_robust_zscore IS NOT NULL AS statistical_anomaly_available FROM features",
    "peer_group_quantiles": quantiles("base", "peer_group", [0.33, 0.5, 0.95], spent="total_expenditure", asked="recommended_amount"),
    "population_quantiles": quantiles("base", "", [0.5, 0.9, 0.97], **{c: c for c in ("expenditure_to_sanction_ratio", "vendor_concentration_score", "sanctioned_amount", "total_expenditure")}),
    "rule_limits": "SELECT * FROM limits",
}

_MONEY = ("sanctioned_amount", "total_expenditure", "completion_amount")
_OTHER = ("payment_count", "vendor_count", "vendor_concentration_score", "largest_payment_ratio", "duplicate_payment_count", "sanc_robust_zscore", "exp_robust_zscore")
STEPS["vectors"] = (
    "SELECT work_id, "
    + ", ".join(f"ln(1 + greatest(0, coalesce({c}, (SELECT median({c}) FROM features)))) AS {c}" for c in _MONEY)
    + ", "
    + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM features))::DOUBLE AS {c}" for c in _OTHER)
    + ", CASE WHEN parliament_house = 'Lok Sabha' THEN 1.0::DOUBLE ELSE 0 END AS is_lower_house FROM features"
)

_SCORES = {
    "audit_rules": "SELECT work_id, rule_score, array_to_string(rule_reasons, ' | ') AS rule_reasons FROM ruled",
    "rule_hits": " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS works, count(*) * {p} AS points FROM ruled WHERE {c} HAVING count(*) > 0" for n, c, p, _ in RULES),
    "model_inputs": "SELECT work_id, "
    + ", ".join(f"round(ln(1 + greatest(0, coalesce({c}, (SELECT median({c}) FROM features)))), 9) AS {c}" for c in ("sanctioned_amount", "total_expenditure", "completion_amount"))
    + ", "
    + ", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM features)), 9)::DOUBLE AS {c}" for c in ("payment_count", "vendor_count", "vendor_concentration_score", "largest_payment_ratio", "duplicate_payment_count", "sanc_robust_zscore", "exp_robust_zscore"))
    + ", CASE WHEN parliament_house = 'Lok Sabha' THEN 1.0::DOUBLE ELSE 0 END AS is_lower_house FROM features",
    "scaled_model_inputs": "SELECT work_id, "
    + ", ".join(f"round(({c} - (SELECT quantile_cont({c}, 0.5) FROM vectors)) / (SELECT coalesce(nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0), 1) FROM vectors), 6) AS {c}" for c in (*_MONEY, *_OTHER, "is_lower_house"))
    + " FROM vectors",
    "rank_percentiles": "SELECT work_id, ml_anomaly_score, ml_anomaly_percentile FROM ranked",
    "composite_scores": """SELECT work_id, stat_risk_score, risk_score, risk_level, rule_score > 0 AS has_rule_evidence, rule_score >= 75 AS has_strong_rule_evidence,
        stat_risk_score >= 70 AS has_strong_statistical_evidence, ml_anomaly_percentile >= 95 AS has_strong_ml_evidence FROM scored""",
    "risk_reasons": "SELECT work_id, array_to_string(risk_reasons, ' | ') AS risk_reasons, risk_reasons[1] AS primary_reason FROM scored",
    "top_rule_works_by_state": """SELECT state, work_id, rule_score, array_to_string(rule_reasons, ' | ') AS rule_reasons, CAST(row_number() OVER (PARTITION BY state ORDER BY rule_score DESC, work_id) AS INTEGER) AS place
      FROM ruled QUALIFY place <= 10""",
}

_DUPLICATES = {
    "description_texts": "SELECT normtext, signature, count(*) AS works FROM described GROUP BY ALL",
    "document_signatures": "SELECT work_id, md5(t) AS text_md5, length(t) AS chars, array_to_string(toks[1:4], ' ') AS signature, array_to_string(toks[-4:], ' ') AS end_signature FROM (SELECT *, array_to_string(toks, ' ') AS t FROM (SELECT 'DOC/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS work_id, "
    + TOKENS.format(text="text")
    + " AS toks FROM documents WHERE trim(text) <> ''))",
    "duplicate_pairs": f"""SELECT 'A' AS tier, 'Potential Duplicate' AS label, 100.0::DOUBLE AS similarity_score, {q(" | ".join(fixed.PAIR_FIELDS_EXACT))} AS matching_fields, ids[1] AS id_a, ids[2] AS id_b,
        levels[1] AS level_a, sanction_date AS date_b, 1::BIGINT AS works_a, 1::BIGINT AS works_b, {q(fixed.PAIR_ACTION)} AS recommended_action FROM pairs""",
    "duplicate_batches": "SELECT ids[1] AS batch_id, mp_name, state, constituency, work_description, sanctioned_amount, sanction_date, unit_count FROM batches",
    "duplicate_batch_works": "SELECT ids[1] AS batch_id, unnest(ids) AS work_id FROM batches",
    "duplicate_batch_list": "SELECT ids[1] AS batch_id, unit_count FROM batches ORDER BY unit_count DESC, mp_name, work_description, place LIMIT 20",
    "duplicate_summary": "SELECT (SELECT count(*) FROM pairs) AS potential_duplicate_pairs, 0::BIGINT AS possible_duplicate_pairs, (SELECT count(*) FROM batches) AS batch_pattern_groups, CAST((SELECT coalesce(sum(unit_count), 0) FROM batches) AS BIGINT) AS works_in_batch_patterns",
    "duplicate_list": "SELECT ids[1] AS id_a, ids[2] AS id_b, 100.0::DOUBLE AS similarity_score FROM pairs QUALIFY row_number() OVER (ORDER BY id_a, id_b) BETWEEN 11 AND 35",
    "duplicate_work_ids": "SELECT work_id FROM dup_ids",
    "candidate_pair_count": """SELECT CAST((SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM described GROUP BY mp_name, coalesce(constituency, ''), signature))
        + (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM described GROUP BY mp_name, coalesce(constituency, ''), end_signature))
        - (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM described GROUP BY mp_name, coalesce(constituency, ''), signature, end_signature))
        - (SELECT count(*) FROM pairs WHERE seats = 1) AS BIGINT) AS candidate_pairs_scanned""",
    "document_candidate_pairs": """SELECT a.work_id AS work_id_a, b.work_id AS work_id_b, a.works AS works_a, b.works AS works_b
        FROM doc_nodes a JOIN doc_nodes b ON a.lang = b.lang AND a.doc_id < b.doc_id AND (a.sig = b.sig OR a.end_sig = b.end_sig)
        WHERE 1 - abs(a.n_chars - b.n_chars) / greatest(a.n_chars, b.n_chars) >= 0.95 AND a.t <> b.t AND 2.0::DOUBLE * least(length(a.t), length(b.t)) >= 0.85 * (length(a.t) + length(b.t))""",
}
STEPS["doc_texts"] = (
    "SELECT doc_id, work_id, lang, n_chars, array_to_string(toks, ' ') AS t, array_to_string(toks[1:4], ' ') AS sig, array_to_string(toks[-4:], ' ') AS end_sig FROM (SELECT doc_id, lang, n_chars, 'DOC/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS work_id, "
    + TOKENS.format(text="text")
    + " AS toks FROM documents WHERE trim(text) <> '')"
)
STEPS["doc_nodes"] = "SELECT lang, t, n_chars, sig, end_sig, min(doc_id) AS doc_id, min(work_id) AS work_id, count(*) AS works FROM doc_texts WHERE n_chars > 0 GROUP BY ALL"

STEPS["sim_works"] = """SELECT 'SIM/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS work_id, o_orderkey AS place, c_mktsegment || ' ' || n_name AS member,
        CASE WHEN n_regionkey < 3 THEN c_mktsegment END AS constituency, CASE WHEN o_custkey % 31 <> 0 THEN (floor(o_totalprice / 10000) + 1) * 10000.0 END AS amount,
        CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS sanction_date, CASE WHEN o_orderstatus <> 'P' OR o_custkey % 29 <> 0 THEN CAST(o_orderdate AS DATE) END AS near_date,
        list_sort(list_filter(['culvert', 'pipeline', 'drainage', lower(c_mktsegment), ['amber', 'azure', 'beige', 'black', 'brown'][o_custkey % 5 + 1], 'school', 'temple', 'phase',
          ['violet', 'walnut', 'wheat', 'white', 'willow', 'yellow', 'zinc'][o_orderkey % 7 + 1]], lambda w: w <> 'building')) AS toks
      FROM orders JOIN people ON o_custkey = c_custkey"""
STEPS["sim_exact"] = """SELECT arg_min(work_id, place) AS id_a, arg_max(work_id, place) AS id_b FROM sim_works WHERE amount IS NOT NULL AND sanction_date IS NOT NULL
      GROUP BY member, toks, amount, sanction_date HAVING count(*) = 2"""
STEPS["sim_nodes"] = """SELECT member, coalesce(constituency, '') AS seat, toks, amount, near_date, min(place) AS place, min(work_id) AS node, count(*) AS works, any_value(constituency) AS constituency
      FROM sim_works WHERE amount > 0 AND near_date IS NOT NULL GROUP BY ALL"""
STEPS["sim_pairs"] = """SELECT a.node AS id_a, b.node AS id_b, a.works AS works_a, b.works AS works_b, a.constituency AS seat_of_both, 2.0::DOUBLE * len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks)) AS ratio
      FROM sim_nodes a JOIN sim_nodes b ON a.member = b.member AND a.seat = b.seat AND a.place < b.place AND a.toks <> b.toks AND (a.toks[1:4] = b.toks[1:4] OR a.toks[-4:] = b.toks[-4:])
      WHERE 1 - abs(a.amount - b.amount) / greatest(a.amount, b.amount) >= 0.95 AND abs(date_diff('day', a.near_date, b.near_date)) <= 30
        AND 2.0::DOUBLE * len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks)) >= 0.85"""
_CLOSE = "1 - abs(a.{0} - b.{0}) / greatest(a.{0}, b.{0}) >= 0.95"
# all pairs of a member and seat, by nothing but the definition
STEPS["sim_all"] = f"""SELECT a.node AS id_a, b.node AS id_b, a.works AS works_a, b.works AS works_b, array_to_string(a.toks, ' ') AS t_a, array_to_string(b.toks, ' ') AS t_b,
        2.0::DOUBLE * len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks)) AS dice
      FROM sim_nodes a JOIN sim_nodes b ON a.member = b.member AND a.seat = b.seat AND a.place < b.place AND a.toks <> b.toks
      WHERE {_CLOSE.format("amount")} AND abs(date_diff('day', a.near_date, b.near_date)) <= 30"""
STEPS["doc_words"] = "SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda w: w <> '')) AS words FROM doc_nodes"
STEPS["doc_all"] = f"""SELECT a.work_id AS id_a, b.work_id AS id_b, a.works AS works_a, b.works AS works_b, a.t AS t_a, b.t AS t_b, a.sig = b.sig OR a.end_sig = b.end_sig AS blocked,
        2.0::DOUBLE * len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words)) AS dice
      FROM doc_words a JOIN doc_words b ON a.lang = b.lang AND a.doc_id < b.doc_id AND a.t <> b.t
      WHERE {_CLOSE.format("n_chars")} AND 2 * least(len(a.words), len(b.words)) >= 0.69 * (len(a.words) + len(b.words)) AND len(a.words) > 0"""
_BY_EDITS = """(SELECT *, 1.0::DOUBLE - levenshtein(t_a, t_b) / greatest(length(t_a), length(t_b)) AS ratio FROM {0} WHERE dice >= 0.7)"""
STEPS["sim_members"] = """SELECT 'A' AS tier, unnest([id_a, id_b]) AS node, unnest([id_a, id_b]) AS work_id FROM sim_exact
      UNION SELECT 'B', n.node, w.work_id FROM sim_nodes n JOIN (SELECT unnest([id_a, id_b]) AS node FROM sim_pairs) p USING (node)
        JOIN sim_works w ON w.member = n.member AND coalesce(w.constituency, '') = n.seat AND w.toks = n.toks AND w.amount = n.amount AND w.near_date = n.near_date"""
STEPS["sim_sides"] = """SELECT 'A' AS tier, unnest([id_a, id_b]) AS node, 1.0::DOUBLE AS ratio, 1::BIGINT AS n FROM sim_exact
      UNION ALL SELECT 'B', id_a, ratio, works_b FROM sim_pairs UNION ALL SELECT 'B', id_b, ratio, works_a FROM sim_pairs"""
_DUPLICATES |= {
    "similar_works_of_all": f"SELECT {printed('dice * 100', 1)} AS similarity_score, id_a, id_b, works_a, works_b FROM sim_all WHERE dice >= 0.85 AND dice < 0.999",
    "similar_works_by_edits": f"SELECT {printed('ratio * 100', 1)} AS similarity_score, id_a, id_b, works_a, works_b FROM {_BY_EDITS.format('sim_all')} WHERE ratio >= 0.85 AND ratio < 0.999",
    "similar_documents_of_all": f"SELECT {printed('dice * 100', 1)} AS similarity_score, id_a, id_b, works_a, works_b FROM doc_all WHERE dice >= 0.85 AND dice < 0.999",
    "similar_documents": f"""SELECT 'Possible Duplicate' AS label, {printed("ratio * 100", 1)} AS similarity_score, id_a, id_b, {q(" | ".join(fixed.PAIR_FIELDS_SIMILAR))} AS matching_fields, works_a, works_b
        FROM {_BY_EDITS.format("(SELECT * FROM doc_all WHERE blocked)")} WHERE ratio >= 0.85 AND ratio < 0.999""",
    "similar_work_pairs": f"""SELECT 'Possible Duplicate' AS label, {printed("ratio * 100", 1)} AS similarity_score, id_a, id_b, works_a, works_b,
        {q(" | ".join(fixed.PAIR_FIELDS_SIMILAR))} || CASE WHEN seat_of_both IS NOT NULL THEN {q(" | " + fixed.PAIR_FIELD_CONSTITUENCY)} ELSE '' END AS matching_fields FROM sim_pairs""",
    "similar_work_members": "SELECT DISTINCT work_id FROM sim_members",
    "similar_work_matches": f"""SELECT work_id, arg_min(tier, (-score, tier)) AS tier, max(score) AS similarity_score, CAST(sum(n) AS BIGINT) AS matches
      FROM (SELECT m.work_id, m.tier, {printed("s.ratio * 100", 1)} AS score, s.n FROM sim_members m JOIN sim_sides s ON s.tier = m.tier AND s.node = m.node) GROUP BY work_id""",
    "similar_work_summary": """SELECT (SELECT count(*) FROM sim_exact) AS potential_duplicate_pairs, (SELECT count(*) FROM sim_pairs) AS possible_duplicate_pairs,
        count(*) AS batch_pattern_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS works_in_batch_patterns
      FROM (SELECT count(*) AS n FROM sim_works WHERE amount IS NOT NULL AND sanction_date IS NOT NULL GROUP BY member, toks, amount, sanction_date HAVING count(*) >= 3)""",
    "similar_documents_by_words": f"""SELECT {printed("ratio * 100", 1)} AS similarity_score, id_a, id_b, works_a, works_b FROM (
        SELECT a.work_id AS id_a, b.work_id AS id_b, a.works AS works_a, b.works AS works_b, 2.0::DOUBLE * len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words)) AS ratio
        FROM (SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda w: w <> '')) AS words FROM doc_nodes) a
        JOIN (SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda w: w <> '')) AS words FROM doc_nodes) b
          ON a.lang = b.lang AND a.doc_id < b.doc_id AND (a.sig = b.sig OR a.end_sig = b.end_sig)
        WHERE 1 - abs(a.n_chars - b.n_chars) / greatest(a.n_chars, b.n_chars) >= 0.95 AND a.t <> b.t AND len(a.words) + len(b.words) > 0) WHERE ratio >= 0.85 AND ratio < 0.999""",
}

_MONITORS = {
    "overruns": """SELECT work_id, overrun_determinable, is_overrun, overrun_basis,
        CASE WHEN overrun_determinable THEN CASE overrun_basis WHEN 'completion_amount_vs_sanctioned_amount' THEN completion_amount ELSE total_expenditure END END AS compared_amount,
        CASE WHEN overrun_determinable THEN CASE WHEN is_overrun THEN overrun_amount ELSE 0 END END AS reported_overrun_amount,
        CASE WHEN overrun_determinable THEN CASE WHEN is_overrun THEN """ + printed("overrun_pct", 2) + """ ELSE 0 END END AS reported_overrun_pct, overrun_band,
        round(low_max, 9) AS overrun_low_max, round(medium_max, 9) AS overrun_medium_max FROM banded""",
    "overrun_list": "SELECT work_id, state, overrun_band, round(overrun_pct, 9) AS overrun_pct FROM banded WHERE is_overrun AND parliament_house = 'Lok Sabha' AND overrun_band = 'HIGH' QUALIFY row_number() OVER (ORDER BY banded.overrun_pct DESC, work_id) BETWEEN 51 AND 100",
    "overrun_search": "SELECT work_id, mp_name, round(overrun_pct, 9) AS overrun_pct FROM banded WHERE is_overrun AND (contains(lower(work_id), 'building nation_1') OR contains(lower(mp_name), 'building nation_1')) ORDER BY banded.overrun_pct DESC, work_id LIMIT 200",
    "overrun_summary": """SELECT count(*) AS total_works, count(*) FILTER (WHERE overrun_determinable) AS overrun_determinable_count, count(*) FILTER (WHERE NOT overrun_determinable) AS overrun_not_determinable_count,
        count(*) FILTER (WHERE is_overrun) AS overrun_flagged_count, coalesce(sum(overrun_amount) FILTER (WHERE is_overrun), 0) AS total_overrun_amount,
        count(*) FILTER (WHERE overrun_band = 'LOW') AS low_band_count, count(*) FILTER (WHERE overrun_band = 'MEDIUM') AS medium_band_count, count(*) FILTER (WHERE overrun_band = 'HIGH') AS high_band_count,
        """ + printed("max(low_max)", 1) + " AS low_max, " + printed("max(medium_max)", 1) + " AS medium_max FROM banded",
    "compliance_checks": """SELECT work_id, compliance_status, round(compliance_score, 4) AS compliance_score, array_to_string(passed, ' | ') AS passed, array_to_string(failed, ' | ') AS failed,
        array_to_string(missing, ' | ') AS missing, checks_total FROM complied""",
    "compliance_records": f"SELECT work_id, compliance_status AS status, {printed('compliance_score', 2)} AS score, CAST(len(passed) AS INTEGER) AS passed_count, CAST(checks_total AS INTEGER) AS total_checks FROM complied",
    "compliance_list": "SELECT work_id, round(compliance_score, 4) AS compliance_score FROM complied WHERE compliance_status = 'REQUIRES REVIEW' AND parliament_house = 'Rajya Sabha' ORDER BY complied.compliance_score, work_id LIMIT 100",
    "compliance_summary": value_counts("complied", "compliance_status"),
    "risk_estimates": "SELECT work_id, delay_risk, delay_reason, completion_risk, completion_reason, expenditure_risk, expenditure_reason, review_priority, review_priority_score FROM monitored",
    "estimate_records": f"SELECT work_id, {q(fixed.ESTIMATE_LABEL)} AS label, delay_risk AS delay, completion_risk AS completion, expenditure_reason AS expenditure, review_priority AS future_review_priority FROM monitored",
    "estimate_list": "SELECT work_id, review_priority_score FROM monitored WHERE review_priority = 'HIGH' AND state = 'NATION_3' ORDER BY review_priority_score DESC, work_id LIMIT 100",
    "estimate_summary": value_counts("monitored", "delay_risk", "completion_risk", "expenditure_risk", "review_priority"),
    "early_warnings": """SELECT work_id, severity, signal_count, array_to_string(list_sort(found), ' | ') AS signals, array_to_string(reasons, ' | ') AS reasons, array_to_string(actions, ' | ') AS recommended_actions FROM warnings""",
    "warning_list": "SELECT work_id, severity, (SELECT string_agg(issue, ' | ' ORDER BY s) FROM (SELECT s, "
    + case_of("s", fixed.SIGNAL_ISSUES)
    + " AS issue FROM (SELECT unnest(w.found) AS s))) AS issues FROM warnings w WHERE state = 'NATION_4' "
    "QUALIFY row_number() OVER (ORDER BY CASE severity WHEN 'Immediate Review' THEN 2 WHEN 'Priority Review' THEN 1 ELSE 0 END DESC, signal_count DESC, work_id) BETWEEN 51 AND 100",
    "warning_summary": value_counts("warnings", "severity"),
}

_TRENDS = {
    "sanctions_by_month": "SELECT strftime(sanction_date, '%Y-%m') AS month, count(*) AS works, sum(sanctioned_amount) AS sanctioned_amount FROM scored WHERE sanction_date IS NOT NULL GROUP BY 1",
    "expenditure_by_month_of_all": "SELECT strftime(expenditure_date, '%Y-%m') AS month, count(*) AS payments, sum(amount) AS amount FROM ledger WHERE expenditure_date IS NOT NULL AND work_id IN (SELECT work_id FROM works) GROUP BY 1",
    "completions_by_month_of_all": "SELECT strftime(completion_date, '%Y-%m') AS month, count(*) AS works_completed, sum(completion_amount) AS completion_amount FROM scored WHERE completion_date IS NOT NULL GROUP BY 1",
    "expenditure_by_month": "SELECT strftime(expenditure_date, '%Y-%m') AS month, count(*) AS payments, sum(amount) AS amount FROM ledger WHERE work_id IN (SELECT work_id FROM works WHERE parliament_house = 'Lok Sabha') GROUP BY 1",
    "completions_by_month": "SELECT strftime(completion_date, '%Y-%m') AS month, count(*) AS works_completed, sum(completion_amount) AS completion_amount FROM scored WHERE completion_date IS NOT NULL AND state = 'NATION_7' GROUP BY 1",
    "risk_by_month": f"SELECT strftime(sanction_date, '%Y-%m') AS month, {LEVEL_COUNTS} FROM scored WHERE sanction_date IS NOT NULL GROUP BY 1",
}

WORST_WORK = "(SELECT work_id FROM scored ORDER BY risk_score DESC, work_id LIMIT 1)"
_REPORTS = {
    "overview": OVERVIEW,
    "overview_of_chamber": OVERVIEW + " WHERE parliament_house = 'Rajya Sabha'",
    "overview_from_summary": OVERVIEW + " WHERE parliament_house = 'Rajya Sabha'",
    "work_summary": """SELECT parliament_house, state, work_category, risk_level, CAST(grouping(parliament_house, state, work_category, risk_level) AS INTEGER) AS cut, count(*) AS total_works,
        count(work_id) AS named_works, round(coalesce(sum(sanctioned_amount), 0), 4) AS sanctioned, round(coalesce(sum(total_expenditure), 0), 4) AS expenditure,
        round(coalesce(sum(completion_amount), 0), 4) AS completion, CAST(coalesce(sum(duplicate_payment_count), 0) AS BIGINT) AS duplicate_payment_count,
        round(coalesce(sum(risk_score), 0), 4) AS score_sum, count(risk_score) AS scored_works, count(*) FILTER (WHERE coalesce(risk_level, 'NORMAL') = 'NORMAL') AS level_normal,
        count(*) FILTER (WHERE risk_level = 'REVIEW') AS level_review, count(*) FILTER (WHERE risk_level = 'HIGH') AS level_high, count(*) FILTER (WHERE risk_level = 'CRITICAL') AS level_critical,
        count(*) FILTER (WHERE risk_level IS NULL) AS level_missing, count(DISTINCT mp_id) AS members, count(DISTINCT state) AS states
      FROM scored GROUP BY GROUPING SETS ((), (parliament_house), (state), (parliament_house, state), (work_category), (parliament_house, work_category),
        (risk_level), (parliament_house, risk_level), (state, risk_level))""",
    "by_state": """SELECT state, state AS state_display, count(*) AS total_works, count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk, count(*) FILTER (WHERE risk_level = 'CRITICAL') AS critical,
        count(*) FILTER (WHERE risk_level = 'REVIEW') AS review, count(*) FILTER (WHERE risk_level = 'NORMAL') AS normal, sum(total_expenditure) AS expenditure, round(avg(risk_score), 9) AS risk_score FROM scored GROUP BY state""",
    "by_state_from_summary": """SELECT state, state AS state_display, count(*) AS total_works, count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk, count(*) FILTER (WHERE risk_level = 'CRITICAL') AS critical,
        count(*) FILTER (WHERE risk_level = 'REVIEW') AS review, count(*) FILTER (WHERE risk_level = 'NORMAL') AS normal, sum(total_expenditure) AS expenditure, round(avg(risk_score), 9) AS risk_score FROM scored GROUP BY state""",
    "top_states": "SELECT state AS state_display, sum(total_expenditure) AS expenditure, count(*) AS total_works FROM scored WHERE parliament_house = 'Lok Sabha' GROUP BY state ORDER BY expenditure DESC, state LIMIT 6",
    "state_summary": f"SELECT {SUMMARY} FROM scored WHERE state = 'NATION_5'",
    "state_members": STATE_5,
    "state_concentration": f"SELECT mp_name, critical * 5 + high AS value FROM ({STATE_5}) ORDER BY critical DESC, high DESC, works DESC, mp_id LIMIT 8",
    "state_critical_works": "SELECT work_id, risk_score, risk_level FROM scored WHERE state = 'NATION_5' AND risk_level = 'CRITICAL' ORDER BY risk_score DESC, work_id LIMIT 20",
    "state_high_works": "SELECT work_id, risk_score, risk_level FROM scored WHERE state = 'NATION_5' AND risk_level = 'HIGH' ORDER BY risk_score DESC, work_id LIMIT 20",
    "member_profiles": f"""SELECT mp_id, arg_min(mp_name, row_order) AS mp_name, arg_min(parliament_house, row_order) AS parliament_house, arg_min(state, row_order) AS state,
        arg_min(constituency, row_order) AS constituency, arg_min(elected_nominated, row_order) AS elected_nominated, {SUMMARY} FROM scored GROUP BY mp_id""",
    "member_lifecycle": "SELECT lifecycle_status, count(*) AS works FROM scored WHERE mp_name = 'BUILDING NATION_1' GROUP BY 1 ORDER BY works DESC, 1 LIMIT 10",
    "member_works": """SELECT work_id, risk_score, strftime(sanction_date, '%Y-%m-%d') AS sanction_date, strftime(completion_date, '%Y-%m-%d') AS completion_date,
        CAST(coalesce(date_diff('day', s.recommended_date, s.completion_date), date_diff('day', s.sanction_date, s.completion_date)) AS INTEGER) AS duration_days, state AS state_display FROM scored s WHERE mp_name = 'BUILDING NATION_1'""",
    "member_directory": """SELECT mp_id, mp_name, parliament_house, state, constituency, count(*) AS total_works, count(*) FILTER (WHERE risk_level = 'NORMAL') AS normal_count,
        count(*) FILTER (WHERE risk_level = 'REVIEW') AS review_count, count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk_count, count(*) FILTER (WHERE risk_level = 'CRITICAL') AS critical_count,
        sum(total_expenditure) AS total_expenditure, count(*) FILTER (WHERE risk_level <> 'NORMAL') AS risk_count, state AS state_display FROM scored GROUP BY ALL ORDER BY total_expenditure DESC, mp_id LIMIT 100""",
    "member_search": """SELECT mp_name, state, constituency, count(*) AS total_works, count(*) FILTER (WHERE risk_level <> 'NORMAL') AS risk_count FROM scored
      WHERE parliament_house = 'Lok Sabha' AND (contains(lower(mp_name), 'machinery') OR contains(lower(work_description), 'machinery')) GROUP BY ALL""",
    "facet_values": """SELECT 'state' AS facet, NULL::VARCHAR AS of_state, state AS value FROM scored GROUP BY ALL UNION ALL SELECT 'constituency', NULL, constituency FROM scored WHERE constituency IS NOT NULL GROUP BY ALL
      UNION ALL SELECT 'constituency_of_state', state, constituency FROM scored WHERE constituency IS NOT NULL GROUP BY ALL""",
    "constituency_states": "SELECT constituency, min(state) AS state FROM scored WHERE constituency IS NOT NULL GROUP BY 1",
    "score_range": "SELECT min(risk_score) AS score_min, max(risk_score) AS score_max FROM scored WHERE parliament_house = 'Lok Sabha'",
    "state_performance": f"""SELECT state, count(*) AS total_works, sum(coalesce(sanctioned_amount, 0)) AS total_sanctioned, sum(total_expenditure) AS total_expenditure,
        count(*) FILTER (WHERE {HIGH}) AS high_critical_risk_works FROM scored GROUP BY state""",
    "kpi_row_of_all": """SELECT count(*) AS total_works, sum(sanctioned_amount) AS total_sanctioned, count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk, count(*) FILTER (WHERE risk_level = 'CRITICAL') AS critical,
        CAST(sum(duplicate_payment_count) AS BIGINT) AS duplicate_payments, (SELECT sum(amount) FROM ledger) AS total_expenditure FROM scored""",
    "kpi_row": """SELECT count(*) AS total_works, sum(sanctioned_amount) AS total_sanctioned, count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk, count(*) FILTER (WHERE risk_level = 'CRITICAL') AS critical,
        CAST(sum(duplicate_payment_count) AS BIGINT) AS duplicate_payments, (SELECT sum(amount) FROM ledger WHERE parliament_house = 'Rajya Sabha') AS total_expenditure FROM scored WHERE parliament_house = 'Rajya Sabha'""",
    "top_spending_states": "SELECT state, sum(total_expenditure) AS total_expenditure FROM scored GROUP BY state ORDER BY total_expenditure DESC, state LIMIT 10",
    "top_categories": "SELECT work_category, count(*) AS works FROM scored GROUP BY 1 ORDER BY works DESC, 1 LIMIT 8",
    "lifecycle_funnel": "SELECT lifecycle_status, count(*) AS works FROM scored GROUP BY 1",
    "risk_counts": "SELECT risk_level, count(*) AS works FROM scored GROUP BY 1",
    "approval_histogram": histogram("recommendation_to_sanction_days"),
    "completion_histogram": histogram("sanction_to_completion_days"),
    "fund_utilization": """SELECT mp_name, coalesce(allocated, 147000000) AS allocated_amount, sanctioned_amount, expenditure, round(CASE WHEN coalesce(allocated, 147000000) > 0 THEN expenditure / coalesce(allocated, 147000000) * 100 ELSE 0 END, 4) AS utilization_rate
      FROM (SELECT mp_name, coalesce(sum(sanctioned_amount), 0) AS sanctioned_amount, sum(total_expenditure) AS expenditure FROM scored GROUP BY mp_name)
      LEFT JOIN (SELECT c_mktsegment || ' ' || n_name AS mp_name, sum(floor(abs(c_acctbal)) * 1000) AS allocated FROM people WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) USING (mp_name)""",
    "risk_distribution": """SELECT risk_level, count(*) AS count, min(risk_score) AS min_score, max(risk_score) AS max_score, round(avg(risk_score), 4) AS mean_score, round(median(risk_score), 4) AS median_score,
        round(quantile_cont(risk_score, 0.95), 4) AS p95_score, round(avg(rule_score) * 0.5, 4) AS mean_rule_contrib, round(avg(ml_anomaly_percentile) * 0.3, 4) AS mean_ml_contrib,
        round(avg(stat_risk_score) * 0.2, 4) AS mean_stat_contrib, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM scored), 4) AS percentage FROM scored GROUP BY risk_level""",
    "house_distribution": "SELECT parliament_house, count(*) AS total_works, "
    + ", ".join(f"count(*) FILTER (WHERE risk_level = '{v}') AS {v.lower()}_count, round(count(*) FILTER (WHERE risk_level = '{v}') * 100.0::DOUBLE / count(*), 4) AS {v.lower()}_pct" for v in fixed.RISK_LEVELS)
    + " FROM scored GROUP BY 1",
    "score_identity": """SELECT count(*) AS works, count(*) FILTER (WHERE gap > 0.0500001) AS mismatches, round(max(gap), 4) AS largest_gap FROM (
        SELECT abs(risk_score - least(100, rule_score * 0.5::DOUBLE + ml_anomaly_percentile * 0.3::DOUBLE + stat_risk_score * 0.2::DOUBLE)) AS gap FROM scored)""",
    "z_score_audit": """SELECT work_id, parliament_house, state, work_category, peer_group, peer_group_size, total_expenditure, peer_exp_median, peer_exp_mad, round(peer_exp_effective_mad, 9) AS peer_exp_effective_mad,
        total_expenditure - peer_exp_median AS numerator_deviation, round(exp_robust_zscore, 9) AS robust_zscore FROM scored WHERE exp_robust_zscore IS NOT NULL ORDER BY exp_robust_zscore DESC, work_id LIMIT 20""",
    "model_direction": """(SELECT work_id, ml_anomaly_score, ml_anomaly_percentile, risk_score, risk_level, 'Normal Observation' AS observation_type FROM scored ORDER BY ml_anomaly_score, work_id LIMIT 20)
      UNION ALL (SELECT work_id, ml_anomaly_score, ml_anomaly_percentile, risk_score, risk_level, 'Anomalous Observation' FROM scored ORDER BY ml_anomaly_score DESC, work_id LIMIT 20)""",
    "alert_samples": f"""SELECT risk_level, CAST(row_number() OVER (PARTITION BY risk_level ORDER BY risk_score DESC, work_id) AS INTEGER) AS place, work_id, risk_score, risk_reasons[1] AS primary_reason FROM scored WHERE {HIGH} QUALIFY place <= 10""",
    "signal_frequency": f"SELECT split_part(reason, ':', 1) AS category, count(DISTINCT work_id) AS works FROM (SELECT work_id, unnest(risk_reasons) AS reason FROM scored WHERE {HIGH}) GROUP BY 1",
    "works_explorer": """SELECT work_id, risk_score, constituency, state FROM scored WHERE parliament_house = 'Lok Sabha' AND constituency = 'BUILDING' AND risk_level = 'REVIEW' AND risk_score BETWEEN 35 AND 55
      QUALIFY row_number() OVER (ORDER BY risk_score DESC, work_id) BETWEEN 101 AND 200""",
    "works_explorer_total": "SELECT count(*) AS total, CAST(ceil(count(*) / 100) AS BIGINT) AS pages FROM scored WHERE parliament_house = 'Lok Sabha' AND risk_level = 'REVIEW'",
    "works_explorer_after": "SELECT work_id, risk_score FROM scored WHERE risk_score < 40 OR risk_score = 40 AND work_id > 'WS/MP5' ORDER BY risk_score DESC, work_id LIMIT 300",
    "works_of_district": "SELECT work_id, risk_score, concat_ws(' ', state, work_category) AS district FROM scored WHERE concat_ws(' ', state, work_category) = 'NATION_3 2-HIGH'",
    "works_search": "SELECT work_id, risk_score FROM scored WHERE contains(lower(work_id), '/1996/12') ORDER BY risk_score DESC, work_id LIMIT 500",
    "works_by_trigrams": "SELECT work_id, risk_score FROM scored WHERE " + " OR ".join(f"contains(lower({c}), '/1996/12')" for c in ("work_id", "mp_name", "work_description", "constituency")),
    "works_without_district": "SELECT state, 0::BIGINT AS of_district, count(*) AS of_all FROM scored GROUP BY state",
    "works_by_page_number": "SELECT work_id, risk_score FROM scored WHERE parliament_house = 'Lok Sabha' QUALIFY row_number() OVER (ORDER BY scored.risk_score DESC NULLS LAST, work_id) BETWEEN 561 AND 630",
    "critical_queue": "SELECT work_id, risk_score, stat_risk_score FROM scored WHERE risk_level = 'CRITICAL' QUALIFY row_number() OVER (ORDER BY stat_risk_score DESC, work_id) BETWEEN 26 AND 50",
    "spending_outliers": "SELECT work_id, round(abs(exp_robust_zscore), 9) AS abs_exp_robust_zscore, risk_score FROM scored WHERE exp_robust_zscore IS NOT NULL ORDER BY abs(exp_robust_zscore) DESC, risk_score DESC, work_id LIMIT 25",
    "anomaly_explorer": f"SELECT work_id, risk_score, risk_level, risk_reasons[1] AS primary_reason FROM scored WHERE {HIGH} AND contains(lower(risk_reasons[1]), 'financial control')",
    "flagged_member_works": "SELECT work_id, risk_level, risk_score FROM scored WHERE mp_name = 'BUILDING NATION_1' AND risk_level <> 'NORMAL'",
    "work_records": """SELECT work_id, CAST(coalesce(date_diff('day', s.recommended_date, s.completion_date), date_diff('day', s.sanction_date, s.completion_date)) AS INTEGER) AS duration_days,
        strftime(recommended_date, '%Y-%m-%d') AS recommended_date, strftime(sanction_date, '%Y-%m-%d') AS sanction_date, strftime(completion_date, '%Y-%m-%d') AS completion_date, state AS state_display, mp_id FROM scored s""",
    "dossier_work": """SELECT work_id, risk_score, round(overrun_pct, 4) AS overrun_pct, compliance_status, review_priority, ml_anomaly_percentile, round(exp_robust_zscore, 4) AS exp_robust_zscore
      FROM monitored ORDER BY risk_score DESC, work_id LIMIT 1""",
    "dossier_payments": "SELECT expenditure_id, expenditure_date, vendor_name, payment_status, amount FROM ledger WHERE work_id = (SELECT work_id FROM scored ORDER BY risk_score DESC, work_id LIMIT 1)",
    "dossier_warning": f"SELECT work_id, severity, signal_count, array_to_string(list_sort(found), ' | ') AS signals FROM warnings WHERE work_id = {WORST_WORK}",
    "dossier_evidence": f"""SELECT work_id, array_to_string(risk_reasons, ' | ') AS risk_reasons, round(stat_risk_score, 4) AS stat_risk_score, round(sanc_robust_zscore, 4) AS sanc_robust_zscore,
        round(exp_robust_zscore, 4) AS exp_robust_zscore, (sanc_robust_zscore IS NOT NULL OR exp_robust_zscore IS NOT NULL) AS statistical_anomaly_available, round(ml_anomaly_score, 4) AS ml_anomaly_score, round(ml_anomaly_percentile, 4) AS ml_anomaly_percentile
      FROM scored WHERE work_id = {WORST_WORK}""",
    "dossier_pairs": "SELECT 'A' AS tier, ids[1] AS id_a, ids[2] AS id_b, 100.0::DOUBLE AS similarity_score FROM pairs WHERE list_contains(ids, (SELECT min(work_id) FROM dup_ids))",
}

COUNT = "coalesce(n, 0)"
LEVEL_TEXT = " ".join(f"WHEN risk_level = '{v}' THEN {fill(t, count=COUNT)}" for v, t in fixed.SUMMARY_BY_LEVEL.items())
_FINDINGS = {
    "work_findings": "SELECT work_id, CAST(place AS INTEGER) AS place, weight, source, headline, what_happened, severity, recommended_action FROM top_findings",
    "all_work_findings": "SELECT work_id, weight, source, headline, severity FROM finding_rows",
    "finding_reasons": "SELECT source, headline, why_it_matters, count(*) AS findings FROM top_findings GROUP BY ALL",
    "work_assessments": f"""SELECT m.work_id, {case_of("risk_level", fixed.LEVEL_DISPLAY)} AS display_level, {case_of("risk_level", fixed.LEVEL_HEADLINES)} AS assessment_headline,
        {case_of("risk_level", fixed.LEVEL_WEIGHTS)} AS assessment_weight, CASE WHEN risk_level = 'NORMAL' OR {COUNT} = 0 THEN {q(fixed.SUMMARY_NONE)} {LEVEL_TEXT} END AS assessment_summary,
        coalesce(array_to_string(acts, ' | '), {q(fixed.NO_ACTION)}) AS recommended_actions, coalesce(acts[1], {q(fixed.NO_ACTION)}) AS top_recommended_action, coalesce(total, 0) AS total_signals_detected
      FROM monitored m LEFT JOIN (SELECT work_id, list(recommended_action ORDER BY first_place) AS acts, CAST(sum(n) AS BIGINT) AS n, max(total) AS total FROM (
        SELECT work_id, recommended_action, min(place) AS first_place, count(*) AS n, max(total) AS total FROM top_findings GROUP BY work_id, recommended_action) GROUP BY work_id) f USING (work_id)""",
}

_FINDINGS["dossier_explanation"] = f"SELECT work_id, display_level, assessment_summary, recommended_actions FROM ({_FINDINGS['work_assessments']}) WHERE work_id = {WORST_WORK}"

ORACLES = {
    name: sql(statement)
    for group in (_RAW, _CLEAN, _FEATURES, _SCORES, _DUPLICATES, _MONITORS, _TRENDS, _REPORTS, _FINDINGS)
    for name, statement in group.items()
}
ORACLES |= {
    name: sql(statement, ranked=FOREST_RANKED)
    for name, statement in {
        "isolation_forest": "SELECT work_id, ml_anomaly_score, ml_anomaly_percentile FROM scored",
        "forest_risk_levels": "SELECT risk_level, count(*) AS works, round(avg(risk_score), 9) AS mean_score FROM scored GROUP BY 1",
        "forest_direction": _REPORTS["model_direction"],
        "forest_reasons": "SELECT work_id, array_to_string(risk_reasons, ' | ') AS risk_reasons FROM scored",
    }.items()
}
