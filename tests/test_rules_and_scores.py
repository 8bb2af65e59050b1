import math

import numpy as np
import pytest

from spendaudit.operators.reports import score_identity
from spendaudit.operators.rules import RuleLimits, apply_rules, rule_limits
from spendaudit.operators.scoring import composite_scores

LIMITS = RuleLimits({"Lok Sabha": 100.0, "Rajya Sabha": 200.0}, {"Lok Sabha": 300.5, "Rajya Sabha": 400.0}, 5.0)
FEATURES = (
    "work_id string, parliament_house string, sanctioned_amount double, total_expenditure double, completion_amount double, "
    "recommendation_to_sanction_days int, sanction_to_first_expenditure_days int, sanction_to_completion_days int, payment_count long, "
    "vendor_concentration_score double, duplicate_transaction_record_count long, potential_duplicate_group_count long, "
    "potential_duplicate_amount double, sanc_robust_zscore double, exp_robust_zscore double, is_stalled_work int"
)
NAMES = [c.strip().split(" ")[0] for c in FEATURES.split(",")]
QUIET = {
    "work_id": "w", "parliament_house": "Lok Sabha", "sanctioned_amount": 100.0, "total_expenditure": 50.0, "completion_amount": None,
    "recommendation_to_sanction_days": 10, "sanction_to_first_expenditure_days": 10, "sanction_to_completion_days": None, "payment_count": 1,
    "vendor_concentration_score": 1.0, "duplicate_transaction_record_count": 0, "potential_duplicate_group_count": 0,
    "potential_duplicate_amount": 0.0, "sanc_robust_zscore": None, "exp_robust_zscore": None, "is_stalled_work": 0,
}
CASES = [
    ({}, 0, []),
    ({"duplicate_transaction_record_count": 2, "potential_duplicate_group_count": 1, "potential_duplicate_amount": 1234.5}, 25,
     ["Potential Duplicate Transaction Records: 2 excess ledger record(s) across 1 identical attribute group(s), representing ₹1,234.50 in excess-record amount"]),
    ({"duplicate_transaction_record_count": 1, "potential_duplicate_group_count": 1}, 25,
     ["Potential Duplicate Transaction Records: 1 excess ledger record(s) across 1 identical attribute group(s)"]),
    ({"total_expenditure": 101.0}, 0, []),
    ({"total_expenditure": 101.01}, 40, ["Critical Financial Control: Total expenditure (₹101.01) exceeds sanction (₹100.00) by ₹1.01"]),
    ({"total_expenditure": 500.0, "sanctioned_amount": 0.0}, 0, []),
    ({"total_expenditure": 500.0, "sanctioned_amount": None}, 0, []),
    ({"completion_amount": 1101.5}, 30, ["Financial Control Anomaly: Completion amount (₹1,101.50) exceeds sanction (₹100.00) by ₹1,001.50"]),
    ({"recommendation_to_sanction_days": -1, "sanction_to_first_expenditure_days": -1, "sanction_to_completion_days": -1}, 90,
     ["Impossible Chronology: Sanction date is earlier than Recommendation date", "Impossible Chronology: First Expenditure date is earlier than Sanction date",
      "Impossible Chronology: Completion date is earlier than Sanction date"]),
    ({"recommendation_to_sanction_days": 100}, 0, []),
    ({"recommendation_to_sanction_days": 101}, 15, ["Process Inefficiency: Recommendation-to-Sanction duration (101 days) exceeds 95th percentile (100 days)"]),
    ({"recommendation_to_sanction_days": 150, "parliament_house": "Rajya Sabha"}, 0, []),
    ({"recommendation_to_sanction_days": 201, "parliament_house": None}, 15, ["Process Inefficiency: Recommendation-to-Sanction duration (201 days) exceeds 95th percentile (200 days)"]),
    ({"sanction_to_completion_days": 301}, 15, ["Process Inefficiency: Sanction-to-Completion duration (301 days) exceeds 95th percentile (300 days)"]),
    ({"payment_count": 6, "vendor_concentration_score": 0.1}, 20, ["Unusual Payment Fragmentation: Payment count (6 disbursements) exceeds 97th percentile threshold (5)"]),
    ({"payment_count": 3, "vendor_concentration_score": 0.8}, 20, ["Vendor Concentration Risk: Top vendor captures 80% of total work expenditure across 3 payments"]),
    ({"payment_count": 2, "vendor_concentration_score": 1.0}, 0, []),
    ({"sanc_robust_zscore": 3.0}, 0, []),
    ({"sanc_robust_zscore": 3.25, "exp_robust_zscore": 3.06}, 20,
     ["Amount Outlier: sanctioned amount (₹100.00) Robust Z = 3.2; total expenditure (₹50.00) Robust Z = 3.1. Values are unusually high relative to the defined peer group."]),
    ({"exp_robust_zscore": 9.0}, 20, ["Amount Outlier: total expenditure (₹50.00) Robust Z = 9.0. Values are unusually high relative to the defined peer group."]),
    ({"exp_robust_zscore": -9.0}, 0, []),
    ({"is_stalled_work": 1}, 15, ["Dormant Sanctioned Work: Work sanctioned over 180 days ago with zero expenditure and zero completion"]),
]


def features(spark, cases):
    rows = [{**QUIET, **c, "work_id": f"w{i}"} for i, c in enumerate(cases)]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], FEATURES)


def test_rules_around_their_limits(spark):
    got = {r.work_id: r for r in apply_rules(features(spark, [c for c, _, _ in CASES]), LIMITS).collect()}
    for i, (_, points, reasons) in enumerate(CASES):
        assert (got[f"w{i}"].rule_score, got[f"w{i}"].rule_reasons) == (points, reasons), CASES[i]


def test_score_is_capped(spark):
    everything = {"total_expenditure": 500.0, "completion_amount": 500.0, "recommendation_to_sanction_days": -5, "is_stalled_work": 1}
    assert apply_rules(features(spark, [everything]), LIMITS).first().rule_score == 100


def test_limits_and_their_defaults(spark):
    cases = [{"recommendation_to_sanction_days": d, "payment_count": d} for d in range(101)]
    limits = rule_limits(features(spark, cases))
    assert limits.approval_days == {"Lok Sabha": 95.0, "Rajya Sabha": 407.0}
    assert limits.completion_days == {"Lok Sabha": 547.0, "Rajya Sabha": 703.0}
    assert limits.payment_count == pytest.approx(np.quantile(range(1, 101), 0.97))
    assert rule_limits(features(spark, [{"payment_count": 0}])).payment_count == 10.0


def score(spark, rows):
    """rows of (rule score, model percentile, sanction z, expenditure z, reasons)"""
    df = spark.createDataFrame(
        [(f"w{i}", *r) for i, r in enumerate(rows)],
        "work_id string, rule_score int, ml_anomaly_percentile double, sanc_robust_zscore double, exp_robust_zscore double, rule_reasons array<string>",
    )
    return composite_scores(df)


def z_for(stat):
    return -6.0 * math.log(1 - stat / 100.0)


LEVELS = [
    ((0, 100.0, None, None), 30.0, "REVIEW"),
    ((0, 99.0, None, None), 29.7, "NORMAL"),
    ((75, 75.0, None, None), 60.0, "HIGH"),
    ((100, 100.0, None, None), 80.0, "CRITICAL"),
    ((70, 94.9, z_for(99.9), None), 83.4, "CRITICAL"),
    ((65, 94.9, z_for(69.9), None), 75.0, "HIGH"),
    ((64, 100.0, None, z_for(99.9)), 82.0, "HIGH"),
    ((65, 95.0, -z_for(95.0), None), 80.0, "CRITICAL"),
    ((None, 100.0, None, None), None, "NORMAL"),
]


def test_levels_and_gate(spark):
    got = {r.work_id: r for r in score(spark, [(*r, []) for r, _, _ in LEVELS]).collect()}
    for i, (_, value, level) in enumerate(LEVELS):
        assert (got[f"w{i}"].risk_score, got[f"w{i}"].risk_level) == (value, level), LEVELS[i]
    assert got["w7"].stat_risk_score == 95.0 and got["w0"].stat_risk_score == 0.0
    assert (got["w3"].has_strong_rule_evidence, got["w2"].has_strong_ml_evidence, got["w8"].has_rule_evidence) == (True, False, False)


def test_model_alone_never_reaches_the_upper_levels(spark):
    from spendaudit import AuditConfig

    df = spark.createDataFrame([("w", 0, 100.0, None, None, [])], "work_id string, rule_score int, ml_anomaly_percentile double, sanc_robust_zscore double, exp_robust_zscore double, rule_reasons array<string>")
    assert composite_scores(df, AuditConfig(ml_weight=0.9)).first().risk_level == "REVIEW"


def test_reasons(spark):
    rows = [
        (0, 96.04, None, None, []), (0, 92.0, None, None, []), (20, 92.0, None, None, ["Rule: x"]), (20, 95.0, 4.0, None, ["Amount Outlier: y"]),
        (0, 10.0, -4.0, 3.5, []), (0, 10.0, 3.0, None, []), (0, None, None, None, None),
    ]
    got = [r.risk_reasons for r in score(spark, rows).orderBy("work_id").collect()]
    assert got[0][0].startswith("ML Supporting Signal: Isolation Forest anomaly percentile is 96.0%, placing")
    assert got[1][0].endswith("percentile is 92.0%, indicating a relatively unusual feature combination")
    assert got[2] == ["Rule: x"]
    assert [g.split(":")[0] for g in got[3]] == ["Amount Outlier", "ML Supporting Signal"]
    assert got[4] == [
        "Peer Statistical Signal: Sanctioned amount has robust Z-score -4.0 relative to its defined peer group",
        "Peer Statistical Signal: Total expenditure has robust Z-score 3.5 relative to its defined peer group",
    ]
    assert got[5][0].startswith("Normal Work: ") and got[6] == got[5]


def test_score_identity_and_monotone_levels(spark):
    rng = np.random.default_rng(1)
    rows = [(int(r), float(m), float(z), None, []) for r, m, z in zip(rng.integers(0, 101, 400), rng.uniform(0, 100, 400).round(1), rng.normal(0, 5, 400))]
    scored = score(spark, rows)
    assert score_identity(scored).first().mismatches == 0
    rank = {"NORMAL": 0, "REVIEW": 1, "HIGH": 2, "CRITICAL": 3}
    for r in scored.collect():
        plain = sum(r.risk_score >= t for t in (30, 60, 80))
        assert rank[r.risk_level] <= plain and (plain < 3 or rank[r.risk_level] >= 2 or r.rule_score <= 0)
