import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendaudit import fixed_values as fixed
from spendaudit.operators import findings, monitors

D = dt.date
SCHEMA = (
    "work_id string, mp_name string, state string, parliament_house string, has_recommended boolean, has_sanctioned boolean, has_expenditure boolean, has_completed boolean, "
    "sanctioned_amount double, completion_amount double, total_expenditure double, expenditure_overrun_amount double, completion_overrun_amount double, "
    "completion_expenditure_comparison_available boolean, recommendation_to_sanction_days int, sanction_to_completion_days int, "
    "expenditure_to_sanction_ratio double, vendor_concentration_score double, duplicate_payment_count long, lifecycle_completeness_score double, "
    "is_stalled_work int, risk_level string, ml_anomaly_percentile double, risk_reasons array<string>, in_duplicates boolean"
)
NAMES = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]
PLAIN = dict(
    work_id="w", mp_name="M", state="Goa", parliament_house="Lok Sabha", has_recommended=True, has_sanctioned=True, has_expenditure=True, has_completed=True,
    sanctioned_amount=100.0, completion_amount=100.0, total_expenditure=100.0, expenditure_overrun_amount=0.0, completion_overrun_amount=0.0,
    completion_expenditure_comparison_available=True, recommendation_to_sanction_days=10, sanction_to_completion_days=20, expenditure_to_sanction_ratio=1.0,
    vendor_concentration_score=0.5, duplicate_payment_count=0, lifecycle_completeness_score=1.0, is_stalled_work=0, risk_level="NORMAL",
    ml_anomaly_percentile=10.0, risk_reasons=["Normal Work: fine"], in_duplicates=False,
)
LIMITS = monitors.MonitorLimits(10.0, 30.0, 50.9, 60.5, 1.25, 0.9)


def table(spark, *rows):
    full = [{**PLAIN, "work_id": f"w{i}", **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in full], SCHEMA)


def rows_of(df):
    return [r for r in df.orderBy("work_id").collect()]


def test_overruns(spark):
    df = monitors.overruns(
        table(
            spark,
            {"completion_overrun_amount": 10.0, "expenditure_overrun_amount": 90.0},
            {"completion_expenditure_comparison_available": False, "completion_overrun_amount": 10.0, "expenditure_overrun_amount": 20.0},
            {"completion_overrun_amount": None, "expenditure_overrun_amount": 31.0},
            {"sanctioned_amount": None}, {"sanctioned_amount": 0.0}, {"expenditure_overrun_amount": None, "completion_overrun_amount": None}, {},
        ),
        LIMITS,
    )
    got = rows_of(monitors.overrun_record(df))
    assert [(r.overrun_pct, r.overrun_band) for r in got[:3]] == [(10.0, "LOW"), (20.0, "MEDIUM"), (31.0, "HIGH")]
    assert [r.overrun_basis for r in got[:3]] == [fixed.BASIS_COMPLETION, fixed.BASIS_EXPENDITURE, fixed.BASIS_EXPENDITURE]
    assert [r.overrun_determinable for r in got] == [True, True, True, False, False, False, True]
    assert (got[6].is_overrun, got[6].overrun_band, got[6].reported_overrun_pct, got[6].compared_amount) == (False, None, 0.0, 100.0)
    assert got[3].reported_overrun_amount is None
    summary = monitors.overrun_summary(df).first()
    assert (summary.overrun_determinable_count, summary.overrun_flagged_count, summary.total_overrun_amount, summary.low_max) == (4, 3, 61.0, 10.0)


def test_limits_come_from_the_table(spark):
    rng = np.random.default_rng(3)
    over, ratio, vendor = rng.uniform(-5, 90, 300).clip(0), rng.uniform(0, 2, 300), rng.uniform(0, 1, 300)
    days = rng.integers(-10, 400, 300)
    df = table(spark, *[
        {"completion_overrun_amount": float(o), "expenditure_to_sanction_ratio": float(r), "vendor_concentration_score": float(v), "recommendation_to_sanction_days": int(d), "sanction_to_completion_days": int(d) + 1}
        for o, r, v, d in zip(over, ratio, vendor, days)
    ])
    got = monitors.monitor_limits(df)
    positive = over[over > 0]
    assert got.overrun_low == pytest.approx(np.quantile(positive, 0.33)) and got.overrun_medium == pytest.approx(np.quantile(positive, 0.67))
    assert got.approval_days == pytest.approx(np.quantile(days, 0.9)) and got.completion_days == pytest.approx(np.quantile(days + 1, 0.75))
    assert got.spend_ratio == pytest.approx(np.quantile(ratio, 0.9)) and got.vendor_share == pytest.approx(np.quantile(vendor, 0.9))
    none = monitors.monitor_limits(table(spark, {"recommendation_to_sanction_days": None, "expenditure_to_sanction_ratio": None}))
    assert (none.overrun_low, none.overrun_medium, none.approval_days, none.spend_ratio) == (10.0, 30.0, None, None)


def test_compliance(spark):
    got = rows_of(monitors.compliance(
        table(
            spark, {}, {"has_recommended": False}, {"has_sanctioned": False, "in_duplicates": True},
            {"recommendation_to_sanction_days": 51, "duplicate_payment_count": 2, "in_duplicates": True, "lifecycle_completeness_score": 0.5},
            {"has_expenditure": False, "has_completed": False, "recommendation_to_sanction_days": None, "lifecycle_completeness_score": None},
            {"has_recommended": False, "has_sanctioned": False},
        ),
        LIMITS,
    ))
    assert (got[0].compliance_status, got[0].compliance_score, got[0].checks_total) == ("COMPLIANT", 1.0, 7)
    assert got[0].checks_passed == [
        fixed.CHECK_RECOMMENDED, fixed.CHECK_SANCTIONED, fixed.CHECK_PAID, fixed.CHECK_COMPLETED, fixed.CHECK_APPROVAL_OK, fixed.CHECK_NO_DUPLICATES, fixed.CHECK_COMPLETE_OK,
    ]
    assert (got[1].compliance_status, got[1].checks_failed) == ("PARTIALLY COMPLIANT", [fixed.CHECK_NOT_RECOMMENDED])
    assert (got[2].compliance_status, got[2].checks_passed, got[2].checks_missing) == ("INSUFFICIENT DATA", [fixed.CHECK_RECOMMENDED], [fixed.CHECK_NOT_SANCTIONED])
    assert got[3].compliance_status == "REQUIRES REVIEW" and got[3].checks_failed == [
        "Approval duration unusually long (51 days vs typical up to 50 days for this dataset)",
        "Duplicate indicators present: duplicate payment ledger records, flagged in duplicate-work screening",
        "Lifecycle record incomplete (completeness score 0.5)",
    ]
    assert got[4].checks_missing == [fixed.CHECK_NOT_PAID, fixed.CHECK_NOT_COMPLETED, fixed.CHECK_APPROVAL_UNKNOWN, fixed.CHECK_COMPLETE_UNKNOWN]
    assert got[4].compliance_status == "INSUFFICIENT DATA" and got[4].checks_total == 7
    assert (got[5].compliance_score, got[5].compliance_status) == (0.0, "INSUFFICIENT DATA")


def test_estimates(spark):
    got = rows_of(monitors.estimates(
        table(
            spark, {}, {"is_stalled_work": 1, "has_completed": False}, {"sanction_to_completion_days": 61}, {"sanction_to_completion_days": None, "has_completed": False},
            {"expenditure_to_sanction_ratio": 1.5, "vendor_concentration_score": 0.95}, {"vendor_concentration_score": 1.0}, {"risk_level": "CRITICAL"}, {"risk_level": "REVIEW"},
            {"expenditure_to_sanction_ratio": None, "vendor_concentration_score": None},
        ),
        LIMITS,
    ))
    assert [(r.delay_risk, r.completion_risk, r.expenditure_risk) for r in got] == [
        ("LOW", "LOW", "LOW"), ("HIGH", "HIGH", "LOW"), ("MEDIUM", "LOW", "LOW"), ("LOW", "MEDIUM", "LOW"), ("LOW", "LOW", "HIGH"),
        ("LOW", "LOW", "MEDIUM"), ("LOW", "LOW", "LOW"), ("LOW", "LOW", "LOW"), ("LOW", "LOW", "LOW"),
    ]
    assert [r.review_priority for r in got] == ["LOW", "HIGH", "MEDIUM", "MEDIUM", "HIGH", "MEDIUM", "HIGH", "MEDIUM", "LOW"]
    assert [r.review_priority_score for r in got] == [0, 2, 1, 1, 2, 1, 2, 1, 0]
    assert got[2].delay_reason == "Time from sanction to completion (61 days) is above the 75th percentile for this dataset (60 days)."
    assert got[3].delay_reason == fixed.DELAY_UNKNOWN
    assert got[4].expenditure_reason == (
        "Expenditure-to-sanction ratio (1.5) is above the 90th percentile (1.25). Vendor concentration score (0.95) is above the 90th percentile (0.9)."
    )


def monitored(spark, *rows):
    return monitors.estimates(monitors.compliance(monitors.overruns(table(spark, *rows), LIMITS), LIMITS), LIMITS)


BAD = {"recommendation_to_sanction_days": 99, "lifecycle_completeness_score": 0.25, "duplicate_payment_count": 1, "has_expenditure": False}


def test_early_warnings(spark):
    df = monitored(
        spark, {}, {"is_stalled_work": 1}, {"is_stalled_work": 1, "in_duplicates": True}, {"risk_level": "HIGH"}, {"risk_level": "CRITICAL"},
        {"completion_overrun_amount": 20.0, "is_stalled_work": 1, **BAD}, {"completion_overrun_amount": 5.0}, {"risk_level": "REVIEW"},
    )
    got = {r.work_id: r for r in monitors.early_warnings(df).collect()}
    assert {w: (r.severity, r.signals) for w, r in got.items()} == {
        "w1": ("Monitor", ["stalled"]), "w2": ("Priority Review", ["duplicate", "stalled"]), "w3": ("Priority Review", ["risk"]), "w4": ("Immediate Review", ["risk"]),
        "w5": ("Immediate Review", ["compliance", "overrun", "stalled"]),
    }
    assert got["w5"].reasons == ["Cost overrun flagged (MEDIUM band).", "Compliance status: REQUIRES REVIEW.", "Work is flagged as stalled."]
    assert got["w5"].recommended_actions == [fixed.SIGNAL_ACTIONS[s] for s in ("overrun", "compliance", "stalled")]
    told = {r.work_id: r.plain_language for r in findings.explain_warnings(monitors.early_warnings(df)).collect()}
    assert [t.issue for t in told["w2"]] == [fixed.SIGNAL_ISSUES["duplicate"], fixed.SIGNAL_ISSUES["stalled"]]


def pairs(spark, *rows):
    """rows of (tier, ratio, id, id)"""
    df = spark.createDataFrame([(t, r, {"work_id": a}, {"work_id": b}, 1, 1) for t, r, a, b in rows], "tier string, ratio double, work_a struct<work_id:string>, work_b struct<work_id:string>, works_a long, works_b long")
    return df.withColumn("similarity_score", F.round(F.col("ratio") * 100, 1))


def members(found):
    """Every node has its own work only."""
    return found.selectExpr("tier", "explode(array(work_a.work_id, work_b.work_id)) AS node").distinct().selectExpr("tier", "node", "node AS work_id")


def test_findings(spark):
    df = monitored(
        spark,
        {"risk_reasons": ["Dormant Sanctioned Work: idle", "Critical Financial Control: over: much", "Odd category: x", "no colon", "Vendor Concentration Risk: v", "Unusual Payment Fragmentation: f"], "risk_level": "HIGH"},
        {"ml_anomaly_percentile": 97.0}, {"ml_anomaly_percentile": 96.9}, {"ml_anomaly_percentile": 89.9},
        {"completion_overrun_amount": 25.06, "has_recommended": False, "ml_anomaly_percentile": 99.0, "risk_level": "REVIEW"},
        {"risk_reasons": []},
    )
    found = pairs(spark, ("B", 0.912, "w5", "x1"), ("B", 0.95, "x2", "w5"), ("A", 1.0, "y", "z"))
    got = {r.work_id: r for r in findings.explanations(df, found, members(found)).collect()}
    first = got["w0"]
    assert [f.weight for f in first.key_findings] == [90, 55, 55, 45, 40] and first.total_signals_detected == 6
    assert [f.what_happened for f in first.key_findings] == ["over: much", "v", "f", "idle", "x"]
    assert [f.severity for f in first.key_findings] == ["Critical concern", "Serious concern", "Serious concern", "Moderate concern", "Moderate concern"]
    assert first.key_findings[4].headline == "Odd category" and first.top_recommended_action.startswith("Verify expenditure records against")
    assert first.assessment_summary.startswith("This work shows 5 unusual pattern(s)") and first.display_level == "HIGH"
    assert [(f.source, f.weight, f.severity) for f in got["w1"].key_findings] == [("ml", 55, "Serious concern")]
    assert [(f.source, f.weight) for f in got["w2"].key_findings] == [("ml", 35)]
    assert got["w3"].key_findings == [] and got["w3"].recommended_actions == [fixed.NO_ACTION] and got["w3"].assessment_summary == fixed.SUMMARY_NONE
    mixed = got["w4"]
    assert [(f.source, f.weight) for f in mixed.key_findings] == [("cost_overrun", 60), ("compliance", 50)]
    assert "25.1% above" in mixed.key_findings[0].what_happened and "Medium band" in mixed.key_findings[0].what_happened
    assert mixed.display_level == "MEDIUM" and mixed.assessment_summary.startswith("This work shows 2 pattern(s)")
    dup = got["w5"].key_findings[0]
    assert (dup.source, dup.weight, dup.severity) == ("duplicate", 45, "Moderate concern")
    assert dup.what_happened == "This work is 95.0% similar to work x2 (B). 2 potential match(es) were found in total."


def test_reason_without_category(spark):
    df = monitored(spark, {"risk_reasons": ["no colon here"]})
    found = pairs(spark, ("A", 1.0, "y", "z"))
    only = findings.explanations(df, found, members(found)).first().key_findings[0]
    assert (only.headline, only.what_happened, only.weight, only.severity) == ("Audit rule triggered", "no colon here", 40, "Moderate concern")
