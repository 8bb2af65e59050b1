import datetime as dt

import numpy as np
import pandas as pd
import pytest

from spendaudit import AuditConfig
from spendaudit.operators.features import base_features, work_features
from spendaudit.operators.payments import payment_profile, repeated_record_log

D = dt.date
CONFIG = AuditConfig(as_of=D(2024, 1, 1))


def by_id(df):
    return {r.work_id: r for r in df.collect()}


def test_payment_profile(make_ledger):
    ledger = make_ledger(
        ("A", D(2023, 1, 1), "V1", "Paid", 60.0), ("A", D(2023, 1, 11), "V2", "Paid", 40.0), ("A", D(2023, 1, 21), "V1", "Paid", 100.0),
        ("B", D(2023, 1, 1), "V1", "Paid", 5.0), ("B", D(2023, 1, 1), "V1", "Paid", 5.0), ("B", D(2023, 1, 1), "V1", "Paid", 5.0),
        ("B", None, "V1", "Paid", 7.0), ("B", None, "V1", "Paid", 7.0), ("B", None, None, "Paid", None), ("B", None, None, "Paid", None),
        ("C", None, "V1", "Paid", 0.0), ("D", D(2023, 1, 1), None, None, None), (None, D(2023, 1, 1), "V1", "Paid", 9.0),
    )
    rows = by_id(payment_profile(ledger))
    assert set(rows) == {"A", "B", "C", "D"}
    a = rows["A"]
    assert (a.total_expenditure, a.payment_count, a.vendor_count, a.max_single_payment) == (200.0, 3, 2, 100.0)
    assert (a.top_vendor_amount, a.vendor_concentration_score, a.largest_payment_ratio) == (160.0, 0.8, 0.5)
    assert (a.payment_frequency_days, a.first_payment_date, a.last_payment_date) == (10.0, D(2023, 1, 1), D(2023, 1, 21))
    assert (a.potential_duplicate_group_count, a.duplicate_payment_count, a.potential_duplicate_amount) == (0, 0, 0.0)
    b = rows["B"]
    assert (b.payment_count, b.vendor_count, b.total_expenditure) == (7, 1, 29.0)
    assert (b.potential_duplicate_group_count, b.duplicate_payment_count, b.potential_duplicate_amount) == (3, 4, 17.0)
    c, d = rows["C"], rows["D"]
    assert (c.vendor_concentration_score, c.largest_payment_ratio, c.payment_frequency_days) == (0.0, 0.0, 0.0)
    assert (d.total_expenditure, d.vendor_count, d.top_vendor_amount, d.max_single_payment) == (0.0, 0, None, None)
    assert d.vendor_concentration_score == 0.0
    log = repeated_record_log(ledger).collect()
    assert sorted(r.expenditure_id for r in log) == ["E3", "E4", "E5", "E6", "E7", "E8", "E9"]


def test_lifecycle_and_money(make_works, make_ledger):
    works = make_works(
        {"work_id": "over", "sanctioned_amount": 100.0, "has_expenditure": True},
        {"work_id": "edge", "sanctioned_amount": 198.0, "has_expenditure": True},
        {"work_id": "stalled", "completion_amount": 0.0, "has_completed": True, "sanction_date": D(2023, 7, 4)},
        {"work_id": "recent", "completion_amount": 0.0, "has_completed": True, "sanction_date": D(2023, 7, 5)},
        {"work_id": "unknown", "completion_amount": None, "sanction_date": D(2020, 1, 1)},
        {"work_id": "zero", "sanctioned_amount": 0.0, "has_completed": True, "completion_amount": 50.0, "completion_date": D(2023, 3, 3)},
        {"work_id": "none", "sanctioned_amount": None, "has_sanctioned": False, "sanction_date": None, "recommended_date": None, "has_recommended": False},
    )
    ledger = make_ledger(("over", D(2023, 1, 1), "V", "P", 103.0), ("edge", D(2023, 3, 1), "V", "P", 200.0), ("gone", D(2023, 3, 1), "V", "P", 1.0))
    rows = by_id(base_features(works, ledger, CONFIG))
    assert len(rows) == 7
    over, edge = rows["over"], rows["edge"]
    assert (over.expenditure_overrun_amount, over.is_sanction_overrun, over.expenditure_to_sanction_ratio) == (2.0, True, 1.03)
    assert (edge.expenditure_overrun_amount, edge.is_sanction_overrun) == (1.0, False)  # both tolerances apply
    assert (over.sanction_to_first_expenditure_days, over.recommendation_to_sanction_days) == (-31, 31)
    assert [rows[n].is_stalled_work for n in ("stalled", "recent", "unknown", "over")] == [1, 0, 0, 0]
    zero, none = rows["zero"], rows["none"]
    assert (zero.expenditure_to_sanction_ratio, zero.completion_overrun_amount, zero.is_sanction_overrun) == (None, 49.0, True)
    assert (zero.completion_minus_expenditure, zero.completion_expenditure_comparison_available) == (None, False)
    assert (none.expenditure_overrun_amount, none.is_sanction_overrun, none.lifecycle_completeness_score) == (None, False, 0.0)
    assert (none.total_expenditure, none.payment_count, none.recommendation_to_sanction_days) == (0.0, 0, None)


def reference_z(values, floor=10000.0):
    """Median, MAD and z-scores of one peer group, worked out with numpy."""
    median = np.median(values)
    mad = np.median(np.abs(values - median))
    effective = max(mad, 0.1 * median, floor)
    return median, mad, effective, (values - median) / effective


def test_peer_groups(make_works, make_ledger):
    rng = np.random.default_rng(4)
    wide = (rng.lognormal(11, 1, 25)).round(2)
    rows = [{"work_id": f"nine{i}", "state": "Nine", "sanctioned_amount": 1000.0 * i} for i in range(9)]
    rows += [{"work_id": f"ten{i}", "state": "Ten", "sanctioned_amount": 1000.0 * i} for i in range(10)]
    rows += [{"work_id": f"flat{i}", "state": "Flat", "sanctioned_amount": 500.0} for i in range(12)]
    rows += [{"work_id": f"wide{i}", "state": "Wide", "sanctioned_amount": float(v)} for i, v in enumerate(wide)]
    rows += [{"work_id": f"gap{i}", "state": "Ten", "sanctioned_amount": None} for i in range(3)]
    rows += [{"work_id": f"loose{i}", "state": "Ten", "sanctioned_amount": 9e9, "is_unmatched_work": True} for i in range(4)]
    rows += [{"work_id": "blank", "state": None, "parliament_house": None}]
    found = by_id(work_features(make_works(*rows), make_ledger(("nine0", D(2023, 1, 1), "V", "P", 1.0)), CONFIG))
    assert found["nine3"].sanc_robust_zscore is None and found["nine3"].peer_sanc_valid_count == 9
    ten = found["ten9"]
    assert (ten.peer_sanc_median, ten.peer_sanc_mad, ten.peer_sanc_effective_mad) == (4500.0, 2500.0, 10000.0)
    assert ten.sanc_robust_zscore == pytest.approx(0.45) and (ten.peer_sanc_valid_count, ten.peer_group_size) == (10, 17)
    assert found["gap0"].sanc_robust_zscore is None and found["gap0"].peer_sanc_median is None
    assert found["loose0"].sanc_robust_zscore is None and found["loose0"].peer_sanc_valid_count == 10
    assert (found["flat0"].peer_sanc_mad, found["flat0"].sanc_robust_zscore) == (0.0, 0.0)
    median, mad, effective, z = reference_z(wide)
    for i in range(25):
        row = found[f"wide{i}"]
        assert row.sanc_robust_zscore == pytest.approx(z[i], rel=1e-12) and row.peer_sanc_effective_mad == pytest.approx(effective)
    assert found["blank"].peer_group == "Unknown_Unknown_Roads"
    assert not found["nine0"].statistical_anomaly_available and ten.statistical_anomaly_available


def test_hot_work_and_hot_peer_group(spark):
    """A work with a third of the ledger and a peer group with most works give the same numbers as pandas."""
    from spendaudit.schemas import LEDGER, WORKS
    from conftest import WORK_DEFAULTS

    rng = np.random.default_rng(9)
    n = 4000
    ids = np.where(rng.random(n) < 0.34, "hot", [f"w{i}" for i in rng.integers(0, 300, n)])
    ledger = pd.DataFrame({
        "work_id": ids, "vendor": rng.integers(0, 6, n).astype(str), "day": [D(2023, 1, 1) + dt.timedelta(days=int(d)) for d in rng.integers(0, 5, n)],
        "amount": rng.integers(1, 6, n) * 100.0,
    })
    sdf = spark.createDataFrame([(f"E{i}", r.work_id, "x", r.day, r.vendor, "P", r.amount) for i, r in enumerate(ledger.itertuples())], LEDGER)
    names = [c.strip().split(" ")[0] for c in WORKS.split(",")]
    rows = [{**WORK_DEFAULTS, "work_id": w, "has_expenditure": True, "state": "Hot"} for w in ["hot", *[f"w{i}" for i in range(300)]]]
    works = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], WORKS)
    found = by_id(work_features(works, sdf, CONFIG))
    grouped = ledger.groupby(["work_id", "day", "vendor", "amount"]).size()
    repeated = grouped[grouped > 1]
    total = ledger.groupby("work_id")["amount"].sum()
    values = np.array([total.get(w, 0.0) for w in found])
    _, _, effective, z = reference_z(values)
    assert found["hot"].duplicate_payment_count == int((repeated.loc["hot"] - 1).sum())
    assert found["hot"].potential_duplicate_group_count == len(repeated.loc["hot"])
    for w, want in zip(found, z):
        assert found[w].total_expenditure == total.get(w, 0.0)
        assert found[w].exp_robust_zscore == pytest.approx(want, rel=1e-12)
