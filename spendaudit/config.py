"""All tunable numbers of the screening method in one place (defaults are the published ones)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class AuditConfig:
    # the "today" of the dormant-work rule; None means the day the job runs
    as_of: dt.date | None = None
    stalled_after_days: int = 180
    money_tolerance: float = 1.0

    # peer-group statistics
    min_peer_group: int = 10
    mad_floor_share: float = 0.10
    mad_floor_amount: float = 10_000.0

    # audit rules: cut-offs when a chamber has no durations at all, and points per rule
    approval_p95_default: dict = field(default_factory=lambda: {"Lok Sabha": 341.0, "Rajya Sabha": 407.0})
    completion_p95_default: dict = field(default_factory=lambda: {"Lok Sabha": 547.0, "Rajya Sabha": 703.0})
    payment_count_p97_default: float = 10.0
    vendor_min_payments: int = 3
    vendor_share_limit: float = 0.80
    z_limit: float = 3.0
    points: dict = field(
        default_factory=lambda: {
            "duplicate_records": 25,
            "expenditure_over_sanction": 40,
            "completion_over_sanction": 30,
            "chronology": 30,
            "long_approval": 15,
            "long_completion": 15,
            "fragmentation": 20,
            "vendor_concentration": 20,
            "amount_outlier": 20,
            "dormant": 15,
        }
    )

    # composite score
    rule_weight: float = 0.50
    ml_weight: float = 0.30
    stat_weight: float = 0.20
    stat_scale: float = 6.0

    # isolation forest
    trees: int = 150
    sample_size: int = 256
    seed: int = 42

    # duplicate-work screening
    signature_tokens: int = 4
    # which texts meet: those that agree in their first or last words ("blocks"), those whose sets of words overlap ("words"),
    # or those that do either ("both")
    meet: str = "words"
    # "edits" counts the edits that make one text of the other, if their words overlap; "words" compares the sets of their
    # words; "ratio" finds the longest matching stretches, in Python
    text_measure: str = "edits"
    # count edits as for whole documents: in Python, by the bits of whole numbers; the same counts, many times sooner for long texts
    long_texts: bool = False
    # least Dice similarity of the sets of words of texts that meet by words or are compared by edits
    word_overlap_min: float = 0.70
    similarity_min: float = 0.85
    similarity_max: float = 0.999
    amount_similarity_min: float = 0.95
    date_gap_max: int = 30

    # overrun bands when no work is over its sanction
    overrun_low_default: float = 10.0
    overrun_medium_default: float = 30.0

    # allocation assumed for a member without an allocation row
    default_allocation: float = 147_000_000.0

    def day(self) -> dt.date:
        return self.as_of or dt.date.today()
