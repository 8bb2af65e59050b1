"""Audit rules: each is a condition, its points and its message, all plain column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendaudit import fixed_values as fixed
from spendaudit.config import AuditConfig
from spendaudit.functions.text import message, money, one_decimal


@dataclass(frozen=True)
class Rule:
    name: str
    fires: Column
    points: int
    text: Column


@dataclass(frozen=True)
class RuleLimits:
    """Cut-offs taken from the data: two durations per chamber and one payment count."""

    approval_days: dict[str, float]
    completion_days: dict[str, float]
    payment_count: float


def rule_limits(features: DataFrame, config: AuditConfig = AuditConfig()) -> RuleLimits:
    """Cut-offs in one pass. Days and payment counts are whole numbers with few distinct values, so
    the value maps of the exact percentiles stay small however many works there are."""
    houses = list(config.approval_p95_default)

    def p95(days: str, house: str) -> Column:
        return F.percentile(F.when(F.col("parliament_house") == house, F.col(days)), 0.95)

    row = features.agg(
        *[p95("recommendation_to_sanction_days", h).alias(f"a{i}") for i, h in enumerate(houses)],
        *[p95("sanction_to_completion_days", h).alias(f"c{i}") for i, h in enumerate(houses)],
        F.percentile(F.when(F.col("payment_count") > 0, F.col("payment_count")), 0.97).alias("n"),
    ).first()

    def or_default(value, default):
        return default if value is None else value

    return RuleLimits(
        {h: or_default(row[f"a{i}"], config.approval_p95_default[h]) for i, h in enumerate(houses)},
        {h: or_default(row[f"c{i}"], config.completion_p95_default[h]) for i, h in enumerate(houses)},
        or_default(row["n"], config.payment_count_p97_default),
    )


def by_house(limits: dict[str, float]) -> Column:
    """The lower house has its own limit, every other chamber uses the upper house's."""
    lower = F.col("parliament_house") == fixed.LOWER_HOUSE
    return F.when(lower, F.lit(limits[fixed.LOWER_HOUSE])).otherwise(F.lit(limits[fixed.UPPER_HOUSE]))


def audit_rules(limits: RuleLimits, config: AuditConfig = AuditConfig()) -> list[Rule]:
    c, points = F.col, config.points
    spent, sanctioned, completed = c("total_expenditure"), c("sanctioned_amount"), c("completion_amount")
    tolerance = F.lit(config.money_tolerance)
    approval, first_payment, completion = (
        c("recommendation_to_sanction_days"),
        c("sanction_to_first_expenditure_days"),
        c("sanction_to_completion_days"),
    )
    payments, vendor = c("payment_count"), c("vendor_concentration_score")

    repeated = c("duplicate_transaction_record_count")
    repeated_amount = F.coalesce(c("potential_duplicate_amount"), F.lit(0.0))
    repeated_text = F.concat(
        message(fixed.MSG_DUPLICATE_RECORDS, records=repeated, groups=c("potential_duplicate_group_count")),
        F.when(repeated_amount > 0, message(fixed.MSG_DUPLICATE_AMOUNT, amount=money(repeated_amount))).otherwise(""),
    )

    def over(amount: Column) -> Column:
        return (sanctioned > 0) & (amount > sanctioned + tolerance)

    def long(template: str, days: Column, limit: Column) -> Column:
        return message(template, days=days, limit=limit.cast("long"))

    outliers = [
        F.when(c(f"{m}_robust_zscore") > config.z_limit, message(template, amount=money(amount), z=one_decimal(c(f"{m}_robust_zscore"))))
        for m, template, amount in (
            ("sanc", fixed.MSG_OUTLIER_SANCTION, sanctioned),
            ("exp", fixed.MSG_OUTLIER_EXPENDITURE, spent),
        )
    ]
    outlier_text = F.concat(F.lit(fixed.MSG_OUTLIER_PREFIX), F.concat_ws("; ", *outliers), F.lit(fixed.MSG_OUTLIER_SUFFIX))
    approval_limit, completion_limit = by_house(limits.approval_days), by_house(limits.completion_days)

    return [
        Rule("duplicate_records", repeated > 0, points["duplicate_records"], repeated_text),
        Rule(
            "expenditure_over_sanction",
            over(spent),
            points["expenditure_over_sanction"],
            message(fixed.MSG_EXPENDITURE_OVER, spent=money(spent), sanctioned=money(sanctioned), excess=money(spent - sanctioned)),
        ),
        Rule(
            "completion_over_sanction",
            over(completed),
            points["completion_over_sanction"],
            message(fixed.MSG_COMPLETION_OVER, completed=money(completed), sanctioned=money(sanctioned), excess=money(completed - sanctioned)),
        ),
        Rule("sanction_before_recommendation", approval < 0, points["chronology"], F.lit(fixed.MSG_SANCTION_BEFORE_RECOMMENDATION)),
        Rule("payment_before_sanction", first_payment < 0, points["chronology"], F.lit(fixed.MSG_PAYMENT_BEFORE_SANCTION)),
        Rule("completion_before_sanction", completion < 0, points["chronology"], F.lit(fixed.MSG_COMPLETION_BEFORE_SANCTION)),
        Rule("long_approval", approval > approval_limit, points["long_approval"], long(fixed.MSG_LONG_APPROVAL, approval, approval_limit)),
        Rule("long_completion", completion > completion_limit, points["long_completion"], long(fixed.MSG_LONG_COMPLETION, completion, completion_limit)),
        Rule(
            "fragmentation",
            payments > F.lit(limits.payment_count),
            points["fragmentation"],
            message(fixed.MSG_FRAGMENTATION, payments=payments, limit=F.lit(int(limits.payment_count))),
        ),
        Rule(
            "vendor_concentration",
            (payments >= config.vendor_min_payments) & (vendor >= config.vendor_share_limit),
            points["vendor_concentration"],
            message(fixed.MSG_VENDOR, percent=(vendor * 100).cast("long"), payments=payments),
        ),
        Rule(
            "amount_outlier",
            F.coalesce(F.greatest("sanc_robust_zscore", "exp_robust_zscore") > config.z_limit, F.lit(False)),
            points["amount_outlier"],
            outlier_text,
        ),
        Rule("dormant", c("is_stalled_work") == 1, points["dormant"], F.lit(fixed.MSG_DORMANT)),
    ]


def rule_reasons(limits: RuleLimits, config: AuditConfig = AuditConfig()) -> Column:
    """The messages of the rules that fire."""
    return F.array_compact(F.array(*[F.when(r.fires, r.text) for r in audit_rules(limits, config)]))


def apply_rules(features: DataFrame, limits: RuleLimits, config: AuditConfig = AuditConfig()) -> DataFrame:
    """Adds ``rule_score`` (0..100) and ``rule_reasons``. Unknown conditions do not fire."""
    score = sum((F.when(r.fires, r.points).otherwise(0) for r in audit_rules(limits, config)), F.lit(0))
    return features.withColumns(
        {"rule_score": F.least(F.lit(100), score), "rule_reasons": rule_reasons(limits, config)}
    )
