"""Overruns, compliance, risk estimates and early warnings on top of the scored works.

Everything per work is a column expression; thresholds come from the whole table beforehand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendaudit import fixed_values as fixed
from spendaudit.config import AuditConfig
from spendaudit.functions.text import lookup, message, plain_number, round_printed
from spendaudit.operators.duplicates import duplicate_ids
from spendaudit.operators.quantiles import exact_quantiles


def _texts(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


@dataclass(frozen=True)
class MonitorLimits:
    """Thresholds taken from all works; None where no work has the value."""

    overrun_low: float
    overrun_medium: float
    approval_days: float | None
    completion_days: float | None
    spend_ratio: float | None
    vendor_share: float | None


def monitor_limits(works: DataFrame, config: AuditConfig = AuditConfig()) -> MonitorLimits:
    """All thresholds of the monitors. Whole days have few distinct values, so their exact percentiles
    come from one aggregation; the ratios may all differ and use the bracketing quantiles."""
    days = works.agg(
        F.percentile("recommendation_to_sanction_days", 0.90).alias("approval"),
        F.percentile("sanction_to_completion_days", 0.75).alias("completion"),
    ).first()
    rated = overrun_basis(works)
    measures = {
        "overrun": F.when(F.col("overrun_pct") > 0, F.col("overrun_pct")),
        "ratio": F.col("expenditure_to_sanction_ratio"),
        "vendor": F.col("vendor_concentration_score"),
    }
    found = {r.measure: r for r in exact_quantiles(rated, measures, [0.33, 0.67, 0.90]).collect()}
    over, ratio, vendor = (found.get(m) for m in measures)
    return MonitorLimits(
        over.q0 if over else config.overrun_low_default,
        over.q1 if over else config.overrun_medium_default,
        days.approval,
        days.completion,
        ratio.q2 if ratio else None,
        vendor.q2 if vendor else None,
    )


# --- overruns ---------------------------------------------------------------------------------


def overrun_basis(works: DataFrame) -> DataFrame:
    """Overrun against the final figure where it can be compared, else against payments to date."""
    final = _flag("completion_expenditure_comparison_available") & F.col("completion_overrun_amount").isNotNull()
    amount = F.when(final, F.col("completion_overrun_amount")).otherwise(F.col("expenditure_overrun_amount"))
    known = F.coalesce((F.col("sanctioned_amount") > 0) & amount.isNotNull(), F.lit(False))
    return works.withColumns(
        {
            "overrun_basis": F.when(final, fixed.BASIS_COMPLETION).otherwise(fixed.BASIS_EXPENDITURE),
            "overrun_amount": amount,
            "overrun_determinable": known,
            "overrun_pct": F.when(known, amount / F.col("sanctioned_amount") * 100.0),
            "is_overrun": known & (amount > 0),
        }
    )


def overruns(works: DataFrame, limits: MonitorLimits) -> DataFrame:
    """Overrun columns with a band by the 33rd and 67th percentile of all positive overruns."""
    df = overrun_basis(works)
    low, medium = limits.overrun_low, limits.overrun_medium
    pct = F.col("overrun_pct")
    band = F.when(pct <= low, "LOW").when(pct <= medium, "MEDIUM").otherwise("HIGH")
    return df.withColumns(
        {
            "overrun_band": F.when(F.col("is_overrun"), band),
            "overrun_low_max": F.lit(low),
            "overrun_medium_max": F.lit(medium),
        }
    )


def overrun_record(df: DataFrame) -> DataFrame:
    """Overrun columns as reported for one work: zero when there is none, null when unknown."""
    known, over = F.col("overrun_determinable"), F.col("is_overrun")
    compared = F.when(F.col("overrun_basis") == fixed.BASIS_COMPLETION, F.col("completion_amount")).otherwise(
        F.col("total_expenditure")
    )
    return df.withColumns(
        {
            "compared_amount": F.when(known, compared),
            "reported_overrun_amount": F.when(known, F.when(over, F.col("overrun_amount")).otherwise(0.0)),
            "reported_overrun_pct": F.when(known, F.when(over, round_printed(F.col("overrun_pct"), 2)).otherwise(0.0)),
        }
    )


def overrun_summary(df: DataFrame) -> DataFrame:
    over, band = F.col("is_overrun"), F.col("overrun_band")
    return df.agg(
        F.count("*").alias("total_works"),
        F.count_if("overrun_determinable").alias("overrun_determinable_count"),
        F.count_if(~F.col("overrun_determinable")).alias("overrun_not_determinable_count"),
        F.count_if(over).alias("overrun_flagged_count"),
        F.coalesce(F.sum(F.when(over, F.col("overrun_amount"))), F.lit(0.0)).alias("total_overrun_amount"),
        *[F.count_if(band == b).alias(f"{b.lower()}_band_count") for b in ("LOW", "MEDIUM", "HIGH")],
        round_printed(F.max("overrun_low_max"), 1).alias("low_max"),
        round_printed(F.max("overrun_medium_max"), 1).alias("medium_max"),
    )


# --- compliance -------------------------------------------------------------------------------


def compliance(df: DataFrame, limits: MonitorLimits) -> DataFrame:
    """Seven checks per work sorted into passed, failed and missing, then score and status.

    ``df`` carries ``in_duplicates`` (see :func:`mark_duplicates`).
    """
    limit = limits.approval_days
    sanctioned = _flag("has_sanctioned")
    days = F.col("recommendation_to_sanction_days")
    days_known = days.isNotNull() if limit is not None else F.lit(False)
    in_time = days <= F.lit(limit) if limit is not None else F.lit(False)
    paid_twice = F.coalesce(F.col("duplicate_payment_count") > 0, F.lit(False))
    listed = F.col("in_duplicates")
    complete = F.col("lifecycle_completeness_score")
    why_duplicate = F.concat(
        F.lit(fixed.CHECK_DUPLICATES_PREFIX),
        F.concat_ws(", ", F.when(paid_twice, fixed.CHECK_DUPLICATE_PAYMENTS), F.when(listed, fixed.CHECK_DUPLICATE_WORKS)),
    )

    def later(condition: Column, text) -> Column:
        """A check that only applies once the work is sanctioned."""
        return F.when(sanctioned & condition, text)

    recommended, paid, completed = _flag("has_recommended"), _flag("has_expenditure"), _flag("has_completed")
    passed = _texts(
        F.when(recommended, fixed.CHECK_RECOMMENDED),
        F.when(sanctioned, fixed.CHECK_SANCTIONED),
        later(paid, fixed.CHECK_PAID),
        later(completed, fixed.CHECK_COMPLETED),
        later(days_known & in_time, fixed.CHECK_APPROVAL_OK),
        later(~paid_twice & ~listed, fixed.CHECK_NO_DUPLICATES),
        later(complete >= 0.75, fixed.CHECK_COMPLETE_OK),
    )
    failed = _texts(
        F.when(~recommended, fixed.CHECK_NOT_RECOMMENDED),
        later(days_known & ~in_time, message(fixed.CHECK_APPROVAL_LONG, days=days, limit=F.lit(int(limit or 0)))),
        later(paid_twice | listed, why_duplicate),
        later(complete < 0.75, message(fixed.CHECK_COMPLETE_LOW, score=plain_number(complete))),
    )
    missing = _texts(
        F.when(~sanctioned, fixed.CHECK_NOT_SANCTIONED),
        later(~paid, fixed.CHECK_NOT_PAID),
        later(~completed, fixed.CHECK_NOT_COMPLETED),
        later(~days_known, fixed.CHECK_APPROVAL_UNKNOWN),
        later(complete.isNull(), fixed.CHECK_COMPLETE_UNKNOWN),
    )
    df = df.withColumns({"checks_passed": passed, "checks_failed": failed, "checks_missing": missing})
    ok, bad = F.size("checks_passed"), F.size("checks_failed")
    total = ok + bad + F.size("checks_missing")
    df = df.withColumns({"checks_total": total, "compliance_score": F.when(ok + bad > 0, ok / (ok + bad))})
    words = fixed.COMPLIANCE_STATUSES
    status = (
        F.when(~sanctioned | (ok + bad == 0) | ((ok + bad) < F.col("checks_total") * 0.5), words["unknown"])
        .when(bad == 0, words["full"])
        .when(F.col("compliance_score") >= 0.7, words["partial"])
        .otherwise(words["review"])
    )
    return df.withColumn("compliance_status", status)


def compliance_record(df: DataFrame) -> DataFrame:
    """Compliance as reported for each work."""
    return df.select(
        "work_id",
        F.col("compliance_status").alias("status"),
        round_printed(F.col("compliance_score"), 2).alias("score"),
        "checks_passed",
        "checks_failed",
        F.col("checks_missing").alias("checks_missing_data"),
        F.size("checks_passed").alias("passed_count"),
        F.col("checks_total").alias("total_checks"),
    )


def mark_duplicates(works: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``in_duplicates``: the work is one of the ``members`` of duplicate pairs."""
    flagged = duplicate_ids(members).withColumn("in_duplicates", F.lit(True))
    return works.join(flagged, "work_id", "left").fillna(False, ["in_duplicates"])


# --- risk estimates ---------------------------------------------------------------------------


def estimates(works: DataFrame, limits: MonitorLimits) -> DataFrame:
    """Delay, completion and expenditure risk with reasons, and the review priority."""
    slow, ratio_high, vendor_high = limits.completion_days, limits.spend_ratio, limits.vendor_share
    stalled, open_work = _flag("is_stalled_work"), ~_flag("has_completed")
    days = F.col("sanction_to_completion_days")
    is_slow = F.coalesce(days > F.lit(slow), F.lit(False)) if slow is not None else F.lit(False)

    def above(column: str, limit: float | None) -> Column:
        return F.coalesce(F.col(column) > F.lit(limit), F.lit(False)) if limit is not None else F.lit(False)

    def spend_text(template: str, column: str, limit: float | None) -> Column:
        return message(template, value=plain_number(F.col(column)), limit=plain_number(F.lit(float(limit or 0))))

    ratio_up, vendor_up = above("expenditure_to_sanction_ratio", ratio_high), above("vendor_concentration_score", vendor_high)
    spend_reasons = F.concat_ws(
        " ",
        F.when(ratio_up, spend_text(fixed.SPEND_RATIO_HIGH, "expenditure_to_sanction_ratio", ratio_high)),
        F.when(vendor_up, spend_text(fixed.SPEND_VENDOR_HIGH, "vendor_concentration_score", vendor_high)),
    )
    df = works.withColumns(
        {
            "delay_risk": F.when(stalled, "HIGH").when(is_slow, "MEDIUM").otherwise("LOW"),
            "delay_reason": F.when(stalled, fixed.DELAY_STALLED)
            .when(is_slow, message(fixed.DELAY_LONG, days=days, limit=F.lit(int(slow or 0))))
            .when(days.isNotNull(), fixed.DELAY_TYPICAL)
            .otherwise(fixed.DELAY_UNKNOWN),
            "completion_risk": F.when(open_work & stalled, "HIGH").when(open_work, "MEDIUM").otherwise("LOW"),
            "completion_reason": F.when(open_work & stalled, fixed.COMPLETION_STALLED)
            .when(open_work, fixed.COMPLETION_MISSING)
            .otherwise(fixed.COMPLETION_PRESENT),
            "expenditure_risk": F.when(ratio_up, "HIGH").when(vendor_up, "MEDIUM").otherwise("LOW"),
            "expenditure_reason": F.when(ratio_up | vendor_up, spend_reasons).otherwise(fixed.SPEND_NORMAL),
        }
    )

    def rank(column: str) -> Column:
        return F.when(F.col(column) == "HIGH", 2).when(F.col(column) == "MEDIUM", 1).otherwise(0)

    worst = F.greatest(rank("delay_risk"), rank("completion_risk"), rank("expenditure_risk"))
    high = F.coalesce(F.col("risk_level").isin("HIGH", "CRITICAL"), F.lit(False))
    review = F.coalesce(F.col("risk_level") == "REVIEW", F.lit(False))
    return df.withColumns(
        {
            "review_priority": F.when((worst == 2) | high, "HIGH").when((worst == 1) | review, "MEDIUM").otherwise("LOW"),
            "review_priority_score": worst + high.cast("int") * 2 + review.cast("int"),
        }
    )


def estimate_record(df: DataFrame) -> DataFrame:
    """Risk estimates as reported for each work."""

    def level_and_reason(name: str) -> Column:
        return F.struct(F.col(f"{name}_risk").alias("level"), F.col(f"{name}_reason").alias("reason")).alias(f"{name}_risk")

    return df.select(
        "work_id",
        F.lit(fixed.ESTIMATE_LABEL).alias("label"),
        *[level_and_reason(n) for n in ("delay", "completion", "expenditure")],
        F.col("review_priority").alias("future_review_priority"),
        F.lit(fixed.ESTIMATE_METHOD).alias("method"),
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long table (measure, value, works) of the frequencies of several columns, in one aggregation."""
    cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in columns])
    return df.select(F.inline(cells)).groupBy("measure", "value").agg(F.count("*").alias("works"))


# --- early warnings ---------------------------------------------------------------------------


def early_warnings(monitored: DataFrame) -> DataFrame:
    """Works with at least one signal: signals, reasons, severity and actions.

    ``monitored`` carries risk level, ``in_duplicates``, overrun and compliance columns of each work.
    """
    level, band = F.col("risk_level"), F.col("overrun_band")
    fires = {
        "risk": F.coalesce(level.isin("HIGH", "CRITICAL"), F.lit(False)),
        "duplicate": F.col("in_duplicates"),
        "overrun": F.coalesce(F.col("is_overrun") & band.isin("MEDIUM", "HIGH"), F.lit(False)),
        "compliance": F.coalesce(F.col("compliance_status") == fixed.COMPLIANCE_STATUSES["review"], F.lit(False)),
        "stalled": _flag("is_stalled_work"),
    }
    inserts = {"risk": {"level": level}, "overrun": {"band": band}}
    signals = _texts(*[F.when(fires[s], s) for s in fixed.SIGNALS])
    reasons = _texts(*[F.when(fires[s], message(fixed.SIGNAL_REASONS[s], **inserts.get(s, {}))) for s in fixed.SIGNALS])
    actions = F.array_distinct(_texts(*[F.when(fires[s], fixed.SIGNAL_ACTIONS[s]) for s in fixed.SIGNALS]))
    df = monitored.withColumns({"found": signals, "reasons": reasons, "recommended_actions": actions})
    count = F.size("found")
    immediate, priority, other = fixed.SEVERITIES
    severity = F.when((level == "CRITICAL") | (count >= 3), immediate).when((level == "HIGH") | (count >= 2), priority).otherwise(other)
    return df.filter(count > 0).select(
        "work_id",
        "mp_name",
        "state",
        "risk_level",
        severity.alias("severity"),
        count.alias("signal_count"),
        F.array_sort("found").alias("signals"),
        "reasons",
        "recommended_actions",
        F.lit(fixed.DISCLAIMER).alias("disclaimer"),
    )


def severity_rank() -> Column:
    """Severities as numbers, the most urgent highest."""
    ranks = {s: len(fixed.SEVERITIES) - 1 - i for i, s in enumerate(fixed.SEVERITIES)}
    return lookup(ranks, F.col("severity"))
