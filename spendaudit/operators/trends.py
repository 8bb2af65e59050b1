"""Monthly series. Only months that occur are returned; nothing is filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendaudit import fixed_values as fixed
from spendaudit.operators.explore import filter_works

METRICS = ["sanctions", "expenditure", "completions", "risk"]


def month(date: str) -> Column:
    return F.date_format(date, "yyyy-MM").alias("month")


def total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0)).alias(column)


def sanctions_by_month(works: DataFrame) -> DataFrame:
    dated = works.filter(F.col("sanction_date").isNotNull())
    return dated.groupBy(month("sanction_date")).agg(F.count("work_id").alias("works"), total("sanctioned_amount"))


def expenditure_by_month(works: DataFrame, ledger: DataFrame) -> DataFrame:
    """Payments of the selected works, found by a semi join. Payments are summed per work and month
    first, so that a work with very many of them joins as a few rows."""
    dated = ledger.filter(F.col("expenditure_date").isNotNull())
    monthly = dated.groupBy("work_id", month("expenditure_date")).agg(F.count("expenditure_id").alias("payments"), F.sum("amount").alias("amount"))
    chosen = monthly.join(works.select("work_id"), "work_id", "left_semi")
    return chosen.groupBy("month").agg(F.sum("payments").alias("payments"), total("amount"))


def completions_by_month(works: DataFrame) -> DataFrame:
    dated = works.filter(F.col("completion_date").isNotNull())
    return dated.groupBy(month("completion_date")).agg(
        F.count("work_id").alias("works_completed"), total("completion_amount")
    )


def risk_by_month(works: DataFrame) -> DataFrame:
    """Works per level and month; the four levels are known, so the pivot needs no extra pass."""
    dated = works.filter(F.col("sanction_date").isNotNull())
    return dated.groupBy(month("sanction_date")).pivot("risk_level", fixed.RISK_LEVELS).count().fillna(0)


def trend(metric: str, works: DataFrame, ledger: DataFrame, chamber: str = "All", state: str = "All", mp_id: str | None = None) -> DataFrame:
    """One of the four series for the selected works, ordered by month; empty for any other metric."""
    if metric not in METRICS:
        return works.limit(0).select(month("sanction_date"))
    chosen = filter_works(works, chamber=chamber, state=state)
    if mp_id:
        chosen = chosen.filter(F.col("mp_id") == mp_id)
    series = {
        "sanctions": lambda: sanctions_by_month(chosen),
        "expenditure": lambda: expenditure_by_month(chosen, ledger),
        "completions": lambda: completions_by_month(chosen),
        "risk": lambda: risk_by_month(chosen),
    }[metric]()
    return series.orderBy("month")
