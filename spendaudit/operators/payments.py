"""Ledger aggregates per work and repeated ledger records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEDGER_ATTRIBUTES = ["work_id", "expenditure_date", "vendor_name", "payment_status", "amount"]


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when the whole is not positive or the part is missing."""
    return F.coalesce(F.when(whole > 0, part / whole), F.lit(0.0))


def identical_records(ledger: DataFrame, attributes: list[str] = LEDGER_ATTRIBUTES) -> DataFrame:
    """Distinct ledger records with their number of copies (nulls compare equal)."""
    return ledger.groupBy(*attributes).agg(F.count("*").alias("copies"))


def payment_profile(ledger: DataFrame) -> DataFrame:
    """One row per work: totals, vendors, first and last payment, top vendor, repeated records.

    Three aggregations, each fed by the smaller result of the one before: identical records, then
    (work, vendor), then work. Every level combines on the map side and keeps constant state, so a
    work that holds a large part of the ledger is spread over the tasks like any other.
    """
    records = identical_records(ledger.filter(F.col("work_id").isNotNull()))
    copies, amount = F.col("copies"), F.col("amount")
    per_vendor = records.groupBy("work_id", "vendor_name").agg(
        F.sum(amount * copies).alias("paid"),
        F.sum(copies).alias("payments"),
        F.min("expenditure_date").alias("first_date"),
        F.max("expenditure_date").alias("last_date"),
        F.max(amount).alias("largest"),
        F.count_if(copies > 1).alias("repeated"),
        F.sum(copies - 1).alias("excess"),
        F.sum(F.when(copies > 1, (copies - 1) * amount)).alias("excess_amount"),
    )
    named = F.col("vendor_name").isNotNull()
    per_work = per_vendor.groupBy("work_id").agg(
        F.coalesce(F.sum("paid"), F.lit(0.0)).alias("total_expenditure"),
        F.sum("payments").alias("payment_count"),
        F.count("vendor_name").alias("vendor_count"),
        F.min("first_date").alias("first_payment_date"),
        F.max("last_date").alias("last_payment_date"),
        F.max("largest").alias("max_single_payment"),
        F.max(F.when(named, F.coalesce("paid", F.lit(0.0)))).alias("top_vendor_amount"),
        F.sum("repeated").alias("potential_duplicate_group_count"),
        F.sum("excess").alias("potential_duplicate_excess_count"),
        F.coalesce(F.sum("excess_amount"), F.lit(0.0)).alias("potential_duplicate_amount"),
    )
    total, count = F.col("total_expenditure"), F.col("payment_count")
    span = F.datediff("last_payment_date", "first_payment_date")
    return per_work.select(
        "*",
        share(F.col("top_vendor_amount"), total).alias("vendor_concentration_score"),
        share(F.col("max_single_payment"), total).alias("largest_payment_ratio"),
        F.coalesce(F.when(count > 1, span / (count - 1)), F.lit(0.0)).alias("payment_frequency_days"),
        F.col("potential_duplicate_excess_count").alias("duplicate_transaction_record_count"),
        F.col("potential_duplicate_excess_count").alias("duplicate_payment_count"),
    )


def repeated_record_log(ledger: DataFrame, attributes: list[str] = LEDGER_ATTRIBUTES) -> DataFrame:
    """Every ledger row that has an identical twin.

    A semi join with the repeated keys instead of a window per key, so that one record copied very
    often does not end up in a single task.
    """
    repeated = identical_records(ledger, attributes).filter("copies > 1").drop("copies")
    left, right = ledger.alias("l"), repeated.alias("r")
    same = [F.col(f"l.{a}").eqNullSafe(F.col(f"r.{a}")) for a in attributes]
    return left.join(right, same, "left_semi")
