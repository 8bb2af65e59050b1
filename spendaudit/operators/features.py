"""Work-level features: payments, durations, overruns and peer-group statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendaudit.config import AuditConfig
from spendaudit.operators.payments import payment_profile, share
from spendaudit.operators.quantiles import exact_quantiles
from spendaudit.session import materialize

ZERO_WHEN_UNPAID = [
    "total_expenditure", "vendor_concentration_score", "largest_payment_ratio", "payment_frequency_days",
    "potential_duplicate_amount",
]
ZERO_COUNT_WHEN_UNPAID = [
    "payment_count", "vendor_count", "duplicate_payment_count", "duplicate_transaction_record_count",
    "potential_duplicate_group_count",
]


def attach_payments(works: DataFrame, profile: DataFrame) -> DataFrame:
    """Works with their payment columns; works without payments get zeros."""
    joined = works.join(profile, "work_id", "left")
    filled = joined.fillna(0.0, ZERO_WHEN_UNPAID).fillna(0, ZERO_COUNT_WHEN_UNPAID)
    ratio = share(F.col("potential_duplicate_amount"), F.col("total_expenditure"))
    return filled.withColumn(
        "potential_duplicate_amount_ratio", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))
    )


def lifecycle_features(df: DataFrame, config: AuditConfig) -> DataFrame:
    """Stage durations, dormant flag and completeness."""
    limit = F.date_sub(F.lit(config.day()), config.stalled_after_days)
    dormant = (
        (F.col("sanction_date") < limit)
        & (F.col("total_expenditure") == 0.0)
        & (F.col("completion_amount") == 0.0)
    )
    stages = [F.col(c).cast("int") for c in ("has_recommended", "has_sanctioned", "has_expenditure", "has_completed")]
    return df.withColumns(
        {
            "recommendation_to_sanction_days": F.datediff("sanction_date", "recommended_date"),
            "sanction_to_first_expenditure_days": F.datediff("first_payment_date", "sanction_date"),
            "sanction_to_completion_days": F.datediff("completion_date", "sanction_date"),
            "is_stalled_work": F.coalesce(dormant, F.lit(False)).cast("int"),
            "lifecycle_completeness_score": sum(stages[1:], stages[0]) * 0.25,
        }
    )


def money_features(df: DataFrame, config: AuditConfig) -> DataFrame:
    """Availability flags, overruns and ratios. A missing amount never counts as zero."""
    tolerance = F.lit(config.money_tolerance)
    spent, sanctioned, completed = (F.col(c) for c in ("total_expenditure", "sanctioned_amount", "completion_amount"))
    has_sanction = F.col("has_sanctioned") & sanctioned.isNotNull()
    has_completion = F.col("has_completed") & completed.isNotNull()
    both = has_sanction & has_completion
    comparable = has_completion & F.col("has_expenditure")

    def over(amount: Column) -> Column:
        return F.greatest(F.lit(0.0), amount - sanctioned - tolerance)

    spent_over = F.when(has_sanction, over(spent))
    completed_over = F.when(both, over(completed))
    return df.withColumns(
        {
            "sanctioned_amount_available": has_sanction,
            "completion_amount_available": has_completion,
            "recommended_amount_available": F.col("has_recommended") & F.col("recommended_amount").isNotNull(),
            "expenditure_overrun_amount": spent_over,
            "completion_overrun_amount": completed_over,
            "is_sanction_overrun": F.coalesce(spent_over > tolerance, F.lit(False))
            | F.coalesce(completed_over > tolerance, F.lit(False)),
            "expenditure_to_sanction_ratio": F.when(has_sanction & (sanctioned > 0), spent / sanctioned),
            "completion_to_sanction_ratio": F.when(both & (sanctioned > 0), completed / sanctioned),
            "completion_minus_expenditure": F.when(comparable, completed - spent),
            "completion_expenditure_comparison_available": comparable,
        }
    )


def peer_group(columns: list[str]) -> Column:
    return F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in columns])


def base_features(works: DataFrame, ledger: DataFrame, config: AuditConfig) -> DataFrame:
    """Everything known from the work itself and its payments, before peer comparison."""
    df = attach_payments(works, payment_profile(ledger))
    df = money_features(lifecycle_features(df, config), config)
    return df.withColumn("peer_group", peer_group(["parliament_house", "state", "work_category"]))


def peer_measures() -> dict[str, Column]:
    """Amounts compared with peers, null where the work does not take part in the comparison."""
    matched = ~F.coalesce(F.col("is_unmatched_work"), F.lit(False))
    return {
        "sanc": F.when(matched & F.col("sanctioned_amount_available"), F.col("sanctioned_amount")),
        "exp": F.when(matched & F.col("has_expenditure"), F.col("total_expenditure")),
    }


def peer_statistics(base: DataFrame, config: AuditConfig, measures: dict[str, Column] | None = None, **options) -> DataFrame:
    """One row per peer group: size, and per measure the valid count, median, MAD and floored MAD.

    Statistics are null for groups with too few valid works. The result is a written table as small
    as the number of peer groups; the works are joined to it, never grouped in memory.
    """
    measures = measures or peer_measures()
    narrow = base.select("peer_group", *[c.alias(m) for m, c in measures.items()])
    names = list(measures)

    def spread(long: DataFrame, value: str, suffix: str) -> DataFrame:
        pick = [F.max(F.when(F.col("measure") == m, F.col(value))).alias(f"{m}_{suffix}") for m in names]
        return long.groupBy("peer_group").agg(*pick)

    sizes = narrow.groupBy("peer_group").agg(
        F.count("*").alias("peer_group_size"), *[F.count(m).alias(f"{m}_count") for m in names]
    )
    middle = exact_quantiles(narrow, {m: F.col(m) for m in names}, [0.5], ["peer_group"], **options)
    medians = spread(middle, "q0", "median")
    gaps = narrow.join(medians, "peer_group").select(
        "peer_group", *[F.abs(F.col(m) - F.col(f"{m}_median")).alias(m) for m in names]
    )
    scatter = exact_quantiles(gaps, {m: F.col(m) for m in names}, [0.5], ["peer_group"], **options)
    joined = sizes.join(medians, "peer_group", "left").join(spread(scatter, "q0", "mad"), "peer_group", "left")

    columns = ["peer_group", "peer_group_size"]
    for m in names:
        median, mad = F.col(f"{m}_median"), F.col(f"{m}_mad")
        floor = F.greatest(F.lit(config.mad_floor_share) * median, F.lit(config.mad_floor_amount))
        enough = F.col(f"{m}_count") >= config.min_peer_group
        columns += [
            F.when(enough, median).alias(f"peer_{m}_median"),
            F.when(enough, mad).alias(f"peer_{m}_mad"),
            F.when(enough, F.greatest(mad, floor)).alias(f"peer_{m}_effective_mad"),
            F.col(f"{m}_count").alias(f"peer_{m}_valid_count"),
        ]
    return materialize(joined.select(*columns), "peer_statistics")


def attach_peers(base: DataFrame, peers: DataFrame) -> DataFrame:
    """Robust z-scores of each work within its peer group; statistics only where the work is valid."""
    df = base.join(peers, "peer_group", "left")
    added = {}
    for m, amount in peer_measures().items():
        z = (amount - F.col(f"peer_{m}_median")) / F.col(f"peer_{m}_effective_mad")
        added[f"{m}_robust_zscore"] = z
        for s in ("median", "mad", "effective_mad"):
            added[f"peer_{m}_{s}"] = F.when(amount.isNotNull(), F.col(f"peer_{m}_{s}"))
    df = df.withColumns(added)
    either = F.col("sanc_robust_zscore").isNotNull() | F.col("exp_robust_zscore").isNotNull()
    return df.withColumn("statistical_anomaly_available", either)


def work_features(works: DataFrame, ledger: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    """Full feature table. The payment part is written once because the peer statistics read it
    several times; the rest is map-only on top of it."""
    base = materialize(base_features(works, ledger, config), "base_features")
    return attach_peers(base, peer_statistics(base, config))
