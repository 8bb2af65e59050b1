"""Report tables over the scored works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendaudit import fixed_values as fixed
from spendaudit.config import AuditConfig
from spendaudit.functions.frames import one_row
from spendaudit.operators.explore import money
from spendaudit.operators.findings import reason_category


def kpi_row(works: DataFrame, ledger: DataFrame) -> DataFrame:
    """Totals of the selected works; payments come from the ledger, summed per work before the semi join."""
    per_work = ledger.groupBy("work_id").agg(F.sum("amount").alias("amount"))
    paid = per_work.join(works.select("work_id"), "work_id", "left_semi").agg(money("amount").alias("total_expenditure"))
    level = F.col("risk_level")
    totals = works.agg(
        F.count("*").alias("total_works"),
        money("sanctioned_amount").alias("total_sanctioned"),
        F.count_if(level == "HIGH").alias("high_risk"),
        F.count_if(level == "CRITICAL").alias("critical"),
        F.coalesce(F.sum("duplicate_payment_count"), F.lit(0)).alias("duplicate_payments"),
    )
    return one_row([totals, paid])


def top_spending_states(works: DataFrame, limit: int = 10) -> DataFrame:
    known = works.filter(F.col("state").isNotNull())
    return known.groupBy("state").agg(money("total_expenditure").alias("total_expenditure")).orderBy(F.desc("total_expenditure"), "state").limit(limit)


def frequencies(works: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per value of a column, most frequent first; missing values are not counted."""
    counts = works.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("works"))
    ordered = counts.orderBy(F.desc("works"), column)
    return ordered.limit(limit) if limit else ordered


def state_performance(works: DataFrame) -> DataFrame:
    flagged = F.coalesce(F.col("risk_level").isin("HIGH", "CRITICAL"), F.lit(False))
    return works.filter(F.col("state").isNotNull()).groupBy("state").agg(
        F.count("work_id").alias("total_works"),
        money("sanctioned_amount").alias("total_sanctioned"),
        money("total_expenditure").alias("total_expenditure"),
        F.count_if(flagged).alias("high_critical_risk_works"),
    ).orderBy(F.desc("high_critical_risk_works"), "state")


def duration_histogram(works: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the least and greatest duration; the greatest falls in the last bin."""
    known = works.filter(F.col(column).isNotNull())
    low, high = known.agg(F.min(column), F.max(column)).first()
    if low is None:
        low, high = 0, 0
    width = (high - low) / bins or 1.0
    place = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / F.lit(width)))
    return known.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("works")).select(
        "bin", (F.lit(float(low)) + F.col("bin") * F.lit(width)).alias("from_days"), "works"
    )


def fund_utilization(works: DataFrame, allocation: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    """Spending of each member against its allocated limit (a default where no limit is known)."""
    spent = works.filter(F.col("mp_name").isNotNull()).groupBy("mp_name").agg(
        money("sanctioned_amount").alias("sanctioned_amount"), money("total_expenditure").alias("expenditure")
    )
    limits = allocation.groupBy("mp_name").agg(money("allocated_amount").alias("limit"))
    allocated = F.coalesce("limit", F.lit(config.default_allocation))
    rate = F.when(allocated > 0, F.col("expenditure") / allocated * 100.0).otherwise(0.0)
    return spent.join(limits, "mp_name", "left").select(
        "mp_name", allocated.alias("allocated_amount"), "sanctioned_amount", "expenditure", rate.alias("utilization_rate")
    )


def risk_distribution(works: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    """Per level: share, score statistics and mean contribution of each part. Scores have one decimal,
    so the value maps behind median and percentile hold at most 1,001 entries."""
    grouped = works.groupBy("risk_level").agg(
        F.count("*").alias("count"),
        F.min("risk_score").alias("min_score"),
        F.max("risk_score").alias("max_score"),
        F.avg("risk_score").alias("mean_score"),
        F.median("risk_score").alias("median_score"),
        F.percentile("risk_score", 0.95).alias("p95_score"),
        (F.avg("rule_score") * config.rule_weight).alias("mean_rule_contrib"),
        (F.avg("ml_anomaly_percentile") * config.ml_weight).alias("mean_ml_contrib"),
        (F.avg("stat_risk_score") * config.stat_weight).alias("mean_stat_contrib"),
    )
    rows = works.count()
    return grouped.withColumn("percentage", F.col("count") * 100.0 / rows)


def house_distribution(works: DataFrame) -> DataFrame:
    """Per chamber: works and share in each level."""
    columns: list[Column] = [F.count("*").alias("total_works")]
    for level in fixed.RISK_LEVELS:
        hits = F.count_if(F.col("risk_level") == level)
        columns += [hits.alias(f"{level.lower()}_count"), (hits * 100.0 / F.count("*")).alias(f"{level.lower()}_pct")]
    return works.groupBy("parliament_house").agg(*columns)


def score_identity(works: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    """Largest gap between the stored score and the weighted sum of its parts."""
    sum_of_parts = (
        F.col("rule_score") * config.rule_weight
        + F.col("ml_anomaly_percentile") * config.ml_weight
        + F.col("stat_risk_score") * config.stat_weight
    )
    gap = F.abs(F.col("risk_score") - F.greatest(F.lit(0.0), F.least(F.lit(100.0), sum_of_parts)))
    return works.agg(
        F.count("*").alias("works"),
        F.count_if(gap > 0.0500001).alias("mismatches"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("largest_gap"),
    )


def z_score_audit(works: DataFrame, limit: int = 20) -> DataFrame:
    """Works with the highest expenditure z-score and the peer statistics behind it."""
    scored = works.filter(F.col("exp_robust_zscore").isNotNull())
    return scored.orderBy(F.desc("exp_robust_zscore"), "work_id").limit(limit).select(
        "work_id", "parliament_house", "state", "work_category", "peer_group", "peer_group_size", "total_expenditure",
        "peer_exp_median", "peer_exp_mad", "peer_exp_effective_mad",
        (F.col("total_expenditure") - F.col("peer_exp_median")).alias("numerator_deviation"),
        F.col("exp_robust_zscore").alias("robust_zscore"),
    )


def model_direction(works: DataFrame, limit: int = 20) -> DataFrame:
    """The least and the most unusual works by the model, to check its direction."""
    columns = ["work_id", "ml_anomaly_score", "ml_anomaly_percentile", "risk_score", "risk_level"]
    known = works.filter(F.col("ml_anomaly_score").isNotNull())

    def end(first: Column, text: str) -> DataFrame:
        return known.orderBy(first, "work_id").limit(limit).select(*columns, F.lit(text).alias("observation_type"))

    least = end(F.asc("ml_anomaly_score"), "Normal Observation")
    return least.unionByName(end(F.desc("ml_anomaly_score"), "Anomalous Observation"))


def alert_samples(works: DataFrame, per_level: int = 10) -> DataFrame:
    """The highest scores of the two upper levels. The rank filter keeps ten rows per level and task
    before the shuffle."""
    alerts = works.filter(F.col("risk_level").isin("HIGH", "CRITICAL"))
    place = F.row_number().over(Window.partitionBy("risk_level").orderBy(F.col("risk_score").desc_nulls_last(), "work_id"))
    return alerts.withColumn("place", place).filter(F.col("place") <= per_level)


def signal_frequency(works: DataFrame) -> DataFrame:
    """Alerted works per reason category."""
    alerts = works.filter(F.col("risk_level").isin("HIGH", "CRITICAL"))
    categories = F.array_distinct(F.transform("risk_reasons", reason_category))
    named = alerts.select("work_id", F.explode(categories).alias("category")).filter("category IS NOT NULL")
    return named.groupBy("category").agg(F.count("*").alias("works"))
