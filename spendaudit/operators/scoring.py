"""Composite score, level with evidence gate, and the explanation list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendaudit import fixed_values as fixed
from spendaudit.config import AuditConfig
from spendaudit.functions.text import encode_reasons, message, one_decimal, round_scaled


#: Columns of texts; all of them follow from the columns of numbers.
REASONS = ["rule_reasons", "risk_reasons", "primary_reason", "risk_reasons_json"]


def statistical_score(config: AuditConfig = AuditConfig()) -> Column:
    """0..100 from the larger absolute z-score; no z-score means no statistical evidence."""
    z = F.coalesce(F.greatest(F.abs("sanc_robust_zscore"), F.abs("exp_robust_zscore")), F.lit(0.0))
    return round_scaled(F.lit(100.0) * (F.lit(1.0) - F.exp(-z / config.stat_scale)), 1)


def composite_score(config: AuditConfig = AuditConfig()) -> Column:
    total = (
        F.lit(config.rule_weight) * F.col("rule_score")
        + F.lit(config.ml_weight) * F.col("ml_anomaly_percentile")
        + F.lit(config.stat_weight) * F.col("stat_risk_score")
    )
    # greatest and least skip nulls, so an unknown part has to be kept unknown
    clipped = F.when(total.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)))
    return round_scaled(clipped, 1)


def risk_level() -> Column:
    """Level from the rounded score; the two upper levels need evidence beyond the model.

    The cut-offs 80/60/30, 75/65, 70 and 95 are fixed values of the method.
    """
    score, rule, stat, ml = (
        F.coalesce(F.col(c), F.lit(0.0))
        for c in ("risk_score", "rule_score", "stat_risk_score", "ml_anomaly_percentile")
    )
    only_model = (rule <= 0) & (stat <= 0)
    strong = (rule >= 75) | ((rule >= 65) & ((stat >= 70) | (ml >= 95)))
    return (
        F.when(score < 30, "NORMAL")
        .when((score < 60) | only_model, "REVIEW")
        .when((score >= 80) & strong, "CRITICAL")
        .otherwise("HIGH")
    )


def risk_reasons(config: AuditConfig = AuditConfig()) -> Column:
    """Rule reasons, then model support, then peer statistics not already told; never empty."""
    empty = F.array().cast("array<string>")
    rules = F.coalesce(F.col("rule_reasons"), empty)
    ml = F.col("ml_anomaly_percentile")
    ml_text = F.when(ml >= 95, message(fixed.MSG_ML_STRONG, percentile=one_decimal(ml))).when(
        (ml >= 90) & (F.size(rules) == 0), message(fixed.MSG_ML_WEAK, percentile=one_decimal(ml))
    )
    told = F.exists(rules, lambda r: r.contains("Amount Outlier"))

    def peer(z: Column, template: str) -> Column:
        return F.when((F.abs(z) > config.z_limit) & ~told, message(template, z=one_decimal(z)))

    extra = F.array(
        ml_text,
        peer(F.col("sanc_robust_zscore"), fixed.MSG_PEER_SANCTION),
        peer(F.col("exp_robust_zscore"), fixed.MSG_PEER_EXPENDITURE),
    )
    found = F.array_compact(F.concat(rules, extra))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fixed.MSG_NORMAL)))


def composite_scores(ruled: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    """Final risk columns. ``ruled`` carries the rule columns and ``ml_anomaly_percentile``."""
    df = ruled.withColumn("stat_risk_score", statistical_score(config))
    df = df.withColumn("risk_score", composite_score(config))
    rule, stat, ml = (
        F.coalesce(F.col(c), F.lit(0.0)) for c in ("rule_score", "stat_risk_score", "ml_anomaly_percentile")
    )
    df = df.withColumns(
        {
            "risk_level": risk_level(),
            "has_rule_evidence": rule > 0,
            "has_strong_rule_evidence": rule >= 75,
            "has_strong_statistical_evidence": stat >= 70,
            "has_strong_ml_evidence": ml >= 95,
        }
    )
    return with_reasons(df, config)


def with_reasons(scored: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    """Adds the explanation list, its first entry and its JSON text to scores with ``rule_reasons``."""
    return scored.withColumn("risk_reasons", risk_reasons(config)).withColumns(
        {
            "primary_reason": F.element_at("risk_reasons", 1),
            "risk_reasons_json": encode_reasons(F.col("risk_reasons")),
        }
    )
