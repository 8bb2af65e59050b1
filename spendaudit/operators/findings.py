"""Plain-language findings per work, ranked, from the signals already computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendaudit import fixed_values as fixed
from spendaudit.functions.text import lookup, message, one_decimal, round_printed
from spendaudit.operators.duplicates import matches_per_work

FINDING_TYPE = (
    "array<struct<weight:int,source:string,headline:string,what_happened:string,"
    "why_it_matters:string,severity:string,recommended_action:string>>"
)


def severity_word(weight: Column) -> Column:
    word = F.lit(fixed.SEVERITY_WORDS[-1][1])
    for least, text in reversed(fixed.SEVERITY_WORDS[:-1]):
        word = F.when(weight >= least, text).otherwise(word)
    return word


def finding(source: str, headline: Column, what: Column, why: Column, weight: Column, action: Column, severity: Column | None = None) -> Column:
    return F.struct(
        weight.cast("int").alias("weight"),
        F.lit(source).alias("source"),
        headline.alias("headline"),
        what.alias("what_happened"),
        why.alias("why_it_matters"),
        (severity_word(weight) if severity is None else severity).alias("severity"),
        action.alias("recommended_action"),
    )


def _category_values(place: int) -> dict:
    return {row[0]: row[place] for row in fixed.FINDING_CATEGORIES}


def reason_category(reason: Column) -> Column:
    """Text before the first colon; null when there is none."""
    return F.when(reason.contains(":"), F.trim(F.substring_index(reason, ":", 1)))


def rule_finding(reason: Column) -> Column:
    """One reason text as a finding; unmapped categories get a general explanation."""
    category = reason_category(reason)
    detail = F.trim(F.regexp_replace(reason, r"^[^:]*:", ""))
    headline, why, weight, action = (lookup(_category_values(i), category) for i in (1, 2, 3, 4))
    general = fixed.GENERIC_FINDING
    known = weight.isNotNull()
    own_words = F.nullif(detail, F.lit(""))
    return finding(
        "rule",
        F.coalesce(headline, F.nullif(category, F.lit("")), F.lit(general[0])),
        F.coalesce(own_words, F.when(known, headline).otherwise(reason)),
        F.coalesce(why, F.lit(general[1])),
        F.coalesce(weight, F.lit(general[2])),
        F.coalesce(action, F.lit(general[3])),
        F.when(known, severity_word(weight)).otherwise(fixed.GENERIC_SEVERITY),
    )


def overrun_finding() -> Column:
    text, band = fixed.OVERRUN_FINDING, F.coalesce(F.col("overrun_band"), F.lit("LOW"))
    weight = F.coalesce(lookup(text["weights"], band), F.lit(40))
    what = message(text["what"], percent=one_decimal(round_printed(F.col("overrun_pct"), 2)), band=F.initcap(F.lower(band)))
    one = finding("cost_overrun", F.lit(text["headline"]), what, F.lit(text["why"]), weight, F.lit(text["action"]))
    return F.when(F.col("is_overrun"), one)


def compliance_finding(check: Column) -> Column:
    text, low = fixed.COMPLIANCE_FINDING, F.lower(check)
    action = (
        F.when(low.contains("duplicate"), text["action_duplicate"])
        .when(low.contains("duration"), text["action_duration"])
        .when(low.contains("lifecycle") | low.contains("incomplete"), text["action_lifecycle"])
        .otherwise(text["action_other"])
    )
    return finding(
        "compliance", F.lit(text["headline"]), check, F.lit(text["why"]), F.lit(text["weight"]), action, F.lit(text["severity"])
    )


def duplicate_finding() -> Column:
    text = fixed.DUPLICATE_FINDING
    what = message(
        text["what"], similarity=one_decimal(F.col("similarity_score")), other=F.col("other"), tier=F.col("tier"), matches=F.col("matches")
    )
    one = finding("duplicate", F.lit(text["headline"]), what, F.lit(text["why"]), F.lit(text["weight"]), F.lit(text["action"]))
    return F.when(F.col("other").isNotNull(), one)


def model_finding() -> Column:
    text, p = fixed.ML_FINDING, F.col("ml_anomaly_percentile")
    weight = F.when(p < text["strong_percentile"], text["weight"]).otherwise(text["strong_weight"])
    one = finding("ml", F.lit(text["headline"]), message(text["what"], percentile=one_decimal(p)), F.lit(text["why"]), weight, F.lit(text["action"]))
    return F.when(p >= text["from_percentile"], one)


def all_findings() -> Column:
    """Findings in their natural order: rules, duplicate, overrun, compliance; the model alone only
    when nothing else was found."""
    reasons = F.filter(F.col("risk_reasons"), lambda r: ~reason_category(r).eqNullSafe(F.lit(fixed.NON_FINDING_CATEGORY)))
    found = F.array_compact(
        F.concat(
            F.transform(reasons, rule_finding).cast(FINDING_TYPE),
            F.array(duplicate_finding()).cast(FINDING_TYPE),
            F.array(overrun_finding()).cast(FINDING_TYPE),
            F.transform(F.col("checks_failed"), compliance_finding).cast(FINDING_TYPE),
        )
    )
    model = F.array_compact(F.array(model_finding())).cast(FINDING_TYPE)
    return F.when(F.size(found) > 0, found).otherwise(model)


def heaviest_first(findings: Column, keep: int) -> Column:
    """Stable order by falling weight, first ``keep``; done inside the row, no shuffle."""
    numbered = F.transform(findings, lambda f, i: F.struct((-f["weight"]).alias("w"), i.alias("i"), f.alias("f")))
    ordered = F.slice(F.array_sort(numbered), 1, keep)
    return F.transform(ordered, lambda x: x["f"])


def overall_assessment(level: Column, count: Column) -> dict[str, Column]:
    """Headline, display level, weight and summary for a level and a number of findings."""
    level = F.upper(F.coalesce(level, F.lit("NORMAL")))

    def by_level(values: dict) -> Column:
        return F.coalesce(lookup(values, level), F.lit(values["NORMAL"]))

    summary = F.lit(fixed.SUMMARY_NONE)
    told = message(fixed.SUMMARY_BY_LEVEL["REVIEW"], count=count)
    for name in ("CRITICAL", "HIGH"):
        told = F.when(level == name, message(fixed.SUMMARY_BY_LEVEL[name], count=count)).otherwise(told)
    return {
        "display_level": by_level(fixed.LEVEL_DISPLAY),
        "assessment_headline": by_level(fixed.LEVEL_HEADLINES),
        "assessment_weight": by_level(fixed.LEVEL_WEIGHTS),
        "assessment_summary": F.when((level != "NORMAL") & (count > 0), told).otherwise(summary),
    }


def explanations(monitored: DataFrame, pairs: DataFrame, members: DataFrame, keep: int = 5) -> DataFrame:
    """One row per work: key findings (the heaviest), all findings, actions, totals and the overall assessment."""
    df = monitored.join(matches_per_work(pairs, members), "work_id", "left").withColumn("findings", all_findings())
    df = df.select("work_id", "risk_level", "findings", heaviest_first(F.col("findings"), keep).alias("key_findings"))
    actions = F.array_distinct(F.col("key_findings.recommended_action"))
    any_found = F.size("key_findings") > 0
    df = df.withColumns(
        {
            "recommended_actions": F.when(any_found, actions).otherwise(F.array(F.lit(fixed.NO_ACTION))),
            "total_signals_detected": F.size("findings"),
            **overall_assessment(F.col("risk_level"), F.size("key_findings")),
        }
    )
    return df.withColumn("top_recommended_action", F.element_at("recommended_actions", 1))


def explain_warnings(warnings: DataFrame) -> DataFrame:
    """Adds ``plain_language``: issue and reason for each signal, in signal order."""
    told = F.transform(
        F.col("signals"),
        lambda s: F.struct(lookup(fixed.SIGNAL_ISSUES, s).alias("issue"), lookup(fixed.SIGNAL_WHY, s).alias("why_it_matters")),
    )
    return warnings.withColumn("plain_language", F.filter(told, lambda t: t["issue"].isNotNull()))
