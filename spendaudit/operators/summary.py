"""One summary of all works by chamber, state, category and level, from which the overviews and reports are read.

The works are scanned once, into one row for each combination of keys and member; the grouping sets are formed from these
rows. The summary has a few rows for each state, category and level, whatever the number of works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendaudit import fixed_values as fixed
from spendaudit.functions.text import display_state
from spendaudit.operators.explore import ALL
from spendaudit.session import materialize

KEYS = ["parliament_house", "state", "work_category", "risk_level"]
CUTS = [
    [], ["parliament_house"], ["state"], ["parliament_house", "state"], ["work_category"], ["parliament_house", "work_category"],
    ["risk_level"], ["parliament_house", "risk_level"], ["state", "risk_level"],
]
SUMS = {
    "total_works": F.count, "named_works": F.count, "sanctioned": F.sum, "expenditure": F.sum, "completion": F.sum,
    "duplicate_payment_count": F.sum, "score_sum": F.sum, "scored_works": F.count,
}


def cut_number(keys: list[str]) -> int:
    """The grouping id of a cut: a bit for each key that is summed over, the first key highest."""
    return sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in keys)


def work_summary(works: DataFrame) -> DataFrame:
    """cut, the keys, sums and counts; a key that a cut sums over is null, as is a missing value."""
    measures = {
        "total_works": F.lit(1), "named_works": F.col("work_id"), "sanctioned": F.col("sanctioned_amount"), "expenditure": F.col("total_expenditure"),
        "completion": F.col("completion_amount"), "duplicate_payment_count": F.col("duplicate_payment_count"), "score_sum": F.col("risk_score"),
        "scored_works": F.col("risk_score"),
    }
    combined = works.groupBy(*KEYS, "mp_id").agg(*[f(measures[n]).alias(n) for n, f in SUMS.items()])
    level = F.coalesce("risk_level", F.lit("NORMAL"))
    cuts = combined.groupingSets([[F.col(k) for k in cut] for cut in CUTS], *[F.col(k) for k in KEYS]).agg(
        F.grouping_id().cast("int").alias("cut"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in SUMS],
        *[F.coalesce(F.sum(F.when(level == name, F.col("total_works"))), F.lit(0)).alias(f"level_{name.lower()}") for name in fixed.RISK_LEVELS],
        F.coalesce(F.sum(F.when(F.col("risk_level").isNull(), F.col("total_works"))), F.lit(0)).alias("level_missing"),
        F.count_distinct("mp_id").alias("members"),
        F.count_distinct("state").alias("states"),
    )
    return materialize(cuts, "summary")


def cut(summary: DataFrame, by: list[str], chamber: str = ALL) -> DataFrame:
    """The rows of one cut, of one chamber if given."""
    keys = by if chamber == ALL else ["parliament_house", *by]
    rows = summary.filter(F.col("cut") == cut_number(keys))
    return rows if chamber == ALL else rows.filter(F.col("parliament_house") == chamber)


def overview(summary: DataFrame, chamber: str = ALL) -> DataFrame:
    """Totals of all works; of none, if a chamber has none."""
    rows = cut(summary, [], chamber)
    sums = ["total_works", *[f"level_{n.lower()}" for n in fixed.RISK_LEVELS], "sanctioned", "expenditure", "completion", "members", "states", "duplicate_payment_count"]
    names = ["total_works", *fixed.RISK_LEVELS, "sanctioned", "expenditure", "completion", "mp_count", "state_count", "duplicate_payment_count"]
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in zip(sums, names)])


def by_state(summary: DataFrame, chamber: str = ALL) -> DataFrame:
    """Every state including a missing one."""
    return cut(summary, ["state"], chamber).select(
        "state", F.col("named_works").alias("total_works"), F.col("level_high").alias("high_risk"), F.col("level_critical").alias("critical"),
        F.col("level_review").alias("review"), (F.col("level_normal") - F.col("level_missing")).alias("normal"), "expenditure",
        F.try_divide("score_sum", "scored_works").alias("risk_score"), display_state(F.col("state")).alias("state_display"),
    )


def top_states(summary: DataFrame, chamber: str = ALL, limit: int = 6) -> DataFrame:
    return by_state(summary, chamber).orderBy(F.desc("expenditure"), "state").limit(limit)


def state_performance(summary: DataFrame) -> DataFrame:
    known = cut(summary, ["state"]).filter(F.col("state").isNotNull())
    return known.select(
        "state", F.col("named_works").alias("total_works"), F.col("sanctioned").alias("total_sanctioned"), F.col("expenditure").alias("total_expenditure"),
        (F.col("level_high") + F.col("level_critical")).alias("high_critical_risk_works"),
    ).orderBy(F.desc("high_critical_risk_works"), "state")


def frequencies(summary: DataFrame, column: str, chamber: str = ALL) -> DataFrame:
    """Rows per value of a key, most frequent first; missing values are not counted."""
    known = cut(summary, [column], chamber).filter(F.col(column).isNotNull())
    return known.select(column, F.col("total_works").alias("works")).orderBy(F.desc("works"), column)
