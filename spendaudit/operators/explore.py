"""Filters, search, ranking, paging and drill-downs over the finished tables."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendaudit import fixed_values as fixed
from spendaudit.functions.text import display_state, state_from_display
from spendaudit.operators.monitors import severity_rank

ALL = "All"
MEMBER_KEY = ["mp_id", "mp_name", "parliament_house", "state", "constituency"]


def contains_text(df: DataFrame, text: str, columns: list[str] = fixed.SEARCH_COLUMNS) -> DataFrame:
    """Rows with the text, taken literally and in any case, in one of the columns that exist."""
    wanted = text.lower().strip()
    hits = [F.lower(c).contains(F.lit(wanted)) for c in columns if c in df.columns]
    return df.filter(F.coalesce(reduce(or_, [F.coalesce(h, F.lit(False)) for h in hits]), F.lit(False)))


def filter_works(
    df: DataFrame,
    chamber: str = ALL,
    state: str = ALL,
    district: str = ALL,
    constituency: str = ALL,
    risk: str | list[str] = ALL,
    text: str | None = None,
    min_score: float | None = None,
    max_score: float | None = None,
) -> DataFrame:
    """The explorer's filters; "All" or nothing leaves a filter out."""

    def chosen(value) -> bool:
        return bool(value) and value != ALL

    if chosen(chamber):
        df = df.filter(F.col("parliament_house") == chamber)
    if chosen(state):
        df = df.filter(F.col("state") == state)
    if chosen(district):
        df = df.filter(F.col("district") == district) if "district" in df.columns else df.filter(F.lit(False))
    if chosen(constituency):
        df = df.filter(F.col("constituency") == constituency)
    if chosen(risk):
        df = df.filter(F.col("risk_level").isin(risk if isinstance(risk, list) else [risk]))
    if text:
        df = contains_text(df, text)
    if min_score is not None:
        df = df.filter(F.col("risk_score") >= min_score)
    if max_score is not None:
        df = df.filter(F.col("risk_score") <= max_score)
    return df


def page_of(df: DataFrame, order: list[Column], page: int, page_size: int, tie: str = "work_id") -> DataFrame:
    """One page in a total order; the tie column makes pages stable. Runs as a distributed top-k."""
    ordered = df.orderBy(*order, F.col(tie).asc_nulls_last())
    return ordered.offset((page - 1) * page_size).limit(page_size)


def page_total(df: DataFrame, page_size: int) -> DataFrame:
    """One row: number of rows of a list, and of its pages."""
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / page_size))


def page_after(df: DataFrame, score: str, last_score: float, last_id: str, page_size: int, tie: str = "work_id") -> DataFrame:
    """The page that follows a row, by descending score and ascending id. The filter reaches the files, and only one
    page is ranked: unlike an offset, the cost does not grow with the depth of the page."""
    later = (F.col(score) < last_score) | ((F.col(score) == last_score) & (F.col(tie) > last_id))
    return df.filter(later).orderBy(F.desc(score), tie).limit(page_size)


@dataclass(frozen=True)
class PageDirectory:
    """Where the parts of an ordered list begin: the number of rows before each part, and the score and id of its first row."""

    score: str
    tie: str
    total: int
    before: list[int]
    first: list[tuple[float | None, str]]


def page_directory(df: DataFrame, score: str = "risk_score", tie: str = "work_id", rows_of_part: int = 100_000) -> PageDirectory:
    """The directory of a list by descending score and ascending id, for pages by number.

    Score and id are ranged over the cluster once, in parts of about ``rows_of_part`` rows; equal scores are parted by
    the id, so no part grows with the ties. One row for each part comes to the driver. Ids must not be missing.
    """
    total = df.count()
    parts = max(1, -(-total // rows_of_part))
    ranged = df.select(F.col(score).cast("double").alias("s"), F.col(tie).alias("t")).repartitionByRange(parts, F.col("s").desc_nulls_last(), "t")
    place = F.struct(F.col("s").isNull().alias("unscored"), (-F.col("s")).alias("falling"), "t")
    found = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("rows"), F.min(place).alias("first")).orderBy("part").collect()
    before = [0, *accumulate(r.rows for r in found)][:-1] if found else []
    return PageDirectory(score, tie, total, before, [(None if r.first.unscored else -r.first.falling, r.first.t) for r in found])


def _from(directory: PageDirectory, part: int) -> Column:
    """Whether a row comes with or after the first one of a part."""
    score, tie = F.col(directory.score), F.col(directory.tie)
    at, first = directory.first[part]
    if at is None:
        return score.isNull() & (tie >= first)
    return F.coalesce((score < at) | ((score == at) & (tie >= first)), F.lit(True))


def numbered_page(df: DataFrame, directory: PageDirectory, page: int, page_size: int) -> DataFrame:
    """A page by its number, as ``page_of`` gives it by descending score and ascending id. Only the parts that hold the page
    are ranked, whatever its number; the directory must be of the same list."""
    start = (page - 1) * page_size
    part = bisect_right(directory.before, start) - 1
    if part < 0 or start >= directory.total:
        return df.limit(0)
    behind = bisect_left(directory.before, start + page_size)
    score = F.col(directory.score)
    if behind < len(directory.before):
        df = df.filter(~_from(directory, behind))
        if directory.first[behind][0] is not None:  # all of the page has a score: in plain form, the filters reach the files
            df = df.filter((score >= directory.first[behind][0]) & (score <= directory.first[part][0]))
    if part > 0:
        df = df.filter(_from(directory, part))
    return df.orderBy(score.desc_nulls_last(), directory.tie).offset(start - directory.before[part]).limit(page_size)


def works_explorer(works: DataFrame, page: int = 1, page_size: int = 50, **filters) -> DataFrame:
    return page_of(filter_works(works, **filters), [F.col("risk_score").desc_nulls_last()], page, page_size)


def critical_queue(works: DataFrame, page: int = 1, page_size: int = 25, sort: str = "risk_score", **filters) -> DataFrame:
    by = sort if sort in fixed.CRITICAL_SORTS else "risk_score"
    return page_of(filter_works(works, risk="CRITICAL", **filters), [F.col(by).desc_nulls_last()], page, page_size)


def spending_outliers(works: DataFrame, limit: int = 25) -> DataFrame:
    scored = works.withColumn("abs_exp_robust_zscore", F.abs("exp_robust_zscore")).filter("abs_exp_robust_zscore IS NOT NULL")
    return page_of(scored, [F.desc("abs_exp_robust_zscore"), F.col("risk_score").desc_nulls_last()], 1, limit)


def anomaly_explorer(works: DataFrame, levels: list[str] = ["CRITICAL", "HIGH"], state: str = ALL, member: str = ALL, signal: str = ALL) -> DataFrame:
    """Works of several levels, optionally of one member and with a word in the primary reason."""
    df = filter_works(works, risk=levels, state=state)
    if member != ALL:
        df = df.filter(F.col("mp_name") == member)
    if signal != ALL:
        df = contains_text(df, signal, ["primary_reason"])
    return df.orderBy(F.col("risk_score").desc_nulls_last(), "work_id")


def flagged_works(works: DataFrame, member: str) -> DataFrame:
    return works.filter(F.col("mp_name") == member).filter(F.col("risk_level").isin("HIGH", "CRITICAL", "REVIEW"))


def overrun_list(monitored: DataFrame, page: int = 1, page_size: int = 50, band: str = ALL, text: str | None = None, **filters) -> DataFrame:
    df = filter_works(monitored.filter("is_overrun"), **filters)
    if band != ALL:
        df = df.filter(F.col("overrun_band") == band)
    if text:
        df = contains_text(df, text, ["work_id", "mp_name"])
    return page_of(df, [F.desc("overrun_pct")], page, page_size)


def compliance_list(monitored: DataFrame, page: int = 1, page_size: int = 50, status: str = ALL, **filters) -> DataFrame:
    df = filter_works(monitored, **filters)
    if status != ALL:
        df = df.filter(F.col("compliance_status") == status)
    return page_of(df, [F.col("compliance_score").asc_nulls_first()], page, page_size)


def estimate_list(monitored: DataFrame, page: int = 1, page_size: int = 50, priority: str = ALL, **filters) -> DataFrame:
    df = filter_works(monitored, **filters)
    if priority != ALL:
        df = df.filter(F.col("review_priority") == priority)
    return page_of(df, [F.desc("review_priority_score")], page, page_size)


def warning_list(warnings: DataFrame, page: int = 1, page_size: int = 50, severity: str = ALL, state: str = ALL) -> DataFrame:
    if severity != ALL:
        warnings = warnings.filter(F.col("severity") == severity)
    df = filter_works(warnings, state=state)
    return page_of(df, [severity_rank().desc(), F.desc("signal_count")], page, page_size)


# --- groups -----------------------------------------------------------------------------------


def level_counts(names: dict[str, str]) -> list[Column]:
    """One counting column per level, named as given."""
    return [F.count_if(F.col("risk_level") == level).alias(name) for level, name in names.items()]


def money(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def risk_summary_columns() -> list[Column]:
    level = F.coalesce("risk_level", F.lit("NORMAL"))
    return [F.count_if(level == name).alias(name) for name in fixed.RISK_LEVELS]


def money_summary_columns() -> list[Column]:
    return [
        money("sanctioned_amount").alias("sanctioned"),
        money("total_expenditure").alias("expenditure"),
        money("completion_amount").alias("completion"),
    ]


def overview(works: DataFrame, chamber: str = ALL) -> DataFrame:
    return filter_works(works, chamber=chamber).agg(
        F.count("*").alias("total_works"),
        *risk_summary_columns(),
        *money_summary_columns(),
        F.count_distinct("mp_id").alias("mp_count"),
        F.count_distinct("state").alias("state_count"),
        F.coalesce(F.sum("duplicate_payment_count"), F.lit(0)).alias("duplicate_payment_count"),
    )


def by_state(works: DataFrame, chamber: str = ALL) -> DataFrame:
    """Every state including a missing one."""
    grouped = filter_works(works, chamber=chamber).groupBy("state").agg(
        F.count("work_id").alias("total_works"),
        *level_counts({"HIGH": "high_risk", "CRITICAL": "critical", "REVIEW": "review", "NORMAL": "normal"}),
        money("total_expenditure").alias("expenditure"),
        F.avg("risk_score").alias("risk_score"),
    )
    return grouped.withColumn("state_display", display_state(F.col("state")))


def top_states(works: DataFrame, chamber: str = ALL, limit: int = 6) -> DataFrame:
    return by_state(works, chamber).orderBy(F.desc("expenditure"), "state").limit(limit)


def of_state(works: DataFrame, name: str, chamber: str = ALL) -> DataFrame:
    """Works of a state given in any case and in its stored or display spelling."""
    stored = state_from_display(name).lower()
    return filter_works(works, chamber=chamber).filter(F.lower("state") == stored)


def state_members(works: DataFrame) -> DataFrame:
    """Members ranked by critical, high and total works."""
    grouped = works.groupBy("mp_id", "mp_name", "parliament_house", "constituency").agg(
        F.count("work_id").alias("works"),
        *level_counts({"HIGH": "high", "CRITICAL": "critical"}),
        money("total_expenditure").alias("expenditure"),
    )
    return grouped.orderBy(F.desc("critical"), F.desc("high"), F.desc("works"), "mp_id", F.col("constituency").asc_nulls_last())


def member_concentration(members: DataFrame, limit: int = 8) -> DataFrame:
    """Weighted load of the first members of the ranking."""
    return members.limit(limit).select("mp_name", (F.col("critical") * 5 + F.col("high")).alias("value"))


def top_works(works: DataFrame, level: str, limit: int = 20) -> DataFrame:
    return page_of(filter_works(works, risk=level), [F.col("risk_score").desc_nulls_last()], 1, limit)


def state_detail(works: DataFrame, name: str, chamber: str = ALL) -> dict[str, DataFrame]:
    """Summary, members and the top works of one state; every part is empty for an unknown state."""
    own = of_state(works, name, chamber)
    members = state_members(own)
    return {
        "summary": own.agg(F.count("*").alias("total_works"), *risk_summary_columns(), *money_summary_columns()),
        "members": members,
        "concentration": member_concentration(members),
        "critical_works": top_works(own, "CRITICAL"),
        "high_works": top_works(own, "HIGH"),
    }


def member_profile(works: DataFrame, order: str = "work_id") -> DataFrame:
    """Descriptive fields of each member from the first of its works, with the work summary."""
    optional = ["party", "photo_url", "nodal_district", "elected_nominated"]
    fields = ["mp_name", "parliament_house", "state", "constituency", *[c for c in optional if c in works.columns]]
    grouped = works.groupBy("mp_id").agg(
        F.min_by(F.struct(*fields), order).alias("first"),
        F.count("*").alias("total_works"),
        *risk_summary_columns(),
        *money_summary_columns(),
    )
    flat = grouped.select("mp_id", "first.*", *[c for c in grouped.columns if c not in ("mp_id", "first")])
    lower = F.col("parliament_house") == fixed.LOWER_HOUSE
    return flat.withColumns({"constituency": F.when(lower, F.col("constituency")), "state": display_state(F.col("state"))})


def member_detail(works: DataFrame, mp_id: str) -> dict[str, DataFrame]:
    own = works.filter(F.col("mp_id") == mp_id)
    status = F.coalesce("lifecycle_status", F.lit(fixed.NOT_AVAILABLE)).alias("lifecycle_status")
    return {
        "profile": member_profile(own, "row_order" if "row_order" in own.columns else "work_id"),
        "lifecycle": own.groupBy(status).agg(F.count("*").alias("works")).orderBy(F.desc("works"), "lifecycle_status"),
        "works": own.orderBy(F.col("risk_score").desc_nulls_last(), "work_id"),
    }


def member_directory(works: DataFrame, sort: str = "mp_name", descending: bool = False, limit: int = 200, **filters) -> DataFrame:
    grouped = filter_works(works, **filters).groupBy(*MEMBER_KEY).agg(
        F.count("work_id").alias("total_works"),
        *level_counts({"NORMAL": "normal_count", "REVIEW": "review_count", "HIGH": "high_risk_count", "CRITICAL": "critical_count"}),
        money("total_expenditure").alias("total_expenditure"),
    )
    grouped = grouped.withColumns(
        {
            "risk_count": F.col("review_count") + F.col("high_risk_count") + F.col("critical_count"),
            "state_display": display_state(F.col("state")),
        }
    )
    key = F.col(sort if sort in fixed.MEMBER_SORTS else "mp_name")
    first = key.desc_nulls_last() if descending else key.asc_nulls_last()
    ties = [F.col(c).asc_nulls_last() for c in ("mp_id", "state", "constituency")]
    return grouped.orderBy(first, *ties).limit(limit)


def facet_values(works: DataFrame, chamber: str = ALL) -> DataFrame:
    """Long table (facet, state, value): states, constituencies and constituencies of each state."""
    df = filter_works(works, chamber=chamber).select("state", "constituency").distinct()
    cells = F.array(
        F.struct(F.lit("state").alias("facet"), F.lit(None).cast("string").alias("of_state"), F.col("state").alias("value")),
        F.struct(F.lit("constituency").alias("facet"), F.lit(None).cast("string").alias("of_state"), F.col("constituency").alias("value")),
        F.struct(
            F.when(F.col("state").isNotNull(), "constituency_of_state").alias("facet"),
            F.col("state").alias("of_state"),
            F.col("constituency").alias("value"),
        ),
    )
    return df.select(F.inline(cells)).filter("facet IS NOT NULL AND value IS NOT NULL").distinct()


def constituency_state(works: DataFrame, chamber: str = ALL) -> DataFrame:
    """First state (by name) of each constituency."""
    df = filter_works(works, chamber=chamber).filter("state IS NOT NULL AND constituency IS NOT NULL")
    return df.groupBy("constituency").agg(F.min("state").alias("state"))


def score_range(works: DataFrame, chamber: str = ALL) -> DataFrame:
    return filter_works(works, chamber=chamber).agg(
        F.coalesce(F.min("risk_score"), F.lit(0.0)).alias("score_min"),
        F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("score_max"),
    )


# --- one work ---------------------------------------------------------------------------------


def duration_days() -> Column:
    """Days from recommendation, else from sanction, to completion."""
    return F.coalesce(F.datediff("completion_date", "recommended_date"), F.datediff("completion_date", "sanction_date"))


def work_record(works: DataFrame) -> DataFrame:
    """Work rows as reported: ISO dates, display state and duration."""
    dates = [c for c, t in works.dtypes if t == "date"]
    shown = {c: F.date_format(c, "yyyy-MM-dd") for c in dates}
    return works.withColumns({"duration_days": duration_days(), "state_display": display_state(F.col("state"))}).withColumns(shown)


EVIDENCE = [
    "risk_reasons", "stat_risk_score", "sanc_robust_zscore", "exp_robust_zscore", "statistical_anomaly_available", "ml_anomaly_score",
    "ml_anomaly_percentile",
]


def work_evidence(works: DataFrame) -> DataFrame:
    """What a work's level rests on: the rules' reasons, the comparison with peers, and the model."""
    return works.select("work_id", *[c for c in EVIDENCE if c in works.columns])


def work_dossier(work_id: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Everything known about one work: a filter on each finished table, pushed down to its files."""
    found = {n: df.filter(F.col("work_id") == work_id) for n, df in tables.items() if n not in ("pairs", "members")}
    if "pairs" in tables:
        # pairs of the work itself, or of the node of alike works that it belongs to
        sides = F.array("work_a.work_id", "work_b.work_id")
        if "members" in tables:
            own = tables["members"].filter(F.col("work_id") == work_id).select("tier", "node")
            mine = tables["pairs"].select("*", F.explode(sides).alias("node")).join(own, ["tier", "node"], "left_semi")
            found["pairs"] = mine.drop("node").dropDuplicates(["tier", "work_a", "work_b"])
        else:
            found["pairs"] = tables["pairs"].filter(F.array_contains(sides, work_id))
    if "work" in found:
        found["evidence"] = work_evidence(found["work"])
    return found
