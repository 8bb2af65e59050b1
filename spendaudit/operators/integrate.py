"""From cleaned stage exports to one row per work, the ledger, allocations and calamity consents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendaudit import fixed_values as fixed
from spendaudit.functions.text import (
    extract_work_id,
    normalize_member,
    normalize_state,
    parse_amount,
    parse_date,
)
from spendaudit.session import materialize

# stage order of the merge; the position of a stage also orders its records
STAGES = ["recommended", "sanctioned", "completed", "expenditure"]
DESCRIPTION_FIELDS = [
    "parliament_house", "mp_name", "state", "constituency", "elected_nominated", "work_category", "work_description",
]


@dataclass(frozen=True)
class Integrated:
    works: DataFrame
    ledger: DataFrame
    allocation: DataFrame
    calamity: DataFrame


def find_column(names: list[str], exact: list[str], tokens: list[str], last: bool = False) -> str | None:
    """Header with one of the exact names, else the first (or last) one that contains a token."""
    for name in exact:
        if name in names:
            return name
    hits = [n for n in names if any(t in n.lower() for t in tokens)]
    return hits[-1 if last else 0] if hits else None


def _required(names: list[str], exact: list[str], tokens: list[str], last: bool = False) -> Column:
    name = find_column(names, exact, tokens, last)
    if name is None:
        raise ValueError(f"no column like {exact + tokens} among {names}")
    return F.col(f"`{name}`")


def _optional(names: list[str], exact: list[str], tokens: list[str]) -> Column:
    name = find_column(names, exact, tokens)
    return F.col(f"`{name}`") if name else F.lit(None).cast("string")


def person_columns(names: list[str], code: str) -> dict[str, Column]:
    """Chamber, member and state as written, and the seat, which means constituency or
    elected/nominated by chamber."""
    seat = _optional(names, [], ["constituency", "elected"])
    nothing = F.lit(None).cast("string")
    return {
        "parliament_house": F.lit(fixed.HOUSE_CODES[code]),
        "mp_name": _required(names, ["Hon'ble Members of Parliament"], ["member", "mp"]),
        "state": _required(names, ["State"], ["state"]),
        "constituency": seat if code == "LS" else nothing,
        "elected_nominated": seat if code == "RS" else nothing,
    }


def surrogate(prefix: str, code: str) -> Column:
    return F.concat(F.lit(f"{prefix}_{code}_"), F.col("row_pos"))


def work_key(id_text: Column, code: str, kind: str) -> Column:
    """Work id from the text, else a positional id that never merges with another record."""
    positional = surrogate(f"{fixed.UNASSIGNED_PREFIX}{code}", fixed.STAGE_CODES[kind])
    return F.coalesce(extract_work_id(id_text), positional)


def stage_records(df: DataFrame, code: str, kind: str) -> DataFrame:
    """One stage export in the common shape. ``df`` is cleaned and carries ``row_pos``."""
    names = [c for c in df.columns if c != "row_pos"]
    id_text = _required(names, fixed.WORK_COLUMNS[kind], [])
    paid_tokens = ["amount"] if kind in ("recommended", "sanctioned") else ["disbursed", "amount"]
    described = kind != "expenditure"
    category = _optional(names, [], ["category"]) if described else F.lit(None).cast("string")
    description = _optional(names, [], ["description"]) if described else F.lit(None).cast("string")
    also_recommended = (
        _optional(names, ["Recommended date"], []) if kind == "sanctioned" else F.lit(None).cast("string")
    )
    status = _optional(names, ["Work Status"], []) if kind == "sanctioned" else F.lit(None).cast("string")
    rank = STAGES.index(kind) * 2 + list(fixed.HOUSE_CODES).index(code)
    return df.select(
        work_key(id_text, code, kind).alias("work_id"),
        F.lit(kind).alias("stage"),
        # stage, then chamber, then position in the file
        (F.lit(rank << 56) + F.col("row_pos")).cast("long").alias("row_order"),
        *[c.alias(n) for n, c in person_columns(names, code).items()],
        F.coalesce(category, F.lit(fixed.DEFAULT_CATEGORY)).alias("work_category"),
        F.coalesce(description, F.lit("")).alias("work_description"),
        parse_amount(_required(names, [], paid_tokens)).alias("amount"),
        parse_date(_required(names, [fixed.DATE_COLUMNS[kind]], [])).alias("date"),
        parse_date(also_recommended).alias("also_recommended"),
        F.coalesce(status, F.lit(fixed.DEFAULT_STATUS)).alias("status"),
    )


def lifecycle_status() -> Column:
    sanctioned = F.col("has_sanctioned")
    return (
        F.when(sanctioned & F.col("has_completed"), fixed.LIFECYCLE_COMPLETED)
        .when(sanctioned & F.col("has_expenditure"), fixed.LIFECYCLE_IN_PROGRESS)
        .when(sanctioned, fixed.LIFECYCLE_PENDING_PAYMENT)
        .when(F.col("has_recommended"), fixed.LIFECYCLE_PENDING_SANCTION)
        .otherwise(fixed.LIFECYCLE_GAP)
    )


def merge_stages(records: DataFrame) -> DataFrame:
    """One row per work from all stage records.

    The earliest record describes the work. Within a stage the latest record sets that stage's amount
    and date, even to null. A sanction that opens a work also gives its recommendation date. Names are
    normalized afterwards, once per work instead of once per record.

    Payments, by far the most records, come last of all stages: they only say that a work was paid, or
    open it if no other stage does. They are reduced to each work's first position by a hash aggregation
    of numbers, and only the records that open a work are fetched and sorted with the other stages.
    """
    order = F.col("row_order")

    def of(stage: str) -> Column:
        return F.col("stage") == stage

    payments, others = records.filter(of("expenditure")), records.filter(~of("expenditure"))
    paid = materialize(payments.groupBy("work_id").agg(F.min(order).alias("row_order")), "first_payments")
    opening = paid.join(others.select("work_id"), "work_id", "left_anti")
    records = others.unionByName(payments.join(opening, ["work_id", "row_order"], "left_semi").select(others.columns))
    paid = paid.select("work_id", F.lit(True).alias("paid"))

    def last(stage: str, *fields: str) -> Column:
        return F.max_by(F.struct(*fields), F.when(of(stage), order))

    merged = records.groupBy("work_id").agg(
        F.min_by(F.struct("stage", "also_recommended", *DESCRIPTION_FIELDS), order).alias("opened"),
        last("recommended", "amount", "date").alias("rec"),
        last("sanctioned", "amount", "date", "status").alias("sanc"),
        last("completed", "amount", "date").alias("comp"),
        *[F.bool_or(of(s)).alias(f"seen_{s}") for s in STAGES if s != "expenditure"],
        F.min(order).alias("row_order"),
    )
    merged = merged.join(paid, "work_id", "left").withColumn("seen_expenditure", F.col("paid").isNotNull())
    opened_by = F.col("opened.stage")
    opening_date = F.when(opened_by == "sanctioned", F.col("opened.also_recommended"))
    status = (
        F.when(F.col("seen_sanctioned"), F.col("sanc.status"))
        .when(opened_by == "completed", fixed.CREATED_BY_COMPLETION_STATUS)
        .when(opened_by == "expenditure", fixed.CREATED_BY_PAYMENT_STATUS)
    )
    works = merged.select(
        "work_id",
        *[F.col(f"opened.{f}") for f in DESCRIPTION_FIELDS],
        F.col("rec.amount").alias("recommended_amount"),
        F.when(F.col("seen_recommended"), F.col("rec.date")).otherwise(opening_date).alias("recommended_date"),
        F.col("sanc.amount").alias("sanctioned_amount"),
        F.col("sanc.date").alias("sanction_date"),
        F.col("comp.amount").alias("completion_amount"),
        F.col("comp.date").alias("completion_date"),
        status.alias("work_status_raw"),
        (F.col("seen_recommended") | opening_date.isNotNull()).alias("has_recommended"),
        F.col("seen_sanctioned").alias("has_sanctioned"),
        F.col("seen_expenditure").alias("has_expenditure"),
        F.col("seen_completed").alias("has_completed"),
        F.col("work_id").startswith(fixed.UNASSIGNED_PREFIX).alias("is_unmatched_work"),
        "row_order",
    )
    return normalized(works).withColumn("lifecycle_status", lifecycle_status())


def normalized(df: DataFrame) -> DataFrame:
    return df.withColumns({"mp_name": normalize_member(F.col("mp_name")), "state": normalize_state(F.col("state"))})


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def works_master(raw: dict[tuple[str, str], DataFrame]) -> DataFrame:
    frames = [stage_records(raw[(code, kind)], code, kind) for kind in STAGES for code in fixed.HOUSE_CODES]
    # read three times by the merge, parsed once
    return merge_stages(materialize(_union(frames), "stage_records"))


def ledger_records(raw: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Both chambers' payments with their own ids."""

    def one(code: str) -> DataFrame:
        df = raw[(code, "expenditure")]
        names = [c for c in df.columns if c != "row_pos"]
        id_text = _required(names, fixed.WORK_COLUMNS["expenditure"], [])
        return df.select(
            surrogate("EXP", code).alias("expenditure_id"),
            work_key(id_text, code, "expenditure").alias("work_id"),
            F.lit(fixed.HOUSE_CODES[code]).alias("parliament_house"),
            parse_date(_required(names, [fixed.DATE_COLUMNS["expenditure"]], [])).alias("expenditure_date"),
            F.coalesce(_required(names, ["Vendor Name"], []), F.lit(fixed.DEFAULT_VENDOR)).alias("vendor_name"),
            F.coalesce(_required(names, ["Payment Status"], []), F.lit(fixed.DEFAULT_PAYMENT_STATUS)).alias("payment_status"),
            parse_amount(_required(names, [], ["disbursed", "amount"])).alias("amount"),
        )

    return _union([one(code) for code in fixed.HOUSE_CODES])


def allocations(raw: dict[tuple[str, str], DataFrame]) -> DataFrame:
    def one(code: str) -> DataFrame:
        df = raw[(code, "allocation")]
        names = [c for c in df.columns if c != "row_pos"]
        return df.select(
            surrogate("MP", code).alias("mp_id"),
            *[c.alias(n) for n, c in person_columns(names, code).items()],
            parse_amount(_required(names, [], ["amount"])).alias("allocated_amount"),
        )

    return normalized(_union([one(code) for code in fixed.HOUSE_CODES]))


def calamity_consents(raw: dict[tuple[str, str], DataFrame]) -> DataFrame:
    def one(code: str) -> DataFrame:
        df = raw[(code, "calamity")]
        names = [c for c in df.columns if c != "row_pos"]

        def named(name: str, place: int) -> Column:
            return F.col(f"`{name if name in names else names[place]}`")

        return df.select(
            surrogate("CAL", code).alias("calamity_id"),
            F.lit(fixed.HOUSE_CODES[code]).alias("parliament_house"),
            normalize_member(_required(names, ["Hon'ble Members of Parliament"], ["member", "mp"])).alias("mp_name"),
            named("Calamity Type", 1).alias("calamity_type"),
            named("Calamity Name", 2).alias("calamity_name"),
            parse_date(named("Date of Consent", 4)).alias("consent_date"),
            parse_amount(_required(names, [], ["amount", "consent"], last=True)).alias("consent_amount"),
        )

    return _union([one(code) for code in fixed.HOUSE_CODES])


def unreadable_cells(raw: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """house, kind, column, unreadable: cells of date and amount columns that hold text which is no date or amount.

    One pass over each export. A column in a form that is not known shows here, instead of only losing its values.
    """
    found = []
    for (code, kind), df in raw.items():
        columns = [n for n in df.columns if n != "row_pos" and any(t in n.lower() for t in ("date", "amount"))]
        read = {n: parse_date if "date" in n.lower() else parse_amount for n in columns}
        cells = [F.col(f"`{n}`") for n in columns]
        counts = [F.count_if(c.isNotNull() & read[n](c).isNull()) for n, c in zip(columns, cells)]
        entry = F.array(*[F.struct(F.lit(n).alias("column"), c.alias("unreadable")) for n, c in zip(columns, counts)])
        found.append(df.agg(entry.alias("found")).select(F.lit(code).alias("house"), F.lit(kind).alias("kind"), F.inline("found")))
    return _union(found)


def integrate(raw: dict[tuple[str, str], DataFrame]) -> Integrated:
    """All four canonical tables from the twelve cleaned exports."""
    return Integrated(works_master(raw), ledger_records(raw), allocations(raw), calamity_consents(raw))
