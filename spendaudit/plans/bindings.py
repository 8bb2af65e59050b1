"""Canonical tables derived from a generic order/line/customer star schema.

Orders stand in for works, their lines for the payment ledger, customers for members. The formulas use
values of the row only, so the same tables can be stated in SQL.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendaudit import fixed_values as fixed
from spendaudit.operators.integrate import STAGES, lifecycle_status
from spendaudit.session import materialize, spread


# tables that grow with the data
LARGE = ("orders", "lineitem", "documents")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in LARGE else df


def _people(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment", "n_name", "n_regionkey"
    )


def is_lower() -> Column:
    return F.col("n_regionkey") < 3


def house() -> Column:
    return F.when(is_lower(), fixed.LOWER_HOUSE).otherwise(fixed.UPPER_HOUSE)


def member_name() -> Column:
    return F.concat_ws(" ", "c_mktsegment", "n_name")


def orders_with_people(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer and nation, and the stages each one has passed as a work."""
    orders = table(spark, folder, "orders").join(_people(spark, folder), F.col("o_custkey") == F.col("c_custkey"))
    recommended = F.col("c_acctbal") >= 0
    sanctioned = ~((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW"))
    number = F.concat_ws("/", F.concat(F.lit("MP"), "c_custkey"), F.year("o_orderdate"), "o_orderkey")
    start = F.trunc("o_orderdate", "month")
    wait = F.floor("o_totalprice").cast("int") % 400 - 10
    return orders.withColumns(
        {
            "has_recommended": recommended,
            "has_sanctioned": sanctioned,
            "has_completed": F.col("o_orderstatus") == "F",
            "work_id": F.concat(F.when(recommended | sanctioned, "WS/").otherwise(fixed.UNASSIGNED_PREFIX), number),
            "recommended_date": F.when(recommended, F.date_sub(start, wait)),
            "recommended_amount": F.when(recommended, F.col("o_totalprice")),
            "sanction_date": F.when(sanctioned, start),
            "sanctioned_amount": F.when(sanctioned, (F.floor(F.col("o_totalprice") / 50000) + 1) * 50000.0),
        }
    )


def works(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max(F.col("l_shipdate").cast("date")).alias("last_ship"),
        F.sum(F.floor(F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")))).cast("double").alias("done"),
    )
    df = orders_with_people(spark, folder).join(lines, "o_orderkey", "left")
    completed = F.col("has_completed")
    described = F.concat(F.lit("Construction of "), "o_orderpriority", F.lit(" works at "), "c_mktsegment")
    flat = df.select(
        "work_id",
        house().alias("parliament_house"),
        member_name().alias("mp_name"),
        F.col("n_name").alias("state"),
        F.when(is_lower(), F.col("c_mktsegment")).alias("constituency"),
        F.when(~is_lower(), "Elected MP").alias("elected_nominated"),
        F.col("o_orderpriority").alias("work_category"),
        described.alias("work_description"),
        "recommended_amount",
        "recommended_date",
        "sanctioned_amount",
        "sanction_date",
        F.when(completed, F.coalesce("done", F.lit(0.0))).alias("completion_amount"),
        F.when(completed, F.col("last_ship")).alias("completion_date"),
        F.when(F.col("has_sanctioned"), fixed.DEFAULT_STATUS).alias("work_status_raw"),
        "has_recommended",
        "has_sanctioned",
        F.col("last_ship").isNotNull().alias("has_expenditure"),
        "has_completed",
        F.col("work_id").startswith(fixed.UNASSIGNED_PREFIX).alias("is_unmatched_work"),
        F.col("o_orderkey").alias("row_order"),
    )
    return flat.withColumn("lifecycle_status", lifecycle_status())


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    vendors = suppliers.select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("Vendor "), "n_name").alias("vendor_name"))
    keys = orders_with_people(spark, folder).select(F.col("o_orderkey").alias("l_orderkey"), "work_id", house().alias("parliament_house"))
    lines = table(spark, folder, "lineitem").join(vendors, "l_suppkey").join(keys, "l_orderkey")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("expenditure_id"),
        "work_id",
        "parliament_house",
        F.trunc("l_shipdate", "quarter").alias("expenditure_date"),
        "vendor_name",
        F.col("l_linestatus").alias("payment_status"),
        ((F.floor(F.col("l_extendedprice") / 25000) + 1) * 25000.0).alias("amount"),
    )


def allocation(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer; the rows of one market segment name no member, so its members have no known limit."""
    return _people(spark, folder).select(
        F.concat(F.lit("MP_"), "c_custkey").alias("mp_id"),
        house().alias("parliament_house"),
        F.when(F.col("c_mktsegment") != "BUILDING", member_name()).alias("mp_name"),
        F.col("n_name").alias("state"),
        F.when(is_lower(), F.col("c_mktsegment")).alias("constituency"),
        F.when(~is_lower(), "Elected MP").alias("elected_nominated"),
        (F.floor(F.abs("c_acctbal")) * 1000.0).alias("allocated_amount"),
    )


def calamity(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select(
        F.concat(F.lit("CAL_LS_"), F.col("event_id") + 1).alias("calamity_id"),
        F.lit(fixed.LOWER_HOUSE).alias("parliament_house"),
        F.concat(F.lit("Member "), "user_id").alias("mp_name"),
        F.col("event_type").alias("calamity_type"),
        F.col("props").alias("calamity_name"),
        F.col("ts").cast("date").alias("consent_date"),
        F.col("value").alias("consent_amount"),
    )


def similar_works(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as works whose descriptions differ in none, one or two words; real order dates, some dates, seats and amounts missing."""
    early = F.array(*[F.lit(w) for w in ("amber", "azure", "beige", "black", "brown")])
    late = F.array(*[F.lit(w) for w in ("violet", "walnut", "wheat", "white", "willow", "yellow", "zinc")])
    day = F.col("o_orderdate").cast("date")
    known = F.col("o_orderstatus") != "P"
    described = F.concat_ws(
        " ", F.lit("Culvert, pipeline; drainage"), F.lower("c_mktsegment"), early[(F.col("o_custkey") % 5).cast("int")], F.lit("SCHOOL of temple at Phase"),
        late[(F.col("o_orderkey") % 7).cast("int")],
    )
    return orders_with_people(spark, folder).select(
        F.concat(F.lit("SIM/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("work_id"),
        member_name().alias("mp_name"),
        F.col("n_name").alias("state"),
        F.when(is_lower(), F.col("c_mktsegment")).alias("constituency"),
        described.alias("work_description"),
        F.when(F.col("o_custkey") % 31 != 0, (F.floor(F.col("o_totalprice") / 10000) + 1) * 10000.0).alias("sanctioned_amount"),
        F.when(known, day).alias("sanction_date"),
        F.when(F.col("o_custkey") % 29 != 0, day).alias("recommended_date"),
        F.col("o_orderkey").alias("row_order"),
    )


def document_works(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as works: whole texts as descriptions, language as member, length as amount."""
    docs = table(spark, folder, "documents")
    return docs.select(
        F.concat(F.lit("DOC/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("work_id"),
        F.col("lang").alias("mp_name"),
        F.lit(None).cast("string").alias("constituency"),
        F.col("text").alias("work_description"),
        F.col("n_chars").cast("double").alias("sanctioned_amount"),
        F.lit("2024-01-01").cast("date").alias("sanction_date"),
        F.lit(None).cast("date").alias("recommended_date"),
        F.col("doc_id").alias("row_order"),
    )


def stage_records(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as stage records of the work given by their order: the return flag and status pick the
    stage, line number and part give the position, small quantities have no amount."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    stage = F.when(flag == "A", 0).when(flag == "R", 1).when(status == "F", 2).otherwise(3)
    names = F.array(*[F.lit(s) for s in ("recommended", "sanctioned", "completed", "expenditure")])
    lower = F.col("l_tax") < 0.05
    place = (F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey")) * 1_000_000 + F.col("l_suppkey")
    shipped = F.col("l_shipdate").cast("date")
    return table(spark, folder, "lineitem").select(
        F.concat(F.when(F.col("l_orderkey") > 0, "WS/").otherwise(fixed.UNASSIGNED_PREFIX), "l_orderkey").alias("work_id"),
        names[stage].alias("stage"),
        (stage.cast("long") * (1 << 57) + place).alias("row_order"),
        F.when(lower, fixed.LOWER_HOUSE).otherwise(fixed.UPPER_HOUSE).alias("parliament_house"),
        F.concat(F.lit("Member "), "l_suppkey").alias("mp_name"),
        F.concat(F.lit("State "), "l_returnflag").alias("state"),
        F.when(lower, F.concat(F.lit("Seat "), "l_linenumber")).alias("constituency"),
        F.when(~lower, "Elected MP").alias("elected_nominated"),
        F.col("l_linestatus").alias("work_category"),
        F.concat(F.lit("Lot "), "l_partkey").alias("work_description"),
        F.when(F.col("l_quantity") >= 5, F.col("l_extendedprice")).alias("amount"),
        F.when(F.col("l_discount") > 0, shipped).alias("date"),
        F.when(F.col("l_tax") > 0.02, F.date_sub(shipped, 30)).alias("also_recommended"),
        F.concat(F.lit("Status "), "l_linenumber").alias("status"),
    )


# --- raw exports ------------------------------------------------------------------------------


def _export(df: DataFrame, path: str) -> None:
    """One untidy export, compressed: blanks inside cells and a total line as the last part."""
    first, *others = df.columns
    total = df.sparkSession.range(1).select(F.lit("Grand Total").alias(first), *[F.lit(" ").alias(c) for c in others])
    df.unionByName(total).write.option("header", True).option("escape", '"').option("quoteAll", True).option("compression", "gzip").csv(path)


def write_raw_exports(spark: SparkSession, folder: str, target: str, kinds: Collection[str] = tuple(fixed.RAW_FILES)) -> None:
    """The exports of these kinds (all twelve files unless named) as untidy text, written as CSV below ``target``."""
    df = orders_with_people(spark, folder)
    if len(set(STAGES) & set(kinds)) > 1:
        df = materialize(df, "staged")
    lines = table(spark, folder, "lineitem")
    number = F.concat_ws(
        " / ", F.lit(" ws"), F.concat(F.lit("MP "), "c_custkey"),
        F.concat_ws("-", F.year("o_orderdate"), F.year("o_orderdate") + 1), "o_orderkey",
    )
    titled = F.concat(F.lit("Shri "), F.lower(member_name()), F.lit(" (2024-30) (2024-2030)"))
    rupees = F.concat(F.lit("Rs. "), F.format_number("recommended_amount", 2))
    people = {
        "Hon'ble Members of Parliament": titled,
        "State": F.concat(F.lit("  "), F.lower("n_name")),
    }

    def export(source: DataFrame, code: str, kind: str) -> None:
        if kind in kinds:
            _export(source, f"{target}/{fixed.RAW_FOLDERS[code]}/{fixed.RAW_FILES[kind]}")

    for code in fixed.HOUSE_CODES:
        lower = code == "LS"
        own = df.filter(is_lower() if lower else ~is_lower())
        seat = {"Constituency": F.col("c_mktsegment")} if lower else {"Elected/Nominated": F.lit("Elected MP")}
        shared = {**people, **seat}
        named = [c.alias(n) for n, c in shared.items()]
        described = [
            F.col("o_orderpriority").alias("Work category"),
            F.concat(F.lit("Repair of\n"), "c_mktsegment").alias("Work Description"),
        ]
        export(
            own.filter("has_recommended").select(
                number.alias("WORK"), *named, *described,
                F.date_format("recommended_date", "dd-MMM-yyyy").alias("Recommended date"), rupees.alias("Recommended AMOUNT ( ₹ )"),
            ),
            code, "recommended",
        )
        export(
            own.filter("has_sanctioned").select(
                number.alias("Work"), *named, *described,
                F.date_format("sanction_date", "yyyy-MM-dd").alias("Sanction Date"),
                F.concat(F.lit("₹ "), F.format_number("sanctioned_amount", 0)).alias("Sanction AMOUNT ( ₹ )"),
            ),
            code, "sanctioned",
        )
        export(
            own.filter("has_completed").select(
                number.alias("Work"), *named, *described,
                F.date_format("o_orderdate", "dd-MMM-yyyy").alias("Completion Date"),
                F.format_number("o_totalprice", 2).alias("Amount Disbursed ( ₹ )"),
            ),
            code, "completed",
        )
        paid = lines.join(own, F.col("l_orderkey") == F.col("o_orderkey"))
        unlinked = F.when(F.col("l_quantity") < 2, F.lit("no work")).otherwise(number)
        export(
            paid.select(
                unlinked.alias("Work ID"), *named,
                F.date_format("l_shipdate", "dd-MMM-yyyy").alias("Expenditure Date"),
                F.when(F.col("l_tax") > 0, F.concat(F.lit("Vendor "), "l_suppkey")).otherwise("nan").alias("Vendor Name"),
                F.when(F.col("l_linestatus") == "F", "Paid").otherwise(" ").alias("Payment Status"),
                F.format_number(F.floor("l_extendedprice"), 0).alias("Fund Disbursed Amount ( ₹ )"),
            ),
            code, "expenditure",
        )
        members = _people(spark, folder).filter(is_lower() if lower else ~is_lower())
        export(members.select(*named, F.format_number(F.abs("c_acctbal"), 2).alias("Allocated AMOUNT ( ₹ )")), code, "allocation")
        consents = members.join(table(spark, folder, "events"), F.col("user_id") == F.col("c_custkey"))
        export(
            consents.select(
                F.col("event_id").cast("string").alias("Sr. No."),
                F.col("event_type").alias("Calamity Type"),
                F.concat_ws(" ", F.lit("Flood"), "user_id").alias("Calamity Name"),
                titled.alias("Hon'ble Members of Parliament"),
                F.date_format("ts", "dd-MMM-yyyy").alias("Date of Consent"),
                F.format_number("value", 2).alias("Consent Amount ( ₹ )"),
            ),
            code, "calamity",
        )
