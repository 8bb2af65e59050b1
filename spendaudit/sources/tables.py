"""Curated tables: reading (required or optional), export, counts, and filling gaps from the master."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendaudit import fixed_values as fixed
from spendaudit.functions.text import member_id, parse_date, strip


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A required table (Parquet, or CSV with a header when the name says so)."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return spark.read.parquet(path)


def read_optional(spark: SparkSession, candidates: Sequence[str], schema: str) -> DataFrame:
    """First candidate that exists, else an empty table of the given schema."""
    for path in candidates:
        try:
            return read_table(spark, path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def tidy_keys(df: DataFrame) -> DataFrame:
    """Trimmed ``work_id`` and real dates in whatever date columns the table has."""
    types = dict(df.dtypes)
    changes: dict[str, Column] = {}
    if "work_id" in types:
        changes["work_id"] = strip(F.col("work_id"))
    for c in fixed.TABLE_DATES:
        if types.get(c) == "string":
            changes[c] = parse_date(F.col(c))
        elif types.get(c, "date") != "date":
            changes[c] = F.col(c).cast("date")
    return df.withColumns(changes) if changes else df


def first_per_work(master: DataFrame, fields: list[str]) -> DataFrame:
    """Earliest row of each work by ``row_order``, constant state per key. Without an order the least row is taken,
    so that the result does not depend on how the table is read."""
    row = F.struct(*fields)
    first = F.min_by(row, F.col("row_order")) if "row_order" in master.columns else F.min(row)
    return master.groupBy("work_id").agg(first.alias("m")).select("work_id", "m.*")


def fill_from_master(scored: DataFrame, master: DataFrame) -> DataFrame:
    """Scored works whose missing or blank fields are filled from the master table.

    Scored values always win; a field the scored table lacks is taken over whole.
    """
    fields = [f for f in fixed.MASTER_FIELDS if f in master.columns]
    if not fields or "work_id" not in master.columns:
        return scored
    types = dict(scored.dtypes)
    extra = first_per_work(master, fields).select("work_id", *[F.col(f).alias(f"master_{f}") for f in fields])
    filled: dict[str, Column] = {}
    for f in fields:
        own = F.col(f) if f in types else F.lit(None)
        if types.get(f) == "string":
            own = F.when(strip(own) != "", own)
        filled[f] = F.coalesce(own, F.col(f"master_{f}"))
    return scored.join(extra, "work_id", "left").withColumns(filled).drop(*[f"master_{f}" for f in fields])


def with_defaults(scored: DataFrame) -> DataFrame:
    """Defaults for columns the table lacks, and the member id."""
    absent = {
        c: F.lit(v) if v is not None else F.lit(None).cast("double")
        for c, v in fixed.DEFAULT_COLUMNS.items()
        if c not in scored.columns
    }
    return scored.withColumns({**absent, "mp_id": member_id(F.col("parliament_house"), F.col("mp_name"))})


def work_data(scored: DataFrame, master: DataFrame) -> DataFrame:
    """The table all reports read, from separately stored scored works and master."""
    return with_defaults(fill_from_master(tidy_keys(scored), tidy_keys(master)))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export with a header; list columns as JSON text, flags and numbers as they print."""
    flat = [
        F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes
    ]
    df.select(*flat).write.option("header", True).option("escape", '"').csv(path)


def write_tables(tables: dict[str, DataFrame], folder: str, csv: bool = False) -> dict[str, str]:
    """Write each table once; tables that know the chamber are partitioned by it."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}"
        if csv:
            export_csv(df, paths[name])
        else:
            by = [c for c in ("parliament_house",) if c in df.columns]
            df.write.partitionBy(*by).parquet(paths[name])
    return paths


def data_quality(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """dataset, records, status — one count per table."""
    counts = [
        df.agg(F.count("*").alias("records")).select(F.lit(name).alias("dataset"), "records", F.lit(status).alias("status"))
        for name, (df, status) in tables.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
