"""Raw CSV exports: all-string reading, cleaning, and a stable row position."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendaudit import fixed_values as fixed
from spendaudit.functions.text import blank_to_null, is_total_row, numeric_date
from spendaudit.session import materialize

# where a row came from: file, and a number that grows with the place in it
ORIGIN = ["file_path", "record"]
# exports loaded at a time
AT_ONCE = 4


def prefix_sums(table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``before_<value>``: sum of each value over all rows that come earlier by the keys.

    The rows are ranged over the cluster; only the totals of the slices come to the driver.
    """
    ranged = materialize(table.repartitionByRange(*keys).withColumn("slice", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("slice").agg(*[F.sum(v).alias(v) for v in values]).orderBy("slice").collect()
    starts = {v: [0, *accumulate(t[v] for t in totals)] for v in values}
    offsets = ranged.sparkSession.createDataFrame(
        [(t.slice, *[starts[v][i] for v in values]) for i, t in enumerate(totals)],
        "slice int" + "".join(f", slice_{v} long" for v in values),
    )
    earlier = Window.partitionBy("slice").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"before_{v}": F.col(f"slice_{v}") + F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v in values}
    return ranged.join(offsets, "slice").withColumns(sums).drop("slice", *[f"slice_{v}" for v in values])


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """One raw export with every column as text, plus the origin of each row.

    A missing path fails here: a run must not go on without one of its inputs. Every file has a header; the names are those
    of the first. A file is read by one task, because cells may hold line breaks; exports of many files are read side by
    side, and a cell that is never closed takes no more than the rest of its own file. Lines of white space only are left out.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    schema = ", ".join("`{}` string".format(n.replace("`", "``")) for n in reader.csv(path).columns)
    found = reader.schema(schema).csv(path)
    first, *others = (F.col("`{}`".format(n.replace("`", "``"))) for n in found.columns)
    blank = first.isNotNull() & (F.trim(first) == "")
    for cell in others:
        blank &= cell.isNull()
    place = [F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("record")]
    return found.filter(~blank).select("*", *place)


def clean_rows(df: DataFrame, strict_totals: bool = False) -> DataFrame:
    """Total lines removed, text trimmed, the spellings of "missing" turned into null.

    A row counts as a total line when any cell begins like one; ``strict_totals`` looks at the first
    cell only, which keeps a record whose description merely begins with the word "Total".
    """
    cells = [c for c in df.columns if c not in ORIGIN]
    kept = df.filter(~is_total_row(cells[:1] if strict_totals else cells))
    return kept.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) for c in cells], *[c for c in df.columns if c in ORIGIN])


def number_rows(cleaned: DataFrame, name: str) -> DataFrame:
    """Adds ``row_pos`` = 1, 2, 3, … in file order, without sorting or ranking rows.

    The rows are written once. Those of one export file lie one behind the other in a written file, whose row numbers
    Parquet knows; what comes before them is summed over files only.
    """
    columns = [c for c in cleaned.columns if c != "record"]
    stored = materialize(cleaned.select(*[F.col("`{}`".format(c.replace("`", "``"))) for c in columns]), name)
    written = stored.select("*", F.col("_metadata.file_name").alias("written_file"), F.col("_metadata.row_index").alias("written_row"))
    keys = ["file_path", "written_file"]
    files = written.groupBy(*keys).agg(F.count("*").alias("rows"), F.min("written_row").alias("first_row"))
    files = prefix_sums(files, keys, ["rows"])
    starts = materialize(files.select(*keys, (F.col("before_rows") - F.col("first_row") + 1).alias("start")), f"{name}-files")
    return written.join(starts, keys).withColumn("row_pos", F.col("start") + F.col("written_row")).drop(*keys, "written_row", "start")


def settle_date_order(df: DataFrame) -> DataFrame:
    """Date columns of an export in which the day comes first, rewritten with the year first; others as they are.

    Texts like 07/12/2025 don't tell which number is the day. The order of a column is the one in which more of its texts
    are dates, month first where both are as good: one day above 12 settles it for the whole file. One count for each column
    and order comes to the driver.
    """
    dates = [c for c in df.columns if "date" in c.lower()]
    cells = [F.col("`{}`".format(c.replace("`", "``"))) for c in dates]
    if not cells:
        return df
    read = [F.count(numeric_date(c, day_first)).alias(f"{i}_{day_first:d}") for i, c in enumerate(cells) for day_first in (False, True)]
    counts = df.agg(*read).first()
    turned = {
        name: F.coalesce(F.date_format(numeric_date(cell, True), "yyyy-MM-dd"), cell)
        for i, (name, cell) in enumerate(zip(dates, cells)) if counts[f"{i}_1"] > counts[f"{i}_0"]
    }
    return df.withColumns(turned) if turned else df


def raw_paths(folder: str) -> dict[tuple[str, str], str]:
    return {
        (code, kind): f"{folder}/{fixed.RAW_FOLDERS[code]}/{name}"
        for code in fixed.HOUSE_CODES
        for kind, name in fixed.RAW_FILES.items()
    }


def load_raw(
    spark: SparkSession,
    folder: str,
    paths: dict[tuple[str, str], str] | None = None,
    strict_totals: bool = False,
) -> dict[tuple[str, str], DataFrame]:
    """The twelve cleaned and numbered exports, keyed by (chamber code, kind).

    The exports don't depend on each other; a few are loaded at a time, so that small ones fill the cores together.
    """

    def one(item: tuple[tuple[str, str], str]) -> DataFrame:
        (code, kind), path = item
        return settle_date_order(number_rows(clean_rows(read_raw_csv(spark, path), strict_totals), f"raw_{code}_{kind}"))

    found = paths or raw_paths(folder)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return dict(zip(found, pool.map(one, found.items())))
