"""Helpers of the training-data operators: Arrow batches in and out, digests, fast word splitting."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows turned into Python objects at a time, whatever the size of the Arrow batches.
SLICE_ROWS = 256

WHITE_SPACE = " \t\n\x0b\x0c\r"


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: Rows of an Arrow batch: texts are long, and both sides of the exchange hold a batch.
BATCH_ROWS = 512


def on_workers(df: DataFrame) -> DataFrame:
    """Make ready for Python in tasks: send this package to the workers, and bound the rows of Arrow batches in this
    session, unless it sets a bound of its own."""
    spark = df.sparkSession
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, str(BATCH_ROWS))
    _send_package(spark.sparkContext.applicationId)
    return df


@lru_cache(maxsize=64)
def _send_package(application: str) -> None:
    """Once per application: workers need not have the package installed. Spark sends the file from the driver to them."""
    root = Path(__file__).parents[1]
    if not root.is_dir():  # the package came to the driver as a file already, and so to the workers
        return
    target = Path(tempfile.mkdtemp(prefix="spendaudit-package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    SparkContext.getOrCreate().addPyFile(str(target))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads; other columns, whatever their names, stay behind."""
    return on_workers(docs).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """One output row for each input row: ``make()`` runs once per task and returns the row function.

    Rows travel as Arrow batches; only ``SLICE_ROWS`` rows at a time are Python objects.
    """
    names = [part.strip().split(" ")[0].strip("`") for part in _top_level(schema)]
    types = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = [row(*values) for values in zip(*(c.to_pylist() for c in part.columns))]
                columns = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return df.mapInArrow(run, schema)


def _top_level(schema: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[start:i])
            start = i + 1
    return [*parts, schema[start:]]


def _arrow_schema(schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return list(to_arrow_schema(_parse_datatype_string(schema)).types)
