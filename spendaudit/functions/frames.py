"""Small helpers on whole DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(frames: list[DataFrame]) -> DataFrame:
    """Several one-row tables with different columns as a single row (a union and an aggregate, so no
    join without a key is needed)."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
