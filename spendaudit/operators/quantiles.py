"""Exact quantiles and rank percentiles that never gather one group into one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from spendaudit.functions.text import round_scaled
from spendaudit.session import materialize


# a sliver holds about this many rank errors of the sketch: a safe margin on both sides of the quantile
SLIVER_SHARE = 16
# different values that one task ranks, and parts that a sliver with more of them is divided into
RANKED_AT_ONCE = 1_000_000
PARTS = 64


def exact_quantiles(
    df: DataFrame,
    measures: dict[str, Column],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
    ranked_at_once: int = RANKED_AT_ONCE,
) -> DataFrame:
    """Linear-interpolated quantiles of several measures per group, as a small written table.

    Output: ``by`` columns, ``measure``, ``n`` and one column ``q0, q1, …`` per probability.

    A mergeable sketch first brackets each quantile (its rank error is at most n / accuracy), values
    outside the bracket are only counted, and just the bracketed sliver is ranked: a share of
    16 / accuracy of a group, ties counted together. A sliver with more than ``ranked_at_once`` different
    values is bracketed again within itself until none has, so that no task ranks more, however large a group is.
    """
    by = list(by)
    pairs = F.array(
        *[F.struct(F.lit(m).alias("measure"), c.cast("double").alias("value")) for m, c in measures.items()]
    )
    values = df.select(*by, F.inline(pairs)).filter("value IS NOT NULL")
    return materialize(_bracketed(values, [*by, "measure"], probs, accuracy, ranked_at_once), "quantiles")


def _narrowed(values: DataFrame, keys: list[str], brackets: DataFrame, accuracy: int, ranked_at_once: int) -> DataFrame:
    """The brackets, drawn in until each holds few different values.

    Of ``PARTS`` equal parts of the values within a bracket, the position's own and one more on either side
    stay: the sketch's rank error is far smaller than a part.
    """
    grid = [i / PARTS for i in range(PARTS + 1)]
    while True:
        wide = brackets.filter("lo < hi")
        inside = (
            values.join(wide, keys)
            .filter("value <= hi")
            .groupBy(*keys, "prob_no")
            .agg(
                F.count_if(F.col("value") < F.col("lo")).alias("below"),
                F.count_if(F.col("value") >= F.col("lo")).alias("rows"),
                F.approx_count_distinct(F.when(F.col("value") >= F.col("lo"), F.col("value"))).alias("different"),
                F.percentile_approx(F.when(F.col("value") >= F.col("lo"), F.col("value")), grid, max(accuracy, 100 * PARTS)).alias("grid"),
            )
        )
        # a part must hold more than the two rows that a position lies between
        inside = inside.filter((F.col("different") > ranked_at_once) & (F.col("rows") > 4 * PARTS))
        inside = materialize(inside, "wide_brackets")
        drawn = brackets.join(inside, [*keys, "prob_no"])
        at = (F.floor("position") - F.col("below")) / F.col("rows") * PARTS
        first, last = F.floor(at).cast("int") - 1, F.ceil(at).cast("int") + 1
        lo = F.when(first > 0, F.greatest("lo", F.get("grid", first))).otherwise(F.col("lo"))
        hi = F.when(last < PARTS, F.least("hi", F.get("grid", last))).otherwise(F.col("hi"))
        drawn = drawn.select(*keys, "n", "prob_no", "position", lo.alias("lo"), hi.alias("hi"), F.col("lo").alias("was_lo"), F.col("hi").alias("was_hi"))
        drawn = materialize(drawn, "drawn_brackets")
        if drawn.filter("lo > was_lo OR hi < was_hi").isEmpty():
            return brackets
        rest = brackets.join(drawn.select(*keys, "prob_no"), [*keys, "prob_no"], "left_anti")
        brackets = materialize(rest.unionByName(drawn.drop("was_lo", "was_hi")), "brackets")


def _bracketed(values, keys, probs, accuracy, ranked_at_once):
    margin = SLIVER_SHARE / 2 / accuracy
    edges = [e for p in probs for e in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = values.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.percentile_approx("value", edges, accuracy).alias("edges"),
    )
    # in a group this small the positions fall between the sketch's ranks, so all of it is ranked
    whole = F.col("n") <= accuracy
    targets = F.array(
        *[
            F.struct(
                F.lit(i).alias("prob_no"),
                (F.lit(p) * (F.col("n") - 1)).alias("position"),
                F.when(whole, F.col("least")).otherwise(F.col("edges")[2 * i]).alias("lo"),
                F.when(whole, F.col("most")).otherwise(F.col("edges")[2 * i + 1]).alias("hi"),
            )
            for i, p in enumerate(probs)
        ]
    )
    brackets = materialize(sketch.select(*keys, "n", F.inline(targets)), "brackets")
    largest = brackets.agg(F.max("n")).first()[0] or 0
    if largest * SLIVER_SHARE > ranked_at_once * accuracy:  # else no sliver can hold so many values
        brackets = _narrowed(values, keys, brackets, accuracy, ranked_at_once)

    group = [*keys, "prob_no", "n", "position"]
    sliver = (
        values.join(brackets, keys)
        .filter("value <= hi")
        .groupBy(*group, F.when(F.col("value") >= F.col("lo"), F.col("value")).alias("v"))
        .agg(F.count("*").alias("copies"))
    )
    upto = Window.partitionBy(*group).orderBy(F.col("v").asc_nulls_first())
    ranked = sliver.withColumn("upto", F.sum("copies").over(upto))
    below, above = F.floor("position"), F.ceil("position")
    ends = ranked.groupBy(*group).agg(
        F.min(F.when(F.col("upto") >= below + 1, F.col("v"))).alias("a"),
        F.min(F.when(F.col("upto") >= above + 1, F.col("v"))).alias("b"),
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("position") - F.floor("position"))
    return ends.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("prob_no") == i, value)).alias(f"q{i}") for i in range(len(probs))],
    )


def rank_steps(df: DataFrame, score: str, decimals: int = 1) -> tuple[list[float], list[float]]:
    """Lowest score that reaches each rounded rank percentile (average rank of ties).

    The rounded percentile takes at most 100·10^decimals + 1 values and grows with the score, so this
    bounded list describes the ranks of the whole table. Ties are counted before ranking and the
    distinct scores are ranged over the cluster; only the slice totals come to the driver.
    """
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count("*").alias("copies"))
    ranged = counts.repartitionByRange("score").withColumn("slice", F.spark_partition_id())
    ranged = materialize(ranged, "ranked_scores")

    totals = ranged.groupBy("slice").agg(F.sum("copies").alias("rows")).orderBy("slice").collect()
    if not totals:
        return [], []
    ends = list(accumulate(t.rows for t in totals))
    offsets = df.sparkSession.createDataFrame(
        [(t.slice, end - t.rows) for t, end in zip(totals, ends)], "slice int, before long"
    )
    inside = Window.partitionBy("slice").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("before") + F.sum("copies").over(inside)
    average = last - (F.col("copies") - 1) / 2
    steps = (
        ranged.join(offsets, "slice")
        .select("score", round_scaled(average / F.lit(ends[-1]) * 100, decimals).alias("percentile"))
        .groupBy("percentile")
        .agg(F.min("score").alias("score"))
        .orderBy("score")
        .collect()
    )
    return [s.score for s in steps], [s.percentile for s in steps]


def percentile_rank(df: DataFrame, score: str, at: Column | None = None, decimals: int = 1) -> Column:
    """Column with the rounded rank percentile of a value among the scores of ``df``.

    ``at`` is the value to place, the score itself unless given. The steps travel with the column, so
    applying it shuffles nothing.
    """
    scores, percentiles = rank_steps(df, score, decimals)
    starts, labels = np.array(scores), np.array(percentiles)

    @F.pandas_udf(DoubleType())
    def locate(values: pd.Series) -> pd.Series:
        found = np.searchsorted(starts, values.to_numpy(), side="right") - 1
        return pd.Series(labels[found.clip(0)]).where(values.notna().to_numpy())

    return locate(F.col(score) if at is None else at) if scores else F.lit(None).cast("double")
