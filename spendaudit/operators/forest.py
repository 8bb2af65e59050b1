"""Isolation forest: hash-sampled trees grown in parallel, scored map-only.

Follows the published algorithm (Liu, Ting, Zhou 2008). All draws come from md5 digests of seed, tree, node
and work id, so the forest is the same for any partitioning of the works and can be regrown in SQL.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from spendaudit import fixed_values as fixed
from spendaudit.config import AuditConfig
from spendaudit.functions.text import round_scaled
from spendaudit.operators.quantiles import exact_quantiles, percentile_rank
from spendaudit.session import materialize

MONEY_FEATURES = ["sanctioned_amount", "total_expenditure", "completion_amount"]
OTHER_FEATURES = [
    "payment_count", "vendor_count", "vendor_concentration_score", "largest_payment_ratio",
    "duplicate_payment_count", "sanc_robust_zscore", "exp_robust_zscore",
]
NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, length double"


def median_fill(features: DataFrame, columns: list[str], **options) -> dict[str, float]:
    """Population median of each column, 0 for a column without values."""
    rows = exact_quantiles(features, {c: F.col(c) for c in columns}, [0.5], **options).collect()
    found = {r.measure: r.q0 for r in rows}
    return {c: found.get(c, 0.0) for c in columns}


def feature_vector(features: DataFrame, **options) -> list[Column]:
    """The model's columns: medians for missing values, log of money, chamber as a flag.

    Centring and scaling a column cannot change where uniform random cuts fall, so no scaler is fitted.
    """
    fill = median_fill(features, MONEY_FEATURES + OTHER_FEATURES, **options)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fill.items()}
    logged = [F.log1p(F.greatest(F.lit(0.0), filled[c])).alias(c) for c in MONEY_FEATURES]
    lower = F.col("parliament_house").eqNullSafe(F.lit(fixed.LOWER_HOUSE)).cast("double")
    return [*logged, *[filled[c].alias(c) for c in OTHER_FEATURES], lower.alias("is_lower_house")]


def robust_scaled(vectors: DataFrame, columns: list[str], **options) -> list[Column]:
    """Columns less their median, in units of the distance between their quartiles (1 where that is 0).

    The forest needs no scaling (see ``feature_vector``); measures of distance do. Three quantiles for each column
    come to the driver.
    """
    rows = exact_quantiles(vectors, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75], **options).collect()
    found = {r.measure: (r.q1, (r.q2 - r.q0) or 1.0) for r in rows}
    return [((F.col(c) - found[c][0]) / found[c][1] if c in found else F.col(c).cast("double")).alias(c) for c in columns]


def digest(*parts: Column) -> Column:
    """Hexadecimal digits that any engine can draw from the same parts."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def tree_samples(vectors: DataFrame, rows: int, key: str, config: AuditConfig) -> DataFrame:
    """Up to ``sample_size`` rows for each tree, chosen by digests of the key.

    Of a large table one digest drops almost all rows; the others draw as many trees each as leave every
    tree about twice the rows it needs, and the lowest digests are kept. A small table is drawn whole.
    """
    wanted = 2 * config.sample_size * config.trees
    seed, name = F.lit(config.seed), F.col(key)
    if rows > wanted:
        limit = format(int(wanted / rows * 16**12), "012x")
        vectors = vectors.filter(F.substring(digest(seed, F.lit("pool"), name), 1, 12) < limit)
    draws = min(config.trees, -(-wanted // max(rows, 1)))
    numbers = F.sequence(F.lit(0), F.lit(draws - 1))

    def tree_of(draw: Column) -> Column:
        return F.conv(F.substring(digest(seed, F.lit("draw"), draw, name), 1, 8), 16, 10).cast("long") % config.trees

    trees = numbers if draws == config.trees else F.array_distinct(F.transform(numbers, tree_of))
    drawn = vectors.select("*", F.explode(trees.cast("array<int>")).alias("tree"))
    first = Window.partitionBy("tree").orderBy(digest(seed, F.lit("order"), F.col("tree"), name), key)
    return drawn.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= config.sample_size)


def average_path(size: float) -> float:
    """Expected depth of an unsuccessful search among ``size`` rows."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (math.log(size - 1) + np.euler_gamma) - 2.0 * (size - 1) / size


#: Path lengths are counted in whole millionths, so that their sums do not depend on the order of the trees.
PATH_UNIT = 1_000_000


def depth_limit(sample: int) -> int:
    return max(1, math.ceil(math.log2(max(sample, 1))))


def grow_forest(samples: DataFrame, names: list[str], config: AuditConfig, limit: int) -> DataFrame:
    """One small group per tree (at most ``sample_size`` rows), grown on the executors.

    Feature and cut of a node are drawn from a digest of seed, tree and place of the node. The function sent
    to the executors refers to nothing of this package, so they need not have it installed.
    """
    seed, unit = config.seed, PATH_UNIT
    rest = [round(average_path(n) * unit) for n in range(config.sample_size + 1)]

    def one_tree(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        tree = int(pdf["tree"].iloc[0])
        nodes: list = []

        def grow(rows: np.ndarray, depth: int, heap: int) -> int:
            place = len(nodes)
            # a leaf leads to itself, so that scoring needs no test for leaves
            nodes.append((0, np.inf, place, place, float(depth * unit + rest[len(rows)])))
            low, high = rows.min(axis=0), rows.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not usable.size:
                return place
            drawn = hashlib.md5(f"{seed}|node|{tree}|{heap}".encode()).hexdigest()
            feature = int(usable[int(drawn[:8], 16) % len(usable)])
            cut = float(low[feature] + int(drawn[8:16], 16) / 2**32 * (high[feature] - low[feature]))
            if cut >= high[feature]:
                return place
            goes_left = rows[:, feature] <= cut
            left = grow(rows[goes_left], depth + 1, 2 * heap)
            nodes[place] = (feature, cut, left, grow(rows[~goes_left], depth + 1, 2 * heap + 1), 0.0)
            return place

        grow(pdf.sort_values("place")[names].to_numpy(dtype=float), 0, 1)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "length"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    return samples.groupBy("tree").applyInPandas(one_tree, NODE_SCHEMA)


def forest_score(nodes: pd.DataFrame, inputs: list[Column], steps: int, sample_size: int) -> Column:
    """Anomaly score 2^(-mean path / expected path) of each row, all rows of a batch at once.

    ``steps`` is the depth of the trees, ``sample_size`` the number of rows each was grown from.
    """
    trees = [
        tuple(g[c].to_numpy() for c in ("feature", "cut", "left", "right", "length"))
        for _, g in nodes.sort_values(["tree", "node"]).groupby("tree")
    ]
    expected = (average_path(sample_size) or 1.0) * PATH_UNIT

    @F.pandas_udf(DoubleType())
    def score(*columns: pd.Series) -> pd.Series:
        values = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        rows, total = np.arange(len(values)) * values.shape[1], np.zeros(len(values))
        flat = values.ravel()
        for feature, cut, left, right, length in trees:
            at = np.zeros(len(values), dtype=np.int32)
            for _ in range(steps):
                low = flat.take(rows + feature.take(at)) <= cut.take(at)
                at = np.where(low, left.take(at), right.take(at))
            total += length.take(at)
        return pd.Series(np.exp2(-total / len(trees) / expected))

    return score(*inputs)


def normalized_scores(scored: DataFrame) -> dict[str, Column]:
    """0..1 score (4 decimals) and rank percentile (1 decimal) of the written column ``raw_score``.

    The results are plain columns over the same table: applying them shuffles nothing.
    """
    raw = scored.select("raw_score")
    ends = raw.agg(F.min("raw_score"), F.max("raw_score")).first()
    low, high = (0.0 if v is None else float(v) for v in ends)
    unit = (F.col("raw_score") - F.lit(low)) / F.lit(max(high - low, 1e-6))
    return {
        "ml_anomaly_score": round_scaled(unit, 4),
        "ml_anomaly_percentile": percentile_rank(raw, "raw_score"),
    }


def isolation_forest(features: DataFrame, config: AuditConfig = AuditConfig(), key: str = "work_id") -> Column:
    """Anomaly measure of the forest grown from ``features``, as a column over ``features``.

    The rows are scored where they are; write the column once, then rank it (:func:`normalized_scores`).
    """
    inputs = feature_vector(features)
    vectors = features.select(key, *inputs)
    names = [n for n in vectors.columns if n != key]
    rows = features.count()
    samples = tree_samples(vectors, rows, key, config)
    # at most trees x (2 x sample_size - 1) rows, whatever the size of the table
    sample = min(config.sample_size, rows)
    nodes = grow_forest(samples, names, config, depth_limit(sample)).toPandas()
    if nodes.empty:
        return F.lit(None).cast("double")
    return forest_score(nodes, inputs, depth_limit(sample), sample)


def ranking_model(column: str):
    """A stand-in model that ranks works by one plain column; used where a run has to be restated in
    SQL, which cannot grow the forest."""

    def model(features: DataFrame, config: AuditConfig) -> Column:
        return F.col(column).cast("double")

    model.plain = True
    return model
