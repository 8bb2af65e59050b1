import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendaudit.operators.quantiles import exact_quantiles, percentile_rank


def frame(spark, values: dict[str, np.ndarray]):
    return spark.createDataFrame(pd.DataFrame([(g, float(v)) for g, vs in values.items() for v in vs], columns=["g", "v"]), "g string, v double")


def groups(seed):
    rng = np.random.default_rng(seed)
    return {
        "hot": rng.lognormal(3, 2, 20000),
        "tied": rng.integers(0, 5, 3000).astype(float),
        "constant": np.full(500, 7.0),
        "small": rng.normal(size=11),
        "one": np.array([3.5]),
        "two": np.array([1.0, 4.0]),
        "negative": -rng.exponential(size=4000),
    }


@pytest.mark.parametrize("options", [{}, {"accuracy": 200}, {"accuracy": 1000}])
@pytest.mark.parametrize("seed", [1, 2])
def test_group_quantiles_are_exact(spark, options, seed):
    data, probs = groups(seed), [0.0, 0.33, 0.5, 0.9, 0.95, 0.97, 1.0]
    found = exact_quantiles(frame(spark, data), {"v": F.col("v"), "w": F.col("v") * 2}, probs, ["g"], **options).collect()
    assert len(found) == 2 * len(data)
    for row in found:
        values = data[row.g] * (2 if row.measure == "w" else 1)
        want = np.quantile(values, probs)
        assert row.n == len(values)
        np.testing.assert_allclose([row[f"q{i}"] for i in range(len(probs))], want, rtol=1e-12, atol=1e-12)


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert exact_quantiles(df, {"v": F.col("v")}, [0.5], ["g"]).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_rank_percentile_like_average_rank(spark, partitions):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.integers(-2, 3, 400)])
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(values)), "v": values})).repartition(partitions)
    df = df.unionByName(spark.createDataFrame([(-1, None)], "i long, v double"))
    got = {r.i: r.p for r in df.select("i", percentile_rank(df, "v").alias("p")).collect()}
    want = np.round(pd.Series(values).rank(pct=True) * 100.0, 1)
    assert got.pop(-1) is None
    assert [got[i] for i in range(len(values))] == want.tolist()


def test_rank_percentile_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert df.select(percentile_rank(df, "v")).first()[0] is None


@pytest.mark.parametrize("ranked_at_once", [3, 100, 1000])
def test_slivers_are_drawn_in(spark, ranked_at_once):
    """Every window ranks few values, with the same results; groups of one value, of few, and of many."""
    data, probs = groups(4), [0.0, 0.33, 0.5, 0.9, 0.97, 1.0]
    found = exact_quantiles(frame(spark, data), {"v": F.col("v")}, probs, ["g"], accuracy=200, ranked_at_once=ranked_at_once).collect()
    assert len(found) == len(data)
    for row in found:
        np.testing.assert_allclose([row[f"q{i}"] for i in range(len(probs))], np.quantile(data[row.g], probs), rtol=1e-12, atol=1e-12)


def test_one_large_group_with_a_low_limit(spark):
    """Three million values of one group; at most a thousand are ranked in a task."""
    from spendaudit.operators import quantiles

    n = 3_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("v"))
    wide = quantiles.exact_quantiles(df, {"v": F.col("v")}, [0.25, 0.5, 0.9]).first()
    low = quantiles.exact_quantiles(df, {"v": F.col("v")}, [0.25, 0.5, 0.9], ranked_at_once=1000).first()
    assert wide == low and [low.q0, low.q1, low.q2] == [pytest.approx((n - 1) * p) for p in (0.25, 0.5, 0.9)]
    values = df.select(F.lit("v").alias("measure"), F.col("v").alias("value"))
    bracket = spark.createDataFrame([("v", n, 0, 0.5 * (n - 1), 0.0, float(n - 1))], "measure string, n long, prob_no int, position double, lo double, hi double")
    drawn = quantiles._narrowed(values, ["measure"], bracket, 10_000, 1000).first()
    assert drawn.lo <= 0.5 * (n - 1) <= drawn.hi and drawn.hi - drawn.lo < 1100
