import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendaudit import AuditConfig
from spendaudit.operators.forest import MONEY_FEATURES, OTHER_FEATURES, average_path, feature_vector, isolation_forest, normalized_scores, robust_scaled
from spendaudit.session import materialize

CONFIG = AuditConfig(trees=60, sample_size=128)


def works(spark, n=1500, planted=15):
    rng = np.random.default_rng(2)
    data = {c: rng.lognormal(10, 0.5, n) for c in MONEY_FEATURES}
    data |= {c: rng.normal(0, 1, n) for c in OTHER_FEATURES}
    df = pd.DataFrame(data)
    df.loc[: planted - 1, MONEY_FEATURES] *= 1e4
    df.loc[: planted - 1, ["payment_count", "vendor_count", "exp_robust_zscore"]] += 12
    df["work_id"] = [f"w{i}" for i in range(n)]
    df["parliament_house"] = np.where(rng.random(n) < 0.7, "Lok Sabha", "Rajya Sabha")
    df.loc[::10, "sanc_robust_zscore"] = np.nan
    sdf = spark.createDataFrame(df)
    return sdf.withColumn("sanc_robust_zscore", F.when(~F.isnan("sanc_robust_zscore"), F.col("sanc_robust_zscore")))


def scores(df, config=CONFIG):
    measured = materialize(df.select("work_id", isolation_forest(df, config).alias("raw_score")), "measured")
    return {r.work_id: r for r in measured.select("work_id", *[c.alias(n) for n, c in normalized_scores(measured).items()]).collect()}


def test_planted_outliers_rank_highest(spark):
    got = scores(works(spark))
    top = sorted(got.values(), key=lambda r: -r.ml_anomaly_percentile)[:15]
    assert {r.work_id for r in top} == {f"w{i}" for i in range(15)}
    assert max(r.ml_anomaly_score for r in got.values()) == 1.0 and min(r.ml_anomaly_score for r in got.values()) == 0.0
    assert np.mean([r.ml_anomaly_percentile for r in got.values()]) == pytest.approx(50, abs=0.2)


def test_same_result_for_any_partitioning(spark):
    df = works(spark, 600)
    one, many = scores(df.coalesce(1)), scores(df.repartition(9, F.rand(1)))
    assert one == many


def test_missing_values_take_the_median(spark):
    df = works(spark, 401)
    filled = df.select("work_id", *feature_vector(df)).toPandas()
    original = df.toPandas()
    median = original["sanc_robust_zscore"].median()
    missing = original.loc[original["sanc_robust_zscore"].isna(), "work_id"]
    assert np.allclose(filled.set_index("work_id").loc[missing, "sanc_robust_zscore"], median)
    assert np.allclose(filled.sort_values("work_id")["total_expenditure"], np.log1p(original.sort_values("work_id")["total_expenditure"]))


def test_small_and_empty_tables(spark):
    df = works(spark, 3, 0)
    assert len(scores(df)) == 3
    assert scores(df.limit(0)) == {}


def test_average_path():
    assert [average_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert average_path(256) == pytest.approx(10.244, abs=0.001)


def test_robust_scaling(spark):
    rng = np.random.default_rng(2)
    values = np.column_stack([rng.lognormal(size=501), rng.integers(0, 9, 501), np.full(501, 3.0)])
    df = spark.createDataFrame(values.tolist(), "a double, b double, c double")
    got = np.array(df.select(*robust_scaled(df, ["a", "b", "c"])).collect())
    low, middle, high = np.quantile(values, [0.25, 0.5, 0.75], axis=0)
    np.testing.assert_allclose(got, (values - middle) / np.where(high > low, high - low, 1.0), rtol=1e-12, atol=1e-12)
    nothing = spark.createDataFrame([(None,)], "a double")
    assert nothing.select(*robust_scaled(nothing, ["a"])).collect()[0].a is None
