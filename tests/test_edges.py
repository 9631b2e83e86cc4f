import math

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import impute, profile, score, validate
from tabsmith.operators.correlate import corr_with
from tabsmith.operators.moments import skew_kurtosis


def test_constant_column_null_stats_no_error(spark):
    df = spark.createDataFrame([(i, 5.0, float(i)) for i in range(10)], "key long, x double, z double")
    m = {r["feature"]: r for r in skew_kurtosis(df, ["x"]).collect()}
    assert m["x"]["skewness"] is None and m["x"]["kurtosis"] is None
    r = corr_with(df, "z", ["x"], k=None).collect()
    assert r == []  # NULL correlation dropped, no DIVIDE_BY_ZERO


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    r = profile.missing_profile(df).collect()[0]
    assert r["missing_count"] == 2


def test_infinity_rejected_and_empty_rejected(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),)], "x double")
    with pytest.raises(ValueError):
        validate.range_check(df, ["x"])
    with pytest.raises(ValueError):
        validate.integrity(spark.createDataFrame([], "key long, x double"), "empty")
    with pytest.raises(ValueError):
        validate.integrity(spark.createDataFrame([(None,), (None,)], "x double"), "all_null")


def test_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (1.0,), (3.0,), (None,)], "x double")
    out, fills = impute.mode_fill(df, ["x"])
    assert fills["x"] == 1.0
    assert out.filter(F.col("x").isNull()).count() == 0


def test_zero_target_mape_and_relative_error(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0), (1, 2.0, 1.0), (2, 4.0, 5.0)], "key long, y double, prediction double")
    m = score.performance_metrics(df, "y").first()
    assert math.isclose(m["mape"], (0.5 + 0.25) / 2 * 100)
    e = {r["key"]: r["relative_error_pct"] for r in score.error_table(df, "key", "y").collect()}
    assert e[0] is None


def test_odd_column_names(spark):
    names = ["a ", " b", "c(%)", "d×e（f)"]
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (2.0, 1.0, 0.0, 8.0), (3.0, 5.0, 1.0, 1.0)], names)
    r = {x["column"]: x for x in profile.value_ranges(df).collect()}
    assert set(r) == set(names)
