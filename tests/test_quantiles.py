import numpy as np
import pytest

from tabsmith.operators.quantiles import quantiles


@pytest.mark.parametrize("final_max", [10, 100_000])
def test_exact_quantiles_match_numpy(spark, final_max):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(size=3000), np.full(1500, 2.5)])  # a third of the rows share one value
    y = rng.normal(size=4500)
    y[::7] = np.nan
    df = spark.createDataFrame([(float(a), float(b) if not np.isnan(b) else None) for a, b in zip(x, y)], "x double, y double")
    probs = [0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]
    got = quantiles(df.repartition(5), ["x", "y"], probs, buckets=16, final_max=final_max)
    np.testing.assert_allclose(got["x"], np.percentile(x, [p * 100 for p in probs]), rtol=1e-12)
    np.testing.assert_allclose(got["y"], np.percentile(y[~np.isnan(y)], [p * 100 for p in probs]), rtol=1e-12)


def test_all_null_and_constant(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 5.0), (float("nan"), 5.0)], "a double, b double")
    got = quantiles(df, ["a", "b"], [0.25, 0.5])
    assert got["a"] == [None, None]
    assert got["b"] == [5.0, 5.0]
