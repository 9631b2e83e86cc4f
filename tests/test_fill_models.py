"""Fill models: fitted on train, saved, loaded, applied to other rows."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from tabsmith.operators import impute
from tabsmith.operators.fill_models import GapFiller, GapFillerModel

SCHEMA = "key long, a double, b double, c double"


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3))
    x[:, 2] = 2 * x[:, 0] - x[:, 1] + 0.01 * x[:, 2]
    gaps = rng.random(400) < 0.2
    rows = [(i, float(r[0]), float(r[1]), None if g else float(r[2])) for i, (r, g) in enumerate(zip(x, gaps))]
    return spark.createDataFrame(rows[:300], SCHEMA), spark.createDataFrame(rows[300:], SCHEMA), x, gaps


def fitted(train, tmp_path, **kw):
    model = GapFiller(inputCols=["c"], keyCol="key", **kw).fit(train)
    model.write().save(str(tmp_path / "model"))
    return GapFillerModel.load(str(tmp_path / "model"))


def filled(model, test):
    return np.array([r["c"] for r in model.transform(test).orderBy("key").collect()], float)


def test_values_and_lines(tables, tmp_path):
    train, test, x, gaps = tables
    known, gap = x[:300][~gaps[:300]], gaps[300:]
    for how, value in (("mean", known[:, 2].mean()), ("median", np.median(known[:, 2]))):
        got = filled(fitted(train, tmp_path / how, strategy=how), test)
        np.testing.assert_allclose(got[gap], value)
        np.testing.assert_allclose(got[~gap], x[300:][~gap, 2])
    slope, intercept = np.polyfit(known[:, 0], known[:, 2], 1)
    np.testing.assert_allclose(filled(fitted(train, tmp_path / "line", strategy="regression", predictor="a"), test)[gap], intercept + slope * x[300:][gap, 0])
    got = filled(fitted(train, tmp_path / "multi", strategy="multi_regression"), test)
    assert np.abs(got[gap] - x[300:][gap, 2]).max() < 0.1


def test_neighbours_come_from_the_training_rows_alone(tables, tmp_path):
    train, test, x, gaps = tables
    model = fitted(train, tmp_path, strategy="knn", referenceCols=["a", "b"], k=3)
    got = filled(model, test.limit(200))
    for i in np.flatnonzero(gaps[300:]):
        both = x[:300][~gaps[:300]]
        d = ((both[:, :2] - x[300 + i, :2]) ** 2).sum(1)
        assert abs(got[i] - both[np.argsort(d, kind="stable")[:3], 2].mean()) < 1e-9
    assert model.transform(test.limit(0)).count() == 0 and model.transform(train).where("c IS NULL").count() == 0


def test_in_a_pipeline(spark, tables, tmp_path):
    train, test, _, _ = tables
    chain = Pipeline(stages=[GapFiller(inputCols=["c", "b"], keyCol="key", strategy="handle", predictor="a", referenceCols=["a"])]).fit(train)
    chain.write().save(str(tmp_path / "chain"))
    again = PipelineModel.load(str(tmp_path / "chain"))
    extra = test.withColumn("b", test["b"].cast("double")).union(spark.createDataFrame([(900, 1.0, None, None), (901, None, None, None)], SCHEMA))
    one, two = (sorted(map(tuple, m.transform(extra).collect())) for m in (chain, again))
    assert one == two and all(r[2] is not None and r[3] is not None for r in one)


def test_predictors_are_present_where_the_target_is_missing(spark):
    rows = [(float(i), float(3 * i), None if i % 4 == 0 else float(3 * i), None if i % 4 == 0 else 6.0 * i + 1) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "a double, b double, twin double, t double")
    out, report = impute.multi_regression_fill(df, "t")
    assert "twin" not in report["predictors"]
    assert all(abs(r["t"] - (6 * r["a"] + 1)) < 1e-6 for r in out.collect())
