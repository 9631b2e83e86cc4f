"""Hand-computed values of formulas, and cases that once failed."""

import math

import numpy as np
import pytest

from tabsmith.operators import chartdata, score, search
from tabsmith.operators.augment import augment
from tabsmith.operators.impute import knn_fill
from tabsmith.operators.knn import knn_average
from tabsmith.operators.quantiles import quantiles

from .test_knn import brute_fill


def test_convergence_of_the_last_tenth(spark):
    def of(values):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "g int, v double")
        return tuple(search.convergence_metrics(df, "v", "g").first())

    twenty = [1.0] * 18 + [10.0, 30.0]
    assert of(twenty)[0] == 20.0
    assert of(range(12))[0] == 0.0  # one value in the last tenth: no step
    assert of(twenty)[1] == pytest.approx(np.std([1.0, 1.0, 10.0, 30.0]))
    assert of(twenty)[2] == pytest.approx(2 / 19)
    assert of([5.0]) == (0.0, 0.0, 0.0)


def test_population_deviations(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 6.0)], "o int, prediction double")
    assert score.prediction_summary(df).first()["std"] == pytest.approx(np.std([1, 2, 6]))
    assert chartdata.series_summary(df, "prediction", "o").first()["std"] == pytest.approx(np.std([1, 2, 6]))


def test_quantiles_of_infinite_values(spark):
    values = [float(i) for i in range(50)] + [math.inf]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert quantiles(df, ["x"], [0.0, 0.5, 0.9, 1.0], buckets=4, final_max=5)["x"] == [0.0, 25.0, 45.0, math.inf]
    df = spark.createDataFrame([(v,) for v in [-math.inf] * 20 + values], "x double")
    assert quantiles(df, ["x"], [0.1, 0.5, 1.0], buckets=4, final_max=5)["x"] == [-math.inf, 15.0, math.inf]


def test_candidates_are_scored_on_executors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    y = 2 * x[:, 1] - x[:, 3] + 0.01 * rng.normal(size=200)
    df = spark.createDataFrame([(i % 5, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "fold int, a double, b double, c double, d double, y double")
    folds = search.fold_grams(df, ["a", "b", "c", "d"], "y")
    rows = spark.createDataFrame([(0, [False, True, False, True]), (1, [True, False, False, False])], "i int, bits array<boolean>")
    for _ in range(2):  # the input's schema stays as it was
        got = {r["i"]: r["fitness"] for r in search.score_candidates(rows, folds).collect()}
        assert got[0] == pytest.approx(search.fitness(folds, [1, 3])) and got[0] > 0.99 and got[1] < 0.2
    one = search.GeneticSelector(k=2, population=8, generations=6, elite=2, seed=1).fit(folds, 4)
    two = search.GeneticSelector(k=2, population=8, generations=6, elite=2, seed=1).fit(folds, 4, spark)
    assert one.selected_ == two.selected_ == [1, 3] and one.history == two.history
    assert all(sum(bits) == 2 for _, _, bits, _ in one.population_log)


def test_exact_count_repair():
    rng = np.random.default_rng(0)
    bits = rng.random((50, 9)) < 0.4
    out = search.exactly(4, bits, rng.random((50, 9)))
    assert (out.sum(axis=1) == 4).all()
    few = bits.sum(axis=1) <= 4
    assert (out | ~bits)[few].all() and (bits | ~out)[~few].all()


def test_neighbours_with_a_missing_pivot(spark):
    rows = [(1, None, 1.0, 10.0), (2, 0.0, 1.0, None), (3, 5.0, 9.0, 99.0), (4, None, 50.0, None)]
    df = spark.createDataFrame(rows, "key long, a double, b double, c double")
    got = {r["key"]: r["value"] for r in knn_average(df, df, "key", ["a", "b"], ["c"], k=1, pivot="a").collect()}
    assert got == {2: 10.0, 4: 99.0}


def test_fill_without_a_complete_column(spark):
    rng = np.random.default_rng(11)
    rows = [(i, *(float(v) if rng.random() > 0.25 else None for v in rng.normal(size=3) * [10, 1, 3])) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, a double, b double, c double")
    got = np.array([[r["a"], r["b"], r["c"]] for r in knn_fill(df, "key", ["a", "b", "c"], k=5, per_bucket=8).orderBy("key").collect()])
    np.testing.assert_allclose(got, brute_fill(rows, 5), rtol=1e-9)


def test_same_keys_in_prediction(spark):
    train = spark.createDataFrame([(1, 0.0, 5.0), (2, 9.0, 7.0)], "key long, a double, y double")
    test = spark.createDataFrame([(1, 0.1, 0.0)], "key long, a double, y double")
    kw = dict(k=1, metric="euclidean", fill_only_missing=False)
    assert knn_average(test, train, "key", ["a"], ["y"], same_key=True, **kw).first()["value"] == 5.0
    assert knn_average(test, train, "key", ["a"], ["y"], **kw).first()["value"] == 7.0


def test_augment_of_an_empty_table(spark):
    df = spark.createDataFrame([], "key long, a double, y double")
    assert augment(df, "key", ["a"], "y").count() == 0
