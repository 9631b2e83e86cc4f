"""Folds of many seeds from one histogram search and their sums from one pass equal the ones made seed by seed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import linear, models, split
from tabsmith.operators.sums import gram, gram_runs
from tabsmith.sources import tables as tb

from .conftest import SF001


@pytest.mark.parametrize("n, k", [(0, 3), (1, 3), (2, 5), (57, 5), (500, 4)])
def test_folds_equal_those_of_each_seed(spark, n, k):
    df = spark.range(n).select((F.col("id") * 7).alias("id"), F.lit(1).alias("h"), F.lit(2).alias("run"))
    seeds = [42, 43, 7]
    got = {r["id"]: list(r["folds"]) for r in split.kfold_runs(df, "id", k, seeds).collect()}
    assert len(got) == n
    for i, s in enumerate(seeds):
        want = {r["id"]: r["fold"] for r in split.kfold(df, "id", k, s).collect()}
        assert {key: f[i] for key, f in got.items()} == want


def test_rows_with_one_hash_are_cut_by_key(spark, monkeypatch):
    monkeypatch.setattr(split, "keyed_hash", lambda key, seed, purpose: F.lit(1234567).cast("bigint"))
    df = spark.range(20)
    got = sorted((r["id"], list(r["folds"])) for r in split.kfold_runs(df, "id", 4, [1, 2]).collect())
    assert got == [(i, [i // 5] * 2) for i in range(20)]


def test_sums_of_all_runs_in_one_pass(spark):
    p = split.kfold_runs(tb.planted(spark, SF001), "vec_id", 5, [42, 43], "folds")
    p = p.withColumn("f3", F.when(F.col("vec_id") % 9 == 0, None).otherwise(F.col("f3")))
    cols = ["f3", "f17", "y"]
    got, centre = gram_runs(p.repartition(5), cols, "folds")
    for run in range(2):
        want, c = gram(p.withColumn("g", F.col("folds")[run]), cols, group="g")
        assert np.allclose(centre, c) and {g for r, g in got if r == run} == set(want)
        for g, m in want.items():
            np.testing.assert_allclose(got[run, g], m, rtol=1e-9, atol=1e-9)


def test_stability_equals_folds_run_one_by_one(spark):
    p, cols = tb.planted(spark, SF001), ["f3", "f17"]
    want = []
    for r in range(3):
        want += models.linear_cv(linear.LINEAR_SUITE[0], split.kfold(p, "vec_id", 5, 42 + r), cols, "y")
    got = models.stability(p, "vec_id", cols, "y", linear.LINEAR_SUITE[0], runs=3)
    assert np.allclose(got["scores"], want) and got["mean"] == pytest.approx(np.mean(want))
