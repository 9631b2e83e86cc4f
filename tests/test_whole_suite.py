"""The whole model suite, every learner fitted."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import augment, models, split, suite
from tabsmith.plans import modelling, scoring
from tabsmith.sources import tables as tb

SF = "/root/testdata/sf0.001"
NAMES = sorted(s.name for s in models.SUITE)


def by_model(df):
    return {r["model"]: r for r in df.collect()}


def good(rows, names):
    assert sorted(rows) == sorted(names)
    assert all(r["error"] is None and math.isfinite(r["mean_r2"]) and r["std_r2"] >= 0 and r["min_r2"] <= r["mean_r2"] <= r["max_r2"] for r in rows.values())


@pytest.fixture(scope="module")
def training(spark):
    return by_model(modelling.k12_compare_models(spark, SF).where("NOT augmented"))


def test_every_model_is_fitted(training):
    good(training, NAMES)
    assert training["Linear Regression"]["mean_r2"] > 0.99 and training["K-Nearest Neighbors"]["mean_r2"] > 0.8
    assert all(training[n]["mean_r2"] > 0.5 for n in NAMES if n not in ("Lasso Regression", "ElasticNet"))
    assert sorted(r["rank"] for r in training.values()) == list(range(1, len(NAMES) + 1))


def test_linear_scores_against_normal_equations(spark, training):
    cols = modelling.chosen(spark, SF)
    rows = np.array([list(r) for r in modelling.planted_folds(spark, SF).select("fold", "y", *cols).collect()])
    r2, mae = [], []
    for f in range(5):
        train, test = rows[rows[:, 0] != f], rows[rows[:, 0] == f]
        w = np.linalg.lstsq(np.c_[np.ones(len(train)), train[:, 2:]], train[:, 1], rcond=None)[0]
        e = test[:, 1] - np.c_[np.ones(len(test)), test[:, 2:]] @ w
        r2.append(1 - (e**2).sum() / ((test[:, 1] - test[:, 1].mean()) ** 2).sum())
        mae.append(np.abs(e).mean())
    got = training["Linear Regression"]
    np.testing.assert_allclose([got["mean_r2"], got["std_r2"], got["mean_mae"], got["std_mae"]], [np.mean(r2), np.std(r2), np.mean(mae), np.std(mae)], rtol=1e-8)


def test_noise_of_all_folds_at_once(spark):
    """Each training fold's rows are those of ``augment`` with its seed."""
    folds = split.kfold(tb.planted(spark, SF, shift=10.0), "vec_id", 3)
    cols = ["f3", "f17"]
    whole = suite.augment_folds(folds, "vec_id", cols, "y", factor=2, seed=7)
    for f in range(3):
        one = augment.augment(folds.where(F.col("fold") != f), "vec_id", cols, "y", factor=2, seed=7 + f)
        order = ["vec_id", "aug_round"]
        a = whole.where(F.col("train_fold") == f).select(*order, *cols, "y").orderBy(*order).toPandas()
        b = one.select(*order, *cols, "y").orderBy(*order).toPandas()
        assert len(a) == len(b) > 0
        np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-9)


def test_augmented_cv_of_every_model(spark):
    rows = by_model(modelling.k10_cv_augmented(spark, SF))
    good(rows, NAMES)
    assert rows["Linear Regression"]["mean_r2"] > 0.95 and rows["K-Nearest Neighbors"]["mean_r2"] > 0.8
    assert all(r["std_mae"] >= 0 and r["std_rmse"] >= 0 for r in rows.values())


def test_final_fit_has_six_numbers_of_every_model(spark):
    six = {f"final_cv_{m}{end}" for m in ("r2", "mae", "rmse") for end in ("", "_std")}
    got = {}
    for r in modelling.k11_final_fit(spark, SF).collect():
        got.setdefault(r["model"], {})[r["term"]] = r["value"]
    assert sorted(got) == NAMES and all(six < set(terms) and all(map(math.isfinite, terms.values())) for terms in got.values())
    assert got["Linear Regression"]["final_cv_r2"] > 0.95


def test_selection_comparison_reads_both_results(spark):
    base, chosen = by_model(modelling.k14_baseline_all_features(spark, SF)), by_model(modelling.k15_selected_features(spark, SF))
    names = [s.name for s in models.VALIDATION]
    good(base, names)
    good(chosen, names)
    best = max(chosen, key=lambda m: chosen[m]["mean_r2"])
    assert [m for m, r in chosen.items() if r["is_best"]] == [best] == [chosen[best]["best_model"]] and chosen[best]["n_features"] == 3
    for m, r in by_model(modelling.k16_selection_comparison(spark, SF)).items():
        assert r["baseline_r2"] == base[m]["mean_r2"] and r["selected_r2"] == chosen[m]["mean_r2"]
        assert math.isclose(r["improvement_pct"], 100 * (r["selected_r2"] - r["baseline_r2"]) / abs(r["baseline_r2"]))


def test_a_failed_model_stays_in_the_comparison(spark):
    folds = split.kfold(tb.planted(spark, SF), "vec_id", 3)
    bad = models.ModelSpec("Bad", "rf", dict(maxDepth=99))
    rows = by_model(modelling.compared(models.compare_models([bad, models.SUITE[3]], folds, "vec_id", ["f3"], "y")))
    assert math.isnan(rows["Bad"]["mean_r2"]) and rows["Bad"]["error"] and rows["Bad"]["rank"] is None and rows["Linear Regression"]["rank"] == 1


def test_grids(spark):
    good(by_model(modelling.k2_linear_grid(spark, SF)), [s.name for s in models.LINEAR_GRID])
    good(by_model(modelling.k3_nonlinear_grid(spark, SF)), [s.name for s in models.NONLINEAR_GRID])


def test_strategies_of_every_gap_column(spark):
    rows = scoring.f7_apply_strategy(spark, SF).collect()
    assert sorted(r["feature"] for r in rows) == ["d", "n", "p", "q", "t"] and all(r["missing_after"] == 0 for r in rows)
