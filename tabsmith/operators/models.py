"""Regression models, metrics and cross-validation.

* Linear models score every fold from per-fold Gram matrices (one pass).
* Tree models are ``pyspark.ml`` estimators; :mod:`suite` fits all models and
  folds side by side on one stored, fold-tagged table.
* KNN regression is the exact neighbour search of :mod:`knn`.

The reference's XGBoost models are re-aimed at ``GBTRegressor`` (no leaf
penalties), and kernel SVR is not built (no Spark counterpart).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.columns import clean, q
from ..functions.stats import r2_expr
from . import linear
from .ordering import row_numbers
from .sums import gram, gram_runs


@dataclass
class ModelSpec:
    name: str
    kind: str  # linear | rf | gbt | dt | knn
    params: dict = field(default_factory=dict)
    linear: linear.LinearSpec | None = None


# Fixed hyper-parameters of the reference's training suite (re-aimed at Spark ML).
SUITE = [
    ModelSpec("XGBoost", "gbt", dict(maxIter=45, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.9", minInstancesPerNode=3)),
    ModelSpec("Random Forest", "rf", dict(numTrees=30, maxDepth=5, featureSubsetStrategy="0.6", minInstancesPerNode=1)),
    ModelSpec("Gradient Boosting", "gbt", dict(maxIter=30, maxDepth=3, stepSize=0.2, subsamplingRate=0.6, minInstancesPerNode=10)),
    ModelSpec("Linear Regression", "linear", linear=linear.LINEAR_SUITE[0]),
    ModelSpec("Ridge Regression", "linear", linear=linear.LINEAR_SUITE[1]),
    ModelSpec("Lasso Regression", "linear", linear=linear.LINEAR_SUITE[2]),
    ModelSpec("ElasticNet", "linear", linear=linear.LINEAR_SUITE[3]),
    ModelSpec("Decision Tree", "dt", dict(maxDepth=4, minInstancesPerNode=6, featureSubsetStrategy="0.6")),
    ModelSpec("K-Nearest Neighbors", "knn", dict(k=8, metric="manhattan")),
]

# Fixed hyper-parameters of the reference's validation suite; the least rows of a split (5) become 2 rows in each part.
_VALIDATION_TREES = dict(maxDepth=3)
VALIDATION = [
    ModelSpec("Random Forest", "rf", dict(numTrees=30, **_VALIDATION_TREES)),
    ModelSpec("Linear Regression", "linear", linear=linear.LinearSpec("Linear Regression", "ols")),
    ModelSpec("Ridge Regression", "linear", linear=linear.LinearSpec("Ridge Regression", "ridge", alpha=1.0)),
    ModelSpec("Lasso Regression", "linear", linear=linear.LinearSpec("Lasso Regression", "lasso", alpha=0.1)),
    ModelSpec("ElasticNet", "linear", linear=linear.LinearSpec("ElasticNet", "elasticnet", alpha=0.1, l1_ratio=0.5)),
    ModelSpec("Decision Tree", "dt", dict(minInstancesPerNode=2, **_VALIDATION_TREES)),
    ModelSpec("KNN", "knn", dict(k=5, metric="euclidean")),
    ModelSpec("Gradient Boosting", "gbt", dict(maxIter=30, stepSize=0.1, **_VALIDATION_TREES)),
    ModelSpec("XGBoost", "gbt", dict(maxIter=30, stepSize=0.1, **_VALIDATION_TREES)),
]

# Fixed values of the reference's linear, neighbour, tree and ensemble grids.
LINEAR_GRID = [
    ModelSpec("Linear", "linear", linear=linear.LinearSpec("Linear", "ols")),
    *[ModelSpec(n, "linear", linear=linear.LinearSpec(n, "ridge", alpha=a)) for a in (0.1, 1.0, 10.0) for n in [f"Ridge_Alpha_{a}"]],
    *[ModelSpec(n, "linear", linear=linear.LinearSpec(n, "lasso", alpha=a)) for a in (0.01, 0.1, 1.0) for n in [f"Lasso_Alpha_{a}"]],
    *[ModelSpec(n, "linear", linear=linear.LinearSpec(n, "elasticnet", alpha=0.1, l1_ratio=r)) for r in (0.1, 0.5, 0.9) for n in [f"ElasticNet_L1_{r}"]],
]
NONLINEAR_GRID = [
    *[ModelSpec(f"KNN_{k}", "knn", dict(k=k, metric="euclidean")) for k in (3, 5, 7)],
    *[ModelSpec(f"Decision_Tree_Depth_{d}", "dt", dict(maxDepth=d, minInstancesPerNode=2)) for d in (3, 5, 10)],
]
ENSEMBLE_GRID = [
    ModelSpec("RF_Deep", "rf", dict(numTrees=100, maxDepth=10)),
    ModelSpec("RF_Wide", "rf", dict(numTrees=200, maxDepth=5)),
    ModelSpec("GB_Conservative", "gbt", dict(maxIter=50, maxDepth=3, stepSize=0.05)),
    ModelSpec("GB_Aggressive", "gbt", dict(maxIter=100, maxDepth=6, stepSize=0.2)),
]


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """K8: R2, MAE, RMSE and n per group (rows where both are present)."""
    yt, yp = clean(y), clean(pred)
    ok = yt.isNotNull() & yp.isNotNull()
    yt2, yp2 = F.when(ok, yt), F.when(ok, yp)
    aggs = [
        r2_expr(yt2, yp2).alias("r2"),
        F.avg(F.abs(yt2 - yp2)).alias("mae"),
        F.sqrt(F.avg((yt2 - yp2) ** 2)).alias("rmse"),
        F.count(yp2).alias("n"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _ml_estimator(spec: ModelSpec, seed: int = 42):
    p = dict(spec.params)
    common = dict(featuresCol="_features", labelCol="_y", predictionCol="pred")
    if spec.kind == "rf":
        # each row's node in each tree is kept from level to level: the same trees without a walk from the roots
        return RandomForestRegressor(seed=seed, cacheNodeIds=True, **common, **p)
    if spec.kind == "gbt":
        return GBTRegressor(seed=seed, **common, **p)
    if spec.kind == "dt":
        if "featureSubsetStrategy" in p:  # one tree that draws a share of the columns at each node
            return RandomForestRegressor(seed=seed, numTrees=1, bootstrap=False, subsamplingRate=1.0, **common, **p)
        return DecisionTreeRegressor(seed=seed, **common, **p)
    raise ValueError(spec.kind)


def _assemble(df: DataFrame, features: Sequence[str], target: str | None) -> DataFrame:
    cols = [clean(c).alias(f"_x{i}") for i, c in enumerate(features)]
    base = df.select("*", *cols, *([clean(target).alias("_y")] if target else []))
    return VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features))], outputCol="_features", handleInvalid="skip").transform(base)


def linear_cv(spec: linear.LinearSpec, df: DataFrame, features: Sequence[str], target: str, fold: str = "fold") -> list[float]:
    """K9 fast path: fold R2 of a linear model from one grouped Gram pass."""
    g, _ = gram(df, list(features) + [target], group=fold)
    return linear.cv_scores(g, list(range(1, len(features) + 1)), spec)


def final_terms(spec: ModelSpec, train: DataFrame, features: Sequence[str], target: str, seed: int = 42) -> dict[str, float]:
    """What the final fit holds: coefficients, importances, or the number of neighbours' rows."""
    features = list(features)
    if spec.kind == "linear":
        g, c = gram(train, features + [target])
        w, b = linear.fit(g[0], list(range(1, len(features) + 1)), spec.linear)
        return {f: float(x) for f, x in zip(features, w)} | {"intercept": float(c[-1] + b - np.dot(w, c[: len(features)]))}
    if spec.kind == "knn":
        return {"n_fit": float(train.count())}
    model = _ml_estimator(spec, seed).fit(_assemble(train, features, target))
    return {f"importance_{f}": float(x) for f, x in zip(features, model.featureImportances.toArray())}


def compare_models(specs: Sequence[ModelSpec], df: DataFrame, key: str, features: Sequence[str], target: str, fold: str = "fold",
                   augment_factor: int = 0, seed: int = 42) -> DataFrame:
    """One row per model: mean and std (ddof 0) of the fold metrics; a failed model has NaN and its error."""
    from . import suite

    return suite.summarise(suite.fold_scores(specs, df, key, features, target, fold, augment_factor, seed))


def leaderboard(results: DataFrame, r2: str = "mean_r2", mae: str = "mean_mae", cuts: Sequence[float] = bands.TRAIN_LEVELS) -> DataFrame:
    """Drop NaN scores, sort by R2 desc then MAE asc, rank and level; rank 1 is the best model."""
    ok = results.filter(F.col(r2).isNotNull() & ~F.isnan(r2))
    order = [-F.col(r2), F.col(mae), F.col("model")]
    ranked = row_numbers(ok, order, name="rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
    return ranked.withColumn("level", bands.level(F.col(r2), cuts))


def compare_selection(baseline: DataFrame, selected: DataFrame, score: str = "mean_r2") -> DataFrame:
    """Inner match on model; difference and percent of abs(baseline) (0 if baseline is 0)."""
    b = baseline.select("model", F.col(score).alias("baseline_r2"))
    s = selected.select("model", F.col(score).alias("selected_r2"))
    j = b.join(s, "model")
    imp = F.col("selected_r2") - F.col("baseline_r2")
    pct = F.coalesce(F.try_divide(imp * 100.0, F.abs(F.col("baseline_r2"))), F.lit(0.0))
    return j.select("model", "baseline_r2", "selected_r2", imp.alias("improvement"), pct.alias("improvement_pct")).orderBy(F.desc("improvement"))


def feature_importance(df: DataFrame, features: Sequence[str], target: str, num_trees: int = 100, seed: int = 42) -> DataFrame:
    """Random-forest importances, descending, rank 1..n."""
    model = RandomForestRegressor(featuresCol="_features", labelCol="_y", numTrees=num_trees, seed=seed).fit(_assemble(df, features, target))
    imp = model.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    out = df.sparkSession.createDataFrame(rows, "feature_name string, importance double")
    return row_numbers(out, [-F.col("importance"), F.col("feature_name")], name="rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def top_importances(importance: DataFrame, n: int = 5) -> DataFrame:
    """The n most important features."""
    return importance.orderBy(F.desc("importance"), "feature_name").limit(n)


def stability(df: DataFrame, key: str, features: Sequence[str], target: str, spec: linear.LinearSpec, runs: int = 10, k: int = 5, seed: int = 42) -> dict:
    """Fold R2 over ``runs`` reshuffled k-fold splits: one search for the cuts of all runs, one Gram pass by (run, fold)."""
    from .split import kfold_runs

    tagged = kfold_runs(df, key, k, [seed + r for r in range(runs)], "_folds")
    g, _ = gram_runs(tagged, list(features) + [target], "_folds")
    scores = []
    for r in range(runs):
        scores += linear.cv_scores({f: m for (run, f), m in g.items() if run == r}, list(range(1, len(features) + 1)), spec)
    a = np.asarray(scores)
    m = float(a.mean())
    return {"mean": m, "std": float(a.std()), "min": float(a.min()), "max": float(a.max()), "cv": float(a.std() / abs(m)) if m else float("inf"), "scores": scores}


def univariate_cv(df: DataFrame, features: Sequence[str], target: str, fold: str = "fold") -> DataFrame:
    """K9/K14 screening: CV of a one-feature least-squares model for every feature.

    Coefficients come from one grouped Gram pass (train = total - fold); the
    rows are then scored on the executors: the features are melted to
    (k, x), joined to the small broadcast coefficient table on (k, fold) and
    K8 runs grouped by (feature, fold).  Returns feature, mean/std/min/max
    R2 (std ddof 0), mean MAE and mean RMSE.
    """
    from ..functions.columns import name_of

    features = list(features)
    g, c = gram(df, features + [target], group=fold)
    total = sum(g.values())
    rows = []
    spec = linear.LINEAR_SUITE[0]
    for f, m in g.items():
        tr = total - m
        for i in range(len(features)):
            w, b = linear.fit(tr, [i + 1], spec)
            # back to raw coordinates: y = c_y + b + w (x - c_x)
            rows.append((i, int(f), float(c[-1] + b - w[0] * c[i]), float(w[0])))
    coef = df.sparkSession.createDataFrame(rows, "k int, _fold long, a double, b double")
    base = df.select(F.col(fold).cast("long").alias("_fold"), clean(target).alias("_y"),
                     *[clean(x).alias(f"_c{i}") for i, x in enumerate(features)])
    long = base.unpivot(["_fold", "_y"], [f"_c{i}" for i in range(len(features))], "kk", "v").select(
        "_fold", "_y", F.substring("kk", 3, 12).cast("int").alias("k"), "v")
    scored = long.join(F.broadcast(coef), ["k", "_fold"]).withColumn("pred", F.col("a") + F.col("b") * F.col("v"))
    per = regression_metrics(scored, "_y", "pred", by=["k", "_fold"])
    return per.groupBy("k").agg(
        F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"), F.min("r2").alias("min_r2"), F.max("r2").alias("max_r2"),
        F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"),
    ).select(name_of(features).alias("model"), "mean_r2", "std_r2", "min_r2", "max_r2", "mean_mae", "mean_rmse")
