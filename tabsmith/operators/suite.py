"""Cross-validation of many models at once.

The input is written once as a narrow fold-tagged table, and every fit reads it.
Linear models of all folds come from one grouped sum of cross products; every
other (model, fold) is a task of its own, and a pool of ``WIDTH`` driver threads
keeps that many fits running on the cluster.  A fit is a Spark ML job sequence, so
its data stay on the executors; what a task brings back is one row of metrics.

With augmentation every training fold gets noisy copies of its own rows
(``augment_folds``): one pass over the data makes the rows of all training folds,
with the statistics of each fold from a broadcast table of one row a fold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean, q
from ..functions.randomness import normal, uniform
from . import linear
from .augment import FACTOR, FEATURE_GROWTH, FEATURE_INTENSITY, TARGET_GROWTH, TARGET_INTENSITY
from .knn import nearest
from .models import ModelSpec, _assemble, _ml_estimator, regression_metrics
from .ordering import written
from .sums import gram

#: Fits that run at a time.
WIDTH = 8
#: Rows of a piece of the stored table: an input of few files is dealt anew from two pieces on.
PIECE_ROWS = 32768
#: Values of the features in a piece of the training rows of a tree fit, about; smaller pieces are read together.
TREE_CELLS = 1 << 17

_SCORES = "model string, fold int, r2 double, mae double, rmse double, error string"
_SUMMARY = ("mean_r2", "std_r2", "min_r2", "max_r2", "mean_mae", "std_mae", "mean_rmse", "std_rmse")


def run_bounded(spark, tasks: Sequence[Callable], width: int = WIDTH) -> list:
    """Results of the tasks, in order; ``width`` of them run at a time."""
    if not tasks:
        return []
    run = inheritable_thread_target(spark)(lambda t: t())
    with ThreadPool(min(width, len(tasks))) as pool:
        return pool.map(run, tasks, chunksize=1)


def augment_folds(df: DataFrame, key: str, features: Sequence[str], target: str, fold: str = "fold", factor: int = FACTOR, seed: int = 42) -> DataFrame:
    """train_fold, key, aug_round, features and target: for each fold the other folds' rows (round -1) and their noisy copies.

    The rows of a training fold are those that ``augment`` gives for it with the
    seed ``seed + fold``.  A row is made once for each training fold it belongs
    to; the statistics of a training fold are aggregated over just its rows.
    """
    cols = [*features, target]
    folds = [r[0] for r in df.select(F.col(fold).cast("int")).distinct().orderBy(fold).collect()]
    base = df.select(q(key), F.col(fold).cast("int").alias("_fold"), *[clean(c).alias(c) for c in cols])
    each = base.withColumn("train_fold", F.explode(F.array(*[F.lit(f) for f in folds]))).where("train_fold <> _fold").drop("_fold")
    measures = [f(F.col(q_)).alias(f"{n}_{i}") for i, c in enumerate(cols) for q_ in [f"`{c}`"] for n, f in (("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]
    stats = each.groupBy("train_fold").agg(*measures)  # a row for each fold
    rounds = each.join(F.broadcast(stats), "train_fold").withColumn("aug_round", F.explode(F.sequence(F.lit(-1), F.lit(factor - 1))))
    rnd, first, own_seed = F.col("aug_round"), F.col("aug_round") < 0, F.lit(seed) + F.col("train_fold")
    out = []
    for i, c in enumerate(features):
        lo, hi, std = F.col(f"lo_{i}"), F.col(f"hi_{i}"), F.coalesce(f"s_{i}", F.lit(0.0))
        span, strength = hi - lo, F.lit(FEATURE_INTENSITY) * (1 + rnd * FEATURE_GROWTH)
        noise = 0.7 * normal(own_seed, rnd, c, q(key)) * std * strength + 0.3 * ((uniform(own_seed, rnd, c, "u", q(key)) - 0.5) * span * strength)
        out.append(F.when(first, q(c)).otherwise(F.least(F.greatest(q(c) + noise, lo - 0.2 * span), hi + 0.2 * span)).alias(c))
    t = len(features)
    lo, hi, std = F.col(f"lo_{t}"), F.col(f"hi_{t}"), F.coalesce(f"s_{t}", F.lit(0.0))
    noise = normal(own_seed, rnd, target, q(key)) * std * (F.lit(TARGET_INTENSITY) * (1 + rnd * TARGET_GROWTH))
    noisy = F.least(F.greatest(q(target) + noise, F.greatest(0.8 * lo, F.lit(0.1))), hi + 0.05 * (hi - lo))
    out.append(F.when(first, q(target)).otherwise(noisy).alias(target))
    kept = rounds.where(first | lo.isNotNull())  # no target value, so no noisy rows
    return kept.select("train_fold", q(key), "aug_round", *out)


def _linear_scores(specs: Sequence[ModelSpec], table: DataFrame, trains: DataFrame | None, features: Sequence[str], target: str) -> list[tuple]:
    """Fold metrics of all linear models: one grouped sum, one scoring pass."""
    p, idx = len(features), list(range(1, len(features) + 1))
    if trains is None:
        g, c = gram(table, [*features, target], group="fold")
        total = sum(g.values())
        sums = {f: total - m for f, m in g.items()}
    else:
        sums, c = gram(trains, [*features, target], group="train_fold")
    rows = []
    for f, m in sums.items():
        for s in specs:
            w, b = linear.fit(m, idx, s.linear)
            rows.append((s.name, int(f), float(c[-1] + b - sum(x * y for x, y in zip(w, c[:p]))), [float(x) for x in w]))
    coef = table.sparkSession.createDataFrame(rows, "model string, fold int, _b double, _w array<double>")
    x = table.select(F.col("fold").cast("int").alias("fold"), q(target).alias("_y"), F.array(*[q(c) for c in features]).alias("_x"))
    pred = F.col("_b") + F.aggregate(F.zip_with("_w", "_x", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    per = regression_metrics(x.join(F.broadcast(coef), "fold").withColumn("pred", pred), "_y", "pred", by=["model", "fold"])
    return [(r["model"], r["fold"], r["r2"], r["mae"], r["rmse"], None) for r in per.collect()]


def _neighbour_scores(specs: Sequence[ModelSpec], train: DataFrame, test: DataFrame, key: str, features: Sequence[str], target: str) -> list:
    """Metrics of neighbour models with one metric on one fold: one search for the largest k, of which each model takes its own."""
    train = train.withColumn("_donor", F.concat_ws("#", q(key).cast("string"), F.col("aug_round").cast("string"))) if "aug_round" in train.columns else train.withColumn("_donor", q(key).cast("string"))
    k = [s.params.get("k", 5) for s in specs]
    near = nearest(test.withColumn("_donor", q(key).cast("string")), train, "_donor", features, [target], k=max(k),
                   metric=specs[0].params.get("metric", "euclidean"), fill_only_missing=False, same_key=True)
    place = F.row_number().over(Window.partitionBy("r_key").orderBy("dist", "d_key"))
    got = near.withColumn("_place", place).groupBy("r_key").agg(*[F.avg(F.when(F.col("_place") <= n, F.col("value"))).alias(f"_pred_{i}") for i, n in enumerate(k)])
    preds = test.select(q(key).cast("string").alias("r_key"), q(target).alias("y")).join(got, "r_key", "left")
    each = F.explode(F.array(*[F.struct(F.lit(s.name).alias("model"), F.col(f"_pred_{i}").alias("pred")) for i, s in enumerate(specs)]))
    rows = {r["model"]: r for r in regression_metrics(preds.select("y", each.alias("_m")).select("y", "_m.*"), by=["model"]).collect()}  # a row for each model
    return [rows.get(s.name, dict.fromkeys(("r2", "mae", "rmse"))) for s in specs]


def _fold_scores(spec: ModelSpec, train: DataFrame, test: DataFrame, features: Sequence[str], target: str, seed: int):
    """Metrics of one model on one fold."""
    model = _ml_estimator(spec, seed).fit(_assemble(train, features, target))
    preds = model.transform(_assemble(test, features, target)).select(F.col("_y").alias("y"), "pred")
    return regression_metrics(preds).first()


def _dealt(table: DataFrame, key: str) -> DataFrame:
    """A stored table in pieces of about ``PIECE_ROWS`` rows, if it has fewer."""
    pieces = table.count() // PIECE_ROWS
    return written(table.repartition(pieces, q(key))) if pieces > table.rdd.getNumPartitions() else table


def _merged(table: DataFrame, features: Sequence[str], fits: int = 1) -> DataFrame:
    """A stored table that ``fits`` fits share, with its small pieces read together.

    Boosting runs a job for each level of each tree, so tasks of a few thousand rows would mostly start and end.
    """
    pieces = table.rdd.getNumPartitions()
    group = pieces // max(1, table.count() * len(features) // (TREE_CELLS * fits))
    return table.coalesce(-(-pieces // group)) if group > 1 else table


def _work(spec: ModelSpec) -> tuple:
    """Sort key: boosting first, as its trees follow one another, and of each kind the fits of most trees and levels."""
    p = spec.params
    return spec.kind != "gbt", -p.get("maxIter", p.get("numTrees", 1)) * p.get("maxDepth", 5)


def fold_scores(specs: Sequence[ModelSpec], df: DataFrame, key: str, features: Sequence[str], target: str, fold: str = "fold",
                augment_factor: int = 0, seed: int = 42, width: int = WIDTH) -> DataFrame:
    """model, fold, r2, mae, rmse, error: a row for each model and fold; a model that fails in a fold has its error there."""
    features = list(features)
    spark = df.sparkSession
    table = _dealt(written(df.select(q(key), F.col(fold).cast("int").alias("fold"), *[clean(c).alias(c) for c in [*features, target]])), key)
    folds = [r[0] for r in table.select("fold").distinct().orderBy("fold").collect()]
    trains = written(augment_folds(table, key, features, target, "fold", augment_factor, seed)) if augment_factor else None
    if any(s.kind not in ("linear", "knn") for s in specs):
        tree_rows, tree_trains = _merged(table, features), None if trains is None else _merged(trains, features, len(folds))

    def one(own: Sequence[ModelSpec], f: int):
        def run() -> list[tuple]:
            rows, noisy = (table, trains) if own[0].kind == "knn" else (tree_rows, tree_trains)
            train = rows.where(F.col("fold") != f) if noisy is None else noisy.where(F.col("train_fold") == f)
            test = rows.where(F.col("fold") == f)
            try:
                found = _neighbour_scores(own, train, test, key, features, target) if own[0].kind == "knn" else [_fold_scores(own[0], train, test, features, target, seed)]
                return [(s.name, f, r["r2"], r["mae"], r["rmse"], None) for s, r in zip(own, found)]
            except Exception as e:  # noqa: BLE001 - a model that fails is a row of the result, as the comparison must show it
                return [(s.name, f, None, None, None, f"{type(e).__name__}: {e}"[:500]) for s in own]

        return run

    # neighbour models with one metric share a search
    fits: dict = {}
    for i, s in enumerate(sorted(specs, key=_work)):
        if s.kind != "linear":
            fits.setdefault(s.params.get("metric", "euclidean") if s.kind == "knn" else i, []).append(s)
    slow = [one(own, f) for own in fits.values() for f in folds]
    straight = [s for s in specs if s.kind == "linear"]
    tasks = [*slow, *([lambda: _linear_scores(straight, table, trains, features, target)] if straight else [])]
    rows = [row for part in run_bounded(spark, tasks, width) for row in part]
    return spark.createDataFrame(rows, _SCORES)


def summarise(scores: DataFrame) -> DataFrame:
    """Mean and std (ddof 0) of the fold metrics of each model; a model with a failed fold has NaN and its error."""
    failed = F.max("error").isNotNull()
    value = {
        "mean_r2": F.avg("r2"), "std_r2": F.stddev_pop("r2"), "min_r2": F.min("r2"), "max_r2": F.max("r2"),
        "mean_mae": F.avg("mae"), "std_mae": F.stddev_pop("mae"), "mean_rmse": F.avg("rmse"), "std_rmse": F.stddev_pop("rmse"),
    }
    return scores.groupBy("model").agg(*[F.when(failed, F.lit(float("nan"))).otherwise(value[c]).alias(c) for c in _SUMMARY], F.max("error").alias("error"))


def final_fits(specs: Sequence[ModelSpec], full: DataFrame, features: Sequence[str], target: str, seed: int = 42, width: int = WIDTH) -> dict[str, dict[str, float]]:
    """Of each model fitted to all rows: coefficients, importances, or the number of neighbours' rows."""
    from .models import final_terms

    full = written(full)
    return dict(zip([s.name for s in specs], run_bounded(full.sparkSession, [lambda s=s: final_terms(s, full, features, target, seed) for s in specs], width)))

