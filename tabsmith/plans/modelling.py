"""Queries for augmentation, models, cross-validation and the feature search (I3-I5, J, K)."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import augment as aug
from ..operators import linear, models, search, split, suite
from ..operators.knn import knn_average
from ..operators.ordering import written
from ..operators.tree_search import TreeScorer
from ..sources import tables as tb
from .catalog import register, rounded, sql_rounded

PLANTED = tb.planted_sql()
#: A positive target: the noise rows of a target are clamped at 0.1 and more.
SHIFT = 10.0
PLANTED_POSITIVE = tb.planted_sql(shift=SHIFT)
FEATS = [f"f{i}" for i in range(tb.N_DIMS)]
TRIO = ["f3", "f17", "f40"]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def planted_folds(spark, sf_dir, k: int = 5, shift: float = 0.0):
    return split.kfold(tb.planted(spark, sf_dir, shift=shift), "vec_id", k, 42)


_TABLES: dict = {}


def _place(spark, sf_dir, name: str) -> tuple:
    return spark.sparkContext.applicationId, name, tuple(sorted(tb.table(spark, sf_dir, "embeddings").inputFiles()))


def once(spark, sf_dir, name: str, make):
    """A table of this application and these input files that several queries read: written by the first of them."""
    at = _place(spark, sf_dir, name)
    if at not in _TABLES:
        _TABLES[at] = written(make())
    return _TABLES[at]


def _fold_case(k: int = 5) -> str:
    whens = " ".join(f"WHEN rn_ <= {f + 1} * (rows_ // {k}) + least(rows_ % {k}, {f + 1}) THEN {f}" for f in range(k - 1))
    return f"(CASE {whens} ELSE {k - 1} END)::INTEGER"


def folds_sql(seed: int = 42, src: str = PLANTED) -> str:
    """planted with the 5 folds of a seed."""
    return f"""(SELECT t.* EXCLUDE (rn_, rows_), {_fold_case()} AS fold FROM (
      SELECT p.*, row_number() OVER (ORDER BY {split.split_sql('vec_id', seed, 'fold')}, vec_id) AS rn_, count(*) OVER () AS rows_ FROM {src} p) t)"""


def least_squares_sql(train: str, xs: list[str], y: str, by: str, alpha: float = 0.0) -> str:
    """``by``, b, w0, w1, w2: least squares on three columns (``alpha``: ridge) of each group by Cramer's rule."""
    n = len(xs)
    a = {(i, j): f"covar_pop({xs[i]}, {xs[j]}) * regr_count({xs[i]}, {y})" + (f" + {alpha}" if i == j and alpha else "") for i in range(n) for j in range(i, n)}
    cov = ", ".join([f"{v} AS a{i}{j}" for (i, j), v in a.items()] + [f"covar_pop({x}, {y}) * count(*) AS v{i}, avg({x}) AS m{i}" for i, x in enumerate(xs)])

    def det(m):
        return " + ".join(f"{m[0][i]} * ({m[1][(i + 1) % 3]} * {m[2][(i + 2) % 3]} - {m[1][(i + 2) % 3]} * {m[2][(i + 1) % 3]})" for i in range(3))

    whole = [[f"a{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    w = [f"({det([[f'v{i}' if j == c else whole[i][j] for j in range(3)] for i in range(3)])}) / ({det(whole)})" for c in range(3)]
    return f"""SELECT {by}, my - w0 * m0 - w1 * m1 - w2 * m2 AS b, w0, w1, w2 FROM (
      SELECT *, {', '.join(f'{e} AS w{c}' for c, e in enumerate(w))} FROM (SELECT {by}, avg({y}) AS my, {cov} FROM {train} GROUP BY {by}) s) z"""


PF = f"""(SELECT t.* EXCLUDE (rn_, rows_), {_fold_case()} AS fold FROM (
  SELECT p.*, row_number() OVER (ORDER BY {split.split_sql('vec_id', 42, 'fold')}, vec_id) AS rn_, count(*) OVER () AS rows_
  FROM {PLANTED} p) t)"""


# ---------------------------------------------------------------- K1
K1_SQL = sql_rounded(
    f"""SELECT fold, count(*)::BIGINT AS n, sum(y) AS sum_y, sum(y * y) AS sum_yy, sum(f3) AS sum_x, sum(f3 * f3) AS sum_xx,
      sum(f3 * y) AS sum_xy FROM {PF} x GROUP BY fold""",
    ["sum_y", "sum_yy", "sum_x", "sum_xx", "sum_xy"], ["fold", "n"])


@register("k1_fold_sums", K1_SQL)
def k1_fold_sums(spark, sf_dir):
    from ..operators.sums import gram

    g, c = gram(planted_folds(spark, sf_dir), ["f3", "y"], group="fold")
    rows = []
    for f, m in sorted(g.items()):
        n = m[0, 0]
        sx, sy = m[0, 1] + n * c[0], m[0, 2] + n * c[1]
        sxx = m[1, 1] + 2 * c[0] * m[0, 1] + n * c[0] ** 2
        syy = m[2, 2] + 2 * c[1] * m[0, 2] + n * c[1] ** 2
        sxy = m[1, 2] + c[0] * m[0, 2] + c[1] * m[0, 1] + n * c[0] * c[1]
        rows.append((int(f), int(n), float(sy), float(syy), float(sx), float(sxx), float(sxy)))
    return rounded(spark.createDataFrame(rows, "fold int, n long, sum_y double, sum_yy double, sum_x double, sum_xx double, sum_xy double"))


# ---------------------------------------------------------------- K9 / J2 / K13 (one-feature models, every feature)
def _univariate_sql(features) -> str:
    parts = []
    for f in features:
        parts.append(f"""SELECT '{f}' AS model, x.fold, x.y, c.a + c.b * x.{f} AS pred FROM {PF} x JOIN (
            SELECT g.fold, regr_intercept(t.y, t.{f}) AS a, regr_slope(t.y, t.{f}) AS b
            FROM (SELECT DISTINCT fold FROM {PF} z) g JOIN {PF} t ON t.fold <> g.fold GROUP BY g.fold) c ON c.fold = x.fold""")
    per = f"""SELECT model, fold, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - pred)) AS mae,
        sqrt(avg((y - pred) * (y - pred))) AS rmse FROM ({_union(parts)}) u GROUP BY model, fold"""
    return f"""SELECT model, avg(r2) AS mean_r2, stddev_pop(r2) AS std_r2, min(r2) AS min_r2, max(r2) AS max_r2,
        avg(mae) AS mean_mae, avg(rmse) AS mean_rmse FROM ({per}) p GROUP BY model"""


K9_COLS = ["mean_r2", "std_r2", "min_r2", "max_r2", "mean_mae", "mean_rmse"]


@register("k9_cv_univariate", sql_rounded(_univariate_sql(FEATS), K9_COLS, ["model"]))
def k9_cv_univariate(spark, sf_dir):
    return rounded(models.univariate_cv(planted_folds(spark, sf_dir), FEATS, "y"))


J2_SQL = sql_rounded(f"SELECT model, greatest(mean_r2, 0.0) AS fitness FROM ({_univariate_sql(TRIO)}) u", ["fitness"], ["model"])


@register("j2_fitness_single", J2_SQL)
def j2_fitness_single(spark, sf_dir):
    g = search.fold_grams(planted_folds(spark, sf_dir), TRIO, "y")
    rows = [(f, search.fitness(g, [i])) for i, f in enumerate(TRIO)]
    return rounded(spark.createDataFrame(rows, "model string, fitness double"))


def _k13_sql() -> str:
    body = f"""SELECT *, row_number() OVER (ORDER BY mean_r2 DESC, mean_mae ASC, model ASC) AS rank,
        CASE WHEN mean_r2 >= 0.9 THEN 'excellent' WHEN mean_r2 >= 0.8 THEN 'good' WHEN mean_r2 >= 0.6 THEN 'fair' ELSE 'poor' END AS level
        FROM ({_univariate_sql(FEATS)}) u WHERE mean_r2 IS NOT NULL AND NOT isnan(mean_r2)"""
    return sql_rounded(body, K9_COLS, ["model", "rank", "level"])


@register("k13_leaderboard", _k13_sql())
def k13_leaderboard(spark, sf_dir):
    res = models.univariate_cv(planted_folds(spark, sf_dir), FEATS, "y")
    return rounded(models.leaderboard(res).withColumn("rank", F.col("rank").cast("bigint")))


# ---------------------------------------------------------------- K8
K8_SQL = sql_rounded(
    f"""SELECT fold, 1 - sum((p - pred) * (p - pred)) / (var_pop(p) * count(*)) AS r2, avg(abs(p - pred)) AS mae,
      sqrt(avg((p - pred) * (p - pred))) AS rmse, count(*)::BIGINT AS n FROM (
      SELECT f.fold, x.p, s.a + s.b * x.o_totalprice AS pred FROM {tb.ORDER_FEATURES_SQL} x
      JOIN (SELECT o_orderkey, {_fold_case()} AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {split.split_sql('o_orderkey', 42, 'fold')}, o_orderkey) AS rn_,
            count(*) OVER () AS rows_ FROM orders) z) f ON f.o_orderkey = x.o_orderkey,
      (SELECT regr_intercept(p, o_totalprice) AS a, regr_slope(p, o_totalprice) AS b FROM {tb.ORDER_FEATURES_SQL} y) s
      WHERE x.p IS NOT NULL) u GROUP BY fold""",
    ["r2", "mae", "rmse"], ["fold", "n"])


@register("k8_regression_metrics", K8_SQL)
def k8_regression_metrics(spark, sf_dir):
    of = split.kfold(tb.order_features(spark, sf_dir), "o_orderkey", 5, 42)
    st = of.agg(F.regr_intercept("p", "o_totalprice").alias("a"), F.regr_slope("p", "o_totalprice").alias("b")).first()
    pred = of.withColumn("pred", F.lit(st["a"]) + F.lit(st["b"]) * F.col("o_totalprice"))
    return rounded(models.regression_metrics(pred, "p", "pred", by=["fold"]))


# ---------------------------------------------------------------- K6 (exact KNN regression)
def _k6_sql(k: int = 8) -> str:
    dist = " + ".join(f"abs(r.{c} - d.{c})" for c in TRIO)
    split_pf = f"""(SELECT t.* EXCLUDE (rn_, rows_), CASE WHEN rn_ <= ceil(0.2 * rows_) THEN 'test' ELSE 'train' END AS split FROM (
      SELECT p.*, row_number() OVER (ORDER BY {split.split_sql('vec_id', 42, 'split')}, vec_id) AS rn_, count(*) OVER () AS rows_
      FROM {PLANTED} p) t)"""
    return sql_rounded(f"""WITH s AS {split_pf}
      SELECT vec_id, y, avg(dy) AS pred FROM (
        SELECT r.vec_id, r.y, d.y AS dy, row_number() OVER (PARTITION BY r.vec_id ORDER BY {dist}, d.vec_id) AS rn
        FROM (SELECT * FROM s WHERE split = 'test') r, (SELECT * FROM s WHERE split = 'train') d) c
      WHERE rn <= {k} GROUP BY vec_id, y""", ["y", "pred"], ["vec_id"])


@register("k6_knn_regression", _k6_sql())
def k6_knn_regression(spark, sf_dir):
    p = split.train_test_split(tb.planted(spark, sf_dir), "vec_id", 0.2, 42)
    train, test = p.filter(F.col("split") == "train"), p.filter(F.col("split") == "test")
    got = knn_average(test, train, "vec_id", TRIO, ["y"], k=8, metric="manhattan", fill_only_missing=False)
    return rounded(test.select("vec_id", "y").join(got.select("vec_id", F.col("value").alias("pred")), "vec_id", "left"))


# ---------------------------------------------------------------- I3-I5 (augmentation) and E5
def _aug_sql(features, key="vec_id", src=PLANTED, target="y", factor=3, seed=42) -> str:
    stats = ", ".join(
        f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in features + [target]
    )

    def u(*parts):
        k = "concat_ws('|', " + ", ".join(parts) + ")"
        return f"((('0x' || substr(md5({k}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"

    def nrm(c):
        base = [f"'{seed}'", "CAST(r AS VARCHAR)", f"'{c}'", f"CAST({key} AS VARCHAR)"]
        return f"(sqrt(-2.0 * ln({u(*base, chr(39) + 'n1' + chr(39))})) * cos(2 * pi() * {u(*base, chr(39) + 'n2' + chr(39))}))"

    sel = []
    for c in features:
        inten = "(0.05 * (1 + r * 0.02))"
        rng = f"(hi_{c} - lo_{c})"
        unif = u(f"'{seed}'", "CAST(r AS VARCHAR)", f"'{c}'", "'u'", f"CAST({key} AS VARCHAR)")
        noise = f"(0.7 * {nrm(c)} * s_{c} * {inten} + 0.3 * (({unif} - 0.5) * {rng} * {inten}))"
        sel.append(f"least(greatest({c} + {noise}, lo_{c} - 0.2 * {rng}), hi_{c} + 0.2 * {rng}) AS {c}")
    t_noise = f"({nrm(target)} * s_{target} * (0.015 * (1 + r * 0.005)))"
    sel.append(f"least(greatest({target} + {t_noise}, greatest(0.8 * lo_{target}, 0.1)), hi_{target} + 0.05 * (hi_{target} - lo_{target})) AS {target}")
    noisy = f"""SELECT {key}, {', '.join(sel)}, r AS aug_round FROM {src} x, (SELECT {stats} FROM {src} z) s, range(0, {factor}) g(r)"""
    orig = f"SELECT {key}, {', '.join(f'{c}::DOUBLE AS {c}' for c in features + [target])}, -1 AS aug_round FROM {src} o"
    return f"{orig} UNION ALL {noisy}"


I3_SQL = sql_rounded(_aug_sql(TRIO, src=PLANTED_POSITIVE), TRIO + ["y"], ["vec_id", "aug_round"])


@register("i3_augment", I3_SQL)
def i3_augment(spark, sf_dir):
    p = tb.planted(spark, sf_dir, shift=SHIFT)
    out = aug.augment(p, "vec_id", TRIO, "y", factor=3, seed=42)
    return rounded(out.withColumn("aug_round", F.col("aug_round").cast("int")))


E5_FEATS = FEATS[:12]


def _e5_sql() -> str:
    a = _aug_sql(E5_FEATS)
    parts = []
    for i, x in enumerate(E5_FEATS):
        for y_ in E5_FEATS[i + 1:]:
            parts.append(f"SELECT '{x}' AS feature_a, '{y_}' AS feature_b, (SELECT corr({x}, {y_}) FROM {PLANTED} o) AS r_original, corr({x}, {y_}) AS r_augmented FROM a")
    body = f"WITH a AS ({a}) SELECT *, r_augmented - r_original AS r_change FROM ({_union(parts)}) u"
    return sql_rounded(body, ["r_original", "r_augmented", "r_change"], ["feature_a", "feature_b"])


@register("e5_correlation_change", _e5_sql())
def e5_correlation_change(spark, sf_dir):
    from ..operators import correlate

    p = tb.planted(spark, sf_dir)
    a = aug.augment(p, "vec_id", E5_FEATS, "y", factor=3, seed=42)
    return rounded(correlate.correlation_change(correlate.correlation_long(p, E5_FEATS), correlate.correlation_long(a, E5_FEATS)))


def _b11_sql() -> str:
    parts = []
    for c in [*FEATS, "y"]:
        mean, std = (5, 15) if c == "y" else (10, 20)
        parts.append(f"""SELECT '{c}' AS "column", abs(a.m_{c} - o.m_{c}) / abs(o.m_{c}) * 100 AS mean_shift_pct, abs(a.s_{c} - o.s_{c}) / abs(o.s_{c}) * 100 AS std_shift_pct,
            abs(a.m_{c} - o.m_{c}) / abs(o.m_{c}) * 100 < {mean} AND abs(a.s_{c} - o.s_{c}) / abs(o.s_{c}) * 100 < {std} AS ok FROM a, o""")
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in [*FEATS, "y"])
    body = f"WITH a AS (SELECT {stats} FROM ({_aug_sql(FEATS, src=PLANTED_POSITIVE)}) x), o AS (SELECT {stats} FROM {PLANTED_POSITIVE} p) {_union(parts)}"
    return sql_rounded(body, ["mean_shift_pct", "std_shift_pct"], ["column", "ok"], 4)


@register("b11_augmentation_check", _b11_sql())
def b11_augmentation_check(spark, sf_dir):
    p = tb.planted(spark, sf_dir, shift=SHIFT)
    a = aug.augment(p, "vec_id", FEATS, "y", factor=3, seed=42)
    return rounded(aug.augmentation_check(p, a, FEATS, "y"), 4)


# ---------------------------------------------------------------- J1 and the model suite (no SQL: iterative / tree learners)
@register("j1_genetic_search")
def j1_genetic_search(spark, sf_dir):
    g = search.fold_grams(planted_folds(spark, sf_dir), FEATS, "y")
    sel = search.GeneticSelector(k=3, seed=42).fit(g, len(FEATS), spark)
    rows = [(int(i), FEATS[i], r + 1, float(sel.best_fitness_)) for r, i in enumerate(sel.selected_)]
    return spark.createDataFrame(rows, "feature_index int, feature_name string, rank int, best_fitness double")


@register("j1_genetic_search_trees")
def j1_genetic_search_trees(spark, sf_dir):
    """The search with boosted trees as its model; every column is a candidate."""
    scorer = TreeScorer(planted_folds(spark, sf_dir), FEATS, "y")
    sel = search.GeneticSelector(k=3, seed=42).search(scorer, len(FEATS))
    rows = [(int(i), FEATS[i], r + 1, float(sel.best_fitness_)) for r, i in enumerate(sel.selected_)]
    return spark.createDataFrame(rows, "feature_index int, feature_name string, rank int, best_fitness double")


@register("j2_fitness_trees")
def j2_fitness_trees(spark, sf_dir):
    """Tree fitness of every single column and of all columns together."""
    members = np.concatenate([np.eye(len(FEATS), dtype=bool), np.ones((1, len(FEATS)), dtype=bool)])
    got = TreeScorer(planted_folds(spark, sf_dir), FEATS, "y")(members)
    return rounded(spark.createDataFrame(list(zip([*FEATS, "all"], got)), "model string, fitness double"))


@register("j8_generation_stats")
def j8_generation_stats(spark, sf_dir):
    g = search.fold_grams(planted_folds(spark, sf_dir), FEATS, "y")
    sel = search.GeneticSelector(k=3, seed=42).fit(g, len(FEATS), spark)
    return search.generation_stats(sel.population_df(spark))


def chosen(spark, sf_dir, k: int = 3) -> list[str]:
    """Names of the k columns that the genetic search selects; the search runs once, on the executors."""

    def search_columns():
        folds = search.fold_grams(planted_folds(spark, sf_dir), FEATS, "y")
        found = search.GeneticSelector(k=k, seed=42).fit(folds, len(FEATS), spark).selected_
        return spark.createDataFrame([(r, FEATS[i]) for r, i in enumerate(found)], "rank int, feature_name string")

    return [r["feature_name"] for r in once(spark, sf_dir, f"chosen {k}", search_columns).orderBy("rank").collect()]


@register("j3_feature_importance")
def j3_feature_importance(spark, sf_dir):
    return models.feature_importance(tb.planted(spark, sf_dir), FEATS, "y", num_trees=100)


@register("k18_top_importances")
def k18_top_importances(spark, sf_dir):
    return models.top_importances(models.feature_importance(tb.planted(spark, sf_dir), FEATS, "y", num_trees=100), 5)


def _j9_sql(runs: int = 10) -> str:
    tagged = " UNION ALL ".join(f"SELECT {r} * 5 + fold AS g, {r} AS run, fold, y, {', '.join(TRIO)} FROM {folds_sql(42 + r)} f{r}" for r in range(runs))
    fits = least_squares_sql("(SELECT h.g, t.* EXCLUDE (g) FROM (SELECT DISTINCT g, run, fold FROM t) h JOIN t ON t.run = h.run AND t.fold <> h.fold)", TRIO, "y", "g")
    r2 = f"""SELECT t.g, 1 - sum((y - b - {' - '.join(f'w{i} * {c}' for i, c in enumerate(TRIO))}) ** 2) / (var_pop(y) * count(*)) AS r2
        FROM t JOIN ({fits}) c ON c.g = t.g GROUP BY t.g"""
    return sql_rounded(f"""WITH t AS MATERIALIZED ({tagged}) SELECT avg(r2) AS mean, stddev_pop(r2) AS std, min(r2) AS min, max(r2) AS max,
        stddev_pop(r2) / abs(avg(r2)) AS cv FROM ({r2}) s""", ["mean", "std", "min", "max", "cv"], [], 9)


@register("j9_stability", _j9_sql())
def j9_stability(spark, sf_dir):
    s = models.stability(tb.planted(spark, sf_dir), "vec_id", chosen(spark, sf_dir), "y", linear.LINEAR_SUITE[0], runs=10)
    return rounded(spark.createDataFrame([(s["mean"], s["std"], s["min"], s["max"], s["cv"])], "mean double, std double, min double, max double, cv double"), 9)


def _scores(spark, sf_dir, name: str, specs, selected: bool, augment_factor: int = 0):
    """Fold scores of a list of models on all columns or the selected ones; stored, so that a comparison reads what others made."""

    def make():
        folds = planted_folds(spark, sf_dir, shift=SHIFT if augment_factor else 0.0)
        return suite.fold_scores(specs, folds, "vec_id", chosen(spark, sf_dir) if selected else FEATS, "y", augment_factor=augment_factor)

    return once(spark, sf_dir, f"scores {name}", make)


def _training(spark, sf_dir, *kinds: str):
    """Fold scores of the training suite, or of its models of some kinds; kinds that no query has fitted yet are fitted side by side."""
    kinds = kinds or tuple(dict.fromkeys(s.kind for s in models.SUITE))
    new = [k for k in kinds if _place(spark, sf_dir, f"scores training {k}") not in _TABLES]
    if new:
        made = _scores(spark, sf_dir, f"training of {', '.join(new)}", [s for s in models.SUITE if s.kind in new], True)
        for k in new:
            _TABLES[_place(spark, sf_dir, f"scores training {k}")] = made.where(F.col("model").isin([s.name for s in models.SUITE if s.kind == k]))
    return functools.reduce(DataFrame.unionByName, [_TABLES[_place(spark, sf_dir, f"scores training {k}")] for k in kinds])


def _of_kind(kind: str):
    return lambda spark, sf_dir: suite.summarise(_training(spark, sf_dir, kind))


register("k2_linear_models")(_of_kind("linear"))
register("k3_random_forest_cv")(_of_kind("rf"))
register("k4_gradient_boosting_cv")(_of_kind("gbt"))
register("k5_decision_tree_cv")(_of_kind("dt"))
register("k6_neighbours_cv")(_of_kind("knn"))


@register("k2_linear_grid")
def k2_linear_grid(spark, sf_dir):
    return rounded(suite.summarise(_scores(spark, sf_dir, "linear grid", models.LINEAR_GRID, True)))


_LEAST_SQUARES = {s.name: s.linear.alpha for s in models.LINEAR_GRID if s.linear.method in ("ols", "ridge")}
_MEASURES = ["mean_r2", "std_r2", "min_r2", "max_r2", "mean_mae", "std_mae", "mean_rmse", "std_rmse"]


def _k2_sql() -> str:
    train = "(SELECT h.fold AS g, t.* FROM (SELECT DISTINCT fold FROM t) h JOIN t ON t.fold <> h.fold)"
    off = f"y - b - {' - '.join(f'w{i} * {c}' for i, c in enumerate(TRIO))}"
    per = _union([f"""SELECT '{name}' AS model, fold, 1 - sum(({off}) ** 2) / (var_pop(y) * count(*)) AS r2, avg(abs({off})) AS mae, sqrt(avg(({off}) ** 2)) AS rmse
        FROM t JOIN ({least_squares_sql(train, TRIO, 'y', 'g', alpha if 'Ridge' in name else 0.0)}) c ON c.g = t.fold GROUP BY fold""" for name, alpha in _LEAST_SQUARES.items()])
    return sql_rounded(f"""WITH t AS MATERIALIZED (SELECT * FROM {folds_sql()} f) SELECT model, avg(r2) AS mean_r2, stddev_pop(r2) AS std_r2, min(r2) AS min_r2, max(r2) AS max_r2,
        avg(mae) AS mean_mae, stddev_pop(mae) AS std_mae, avg(rmse) AS mean_rmse, stddev_pop(rmse) AS std_rmse FROM ({per}) p GROUP BY model""", _MEASURES, ["model"])


@register("k2_least_squares", _k2_sql())
def k2_least_squares(spark, sf_dir):
    """Linear and ridge regression of the grid on the selected columns."""
    grid = suite.summarise(_scores(spark, sf_dir, "linear grid", models.LINEAR_GRID, True))
    return rounded(grid.where(F.col("model").isin(list(_LEAST_SQUARES))).select("model", *_MEASURES))


@register("k3_nonlinear_grid")
def k3_nonlinear_grid(spark, sf_dir):
    """Neighbours and trees of several sizes."""
    return suite.summarise(_scores(spark, sf_dir, "nonlinear grid", models.NONLINEAR_GRID, True))


@register("k4_ensemble_grid")
def k4_ensemble_grid(spark, sf_dir):
    """Forests and boosting of several sizes."""
    return suite.summarise(_scores(spark, sf_dir, "ensemble grid", models.ENSEMBLE_GRID, True))


@register("k10_cv_augmented")
def k10_cv_augmented(spark, sf_dir):
    return suite.summarise(_scores(spark, sf_dir, "augmented", models.SUITE, True, augment_factor=3))


def compared(results):
    """Every model, best first; a failed one has no rank and shows its error."""
    ranked = models.leaderboard(results).select("model", F.col("rank").cast("long").alias("rank"), "level")
    return results.join(ranked, "model", "left").orderBy(F.asc_nulls_last("rank"), "model")


@register("k12_compare_models")
def k12_compare_models(spark, sf_dir):
    """Every model on clean and on augmented training folds."""
    plain, noisy = suite.summarise(_training(spark, sf_dir)), k10_cv_augmented(spark, sf_dir)
    return compared(plain).withColumn("augmented", F.lit(False)).unionByName(compared(noisy).withColumn("augmented", F.lit(True)))


def _validation(spark, sf_dir, label: str):
    """Fold R2 of every model of the validation suite on all columns (baseline) or the selected ones; a failed model has its error."""
    t = suite.summarise(_scores(spark, sf_dir, f"validation {label}", models.VALIDATION, label == "selected"))
    return t.select("model", F.lit(label).alias("features"), "mean_r2", "std_r2", "min_r2", "max_r2", "error")


@register("k14_baseline_all_features")
def k14_baseline_all_features(spark, sf_dir):
    return _validation(spark, sf_dir, "baseline")


@register("k15_selected_features")
def k15_selected_features(spark, sf_dir):
    """The selected columns' scores, with the best model (largest mean R2; ties to the smaller name) and the number of columns."""
    t = _validation(spark, sf_dir, "selected")
    best = t.where("mean_r2 IS NOT NULL AND NOT isnan(mean_r2)").agg(F.min_by("model", F.struct(-F.col("mean_r2"), "model"))).first()[0]
    named = t.withColumn("best_model", F.lit(best).cast("string"))
    return named.withColumn("is_best", F.col("model").eqNullSafe(F.col("best_model"))).withColumn("n_features", F.lit(len(chosen(spark, sf_dir))))


@register("k16_selection_comparison")
def k16_selection_comparison(spark, sf_dir):
    ok = "mean_r2 IS NOT NULL AND NOT isnan(mean_r2)"
    return models.compare_selection(_validation(spark, sf_dir, "baseline").where(ok), _validation(spark, sf_dir, "selected").where(ok))


@register("k11_final_fit")
def k11_final_fit(spark, sf_dir):
    """Every model: final fit on all rows augmented (seed 42+999), then a second CV with other folds (seed 42+1000)."""
    p = tb.planted(spark, sf_dir, shift=SHIFT)
    cols = chosen(spark, sf_dir)
    terms = suite.final_fits(models.SUITE, aug.augment(p, "vec_id", cols, "y", factor=3, seed=42 + 999), cols, "y")
    scores = suite.fold_scores(models.SUITE, split.kfold(p, "vec_id", 5, 42 + 1000), "vec_id", cols, "y", augment_factor=3, seed=42 + 999)
    for r in suite.summarise(scores).collect():
        for m in ("r2", "mae", "rmse"):
            terms[r["model"]] |= {f"final_cv_{m}": r[f"mean_{m}"], f"final_cv_{m}_std": r[f"std_{m}"]}
    return spark.createDataFrame([(model, term, value) for model, own in terms.items() for term, value in own.items()], "model string, term string, value double")


# J4-J7 on the events and embeddings tables: general operators with group and order columns
@register("j5_selection_pressure", sql_rounded(
    """SELECT event_type, CASE WHEN count(*) <= 1 THEN 0 WHEN avg(value) = 0 THEN CASE WHEN max(value) > 0 THEN 'inf'::DOUBLE ELSE 0 END
       ELSE max(value) / avg(value) END AS selection_pressure FROM events GROUP BY event_type""", ["selection_pressure"], ["event_type"]))
def j5_selection_pressure(spark, sf_dir):
    return rounded(search.selection_pressure(tb.table(spark, sf_dir, "events"), "value", by=["event_type"]))


def _j4_sql() -> str:
    return sql_rounded(f"""WITH b AS (SELECT label, vec_id, j, CAST(embedding[j] > 0 AS INT) AS bit FROM embeddings, range(1, {tb.N_DIMS + 1}) r(j)),
      c AS (SELECT label, j, sum(bit) AS cj FROM b GROUP BY label, j),
      n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
      SELECT n.label, n.n::BIGINT AS n, CASE WHEN n.n > 1 THEN sum(cj * (n.n - cj)) / (n.n * (n.n - 1) / 2.0) ELSE 0.0 END AS diversity
      FROM c JOIN n ON c.label = n.label GROUP BY n.label, n.n""", ["diversity"], ["label", "n"])


@register("j4_diversity", _j4_sql())
def j4_diversity(spark, sf_dir):
    e = tb.table(spark, sf_dir, "embeddings")
    bits = e.select("label", F.transform("embedding", lambda x: x > 0).alias("bits"))
    return rounded(search.diversity(bits, "bits", by=["label"]))


EV_ORDER = "ts, event_id"


def _events_ordered(spark, sf_dir):
    ev = tb.table(spark, sf_dir, "events")
    return ev.withColumn("_o", F.struct("ts", "event_id"))


@register("j6_convergence", sql_rounded(f"""WITH x AS (SELECT user_id, value, value - lag(value) OVER w AS step,
      row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {EV_ORDER}))
    SELECT user_id, CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(avg(step) FILTER (WHERE rn > n - greatest(n // 10, 1) + 1), 0) END AS recent_improvement,
      CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(value) FILTER (WHERE rn > n - greatest(n // 5, 1)) END AS recent_std,
      CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(sum((step > 0)::DOUBLE) / count(step), 0) END AS improvement_ratio FROM x GROUP BY user_id""",
    ["recent_improvement", "recent_std", "improvement_ratio"], ["user_id"]))
def j6_convergence(spark, sf_dir):
    return rounded(search.convergence_metrics(_events_ordered(spark, sf_dir), "value", "_o", by=["user_id"]))


@register("j7_trailing_variance", sql_rounded(f"""SELECT event_id, CASE WHEN count(value) OVER w >= 20 THEN var_pop(value) OVER w END AS trailing_var,
    coalesce(CASE WHEN count(value) OVER w >= 20 THEN var_pop(value) OVER w END < 1e-6, false) AS converged
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {EV_ORDER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    ["trailing_var"], ["event_id", "converged"]))
def j7_trailing_variance(spark, sf_dir):
    out = search.trailing_variance(_events_ordered(spark, sf_dir), "value", "_o", 20, by=["user_id"])
    return rounded(out.select("event_id", "trailing_var", "converged"))


@register("m4_rolling_mean", sql_rounded(f"""SELECT event_id, CASE WHEN count(value) OVER w >= 10 THEN avg(value) OVER w END AS rolling_mean
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {EV_ORDER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""", ["rolling_mean"], ["event_id"]))
def m4_rolling_mean(spark, sf_dir):
    out = search.rolling_mean(_events_ordered(spark, sf_dir), "value", "_o", 10, by=["user_id"])
    return rounded(out.select("event_id", "rolling_mean"))


@register("m5_step_change", sql_rounded(f"""SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY {EV_ORDER}) AS step FROM events""",
                                        ["step"], ["event_id"]))
def m5_step_change(spark, sf_dir):
    return rounded(search.step_changes(_events_ordered(spark, sf_dir), "value", "_o", by=["user_id"]).select("event_id", "step"))



@register("m4_moving_average", sql_rounded("""SELECT event_id, w AS "window", CASE WHEN w > 1 AND rn >= w THEN list_sum(seen[len(seen) - w + 1:]) / w END AS moving_average FROM (
    SELECT event_id, least(10, count(*) OVER (PARTITION BY user_id, event_type) // 4)::INTEGER AS w,
      row_number() OVER o AS rn, list(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS seen
    FROM events WINDOW o AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) x""", ["moving_average"], ["event_id", "window"]))
def m4_moving_average(spark, sf_dir):
    out = search.moving_average(_events_ordered(spark, sf_dir), "value", "_o", by=["user_id", "event_type"])
    return rounded(out.select("event_id", "window", "moving_average"))


@register("m5_step_change_all", sql_rounded(f"SELECT event_id, value - lag(value) OVER (ORDER BY {EV_ORDER}) AS step FROM events", ["step"], ["event_id"]))
def m5_step_change_all(spark, sf_dir):
    """One series without groups: the whole table, in runs."""
    return rounded(search.step_changes(_events_ordered(spark, sf_dir), "value", "_o").select("event_id", "step"))


@register("j7_trailing_variance_all", sql_rounded(f"""SELECT event_id, CASE WHEN count(value) OVER w >= 20 THEN var_pop(value) OVER w END AS trailing_var,
    coalesce(CASE WHEN count(value) OVER w >= 20 THEN var_pop(value) OVER w END < 1e-6, false) AS converged
    FROM events WINDOW w AS (ORDER BY {EV_ORDER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", ["trailing_var"], ["event_id", "converged"]))
def j7_trailing_variance_all(spark, sf_dir):
    out = search.trailing_variance(_events_ordered(spark, sf_dir), "value", "_o", 20)
    return rounded(out.select("event_id", "trailing_var", "converged"))
