"""Windows over runs of rows: equal to plain windows where one key has a third of the rows, in short runs, without groups."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabsmith.operators import chartdata, models, search
from tabsmith.operators.ordering import chunked


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if i % 3 == 0 else [None, f"u{rng.integers(40)}"][int(rng.random() > 0.1)], float(rng.integers(50)), None if rng.random() < 0.1 else float(rng.normal())) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, key string, t double, v double").withColumn("o", F.struct("t", "id")).repartition(7)


def same(a, b, cols):
    x, y = (sorted(([r[c] for c in ("id", *cols)] for r in df.collect())) for df in (a, b))
    assert len(x) == len(y)
    for p, q in zip(x, y):
        assert p[0] == q[0] and all((u is None) == (v is None) and (u is None or abs(u - v) < 1e-9) for u, v in zip(p[1:], q[1:])), (p, q)


@pytest.mark.parametrize("by", [["key"], []])
@pytest.mark.parametrize("run", [7, 64, 10**6])
def test_against_plain_windows(events, by, run):
    w = Window.partitionBy(*by).orderBy("o")
    same(search.step_changes(events, "v", "o", by, run), events.withColumn("step", F.col("v") - F.lag("v").over(w)), ["step"])
    frame = w.rowsBetween(-4, 0)
    full = F.count("v").over(frame) >= 5
    same(search.rolling_mean(events, "v", "o", 5, by, run), events.withColumn("rolling_mean", F.when(full, F.avg("v").over(frame))), ["rolling_mean"])
    got = search.trailing_variance(events, "v", "o", 5, by, 0.5, run)
    want = events.withColumn("trailing_var", F.when(full, F.var_pop("v").over(frame)))
    same(got, want, ["trailing_var"])
    assert got.where("converged <> coalesce(trailing_var < 0.5, false)").count() == 0


@pytest.mark.parametrize("run", [9, 10**6])
def test_convergence_of_a_hot_key(events, run):
    got = {r["key"]: r for r in search.convergence_metrics(events.fillna(0.0, ["v"]), "v", "o", ["key"], run).collect()}
    by = {}
    for r in events.fillna(0.0, ["v"]).orderBy("o").collect():
        by.setdefault(r["key"], []).append(r["v"])
    assert set(got) == set(by)
    for key, v in by.items():
        v, n = np.array(v), len(v)
        steps, last = np.diff(v), np.diff(v[-max(1, n // 10):])
        want = (0.0, 0.0, 0.0) if n < 2 else (last.mean() if len(last) else 0.0, v[-max(1, n // 5):].std(), (steps > 0).mean())
        np.testing.assert_allclose([got[key][c] for c in ("recent_improvement", "recent_std", "improvement_ratio")], want, atol=1e-9)


def test_moving_average_has_the_series_window(events):
    import pandas as pd

    got = {r["id"]: (r["window"], r["moving_average"]) for r in search.moving_average(events, "v", "o", ["key"], 16).collect()}
    by = {}
    for r in events.orderBy("o").collect():
        by.setdefault(r["key"], []).append((r["id"], r["v"]))
    for rows in by.values():
        n = min(10, len(rows) // 4)
        means = pd.Series([v for _, v in rows], dtype=float).rolling(n).mean() if n > 1 else [np.nan] * len(rows)
        for (i, _), m in zip(rows, means):
            assert got[i][0] == n and (got[i][1] is None if np.isnan(m) else abs(got[i][1] - m) < 1e-9)


def test_no_task_holds_a_group(spark, events):
    rows, w, own = chunked(events, "o", ["key"], 4, 100)
    assert rows.groupBy("key", "__run").count().agg(F.max("count")).first()[0] <= 104
    assert rows.where(own).count() == events.count()
    empty = search.rolling_mean(events.limit(0), "v", "o", 3, ["key"])
    assert empty.count() == 0 and empty.columns == [*events.columns, "rolling_mean"]


def test_rank_and_normalisation_without_one_partition(spark):
    df = spark.createDataFrame([("a", 0.5, 1.0, 2.0), ("b", 0.9, 2.0, 1.0), ("c", float("nan"), 1.0, 1.0), ("d", 0.9, 1.0, 3.0)], "model string, mean_r2 double, mean_mae double, x double")
    out = models.leaderboard(df)
    assert [(r["model"], r["rank"]) for r in out.orderBy("rank").collect()] == [("d", 1), ("b", 2), ("a", 3)]
    norm = chartdata.normalise_metrics(df.where("model <> 'c'"), ["mean_r2"], ["mean_mae"])
    for frame in (out, norm):
        assert "SinglePartition" not in frame._jdf.queryExecution().executedPlan().toString()
    got = {r["model"]: (r["mean_r2_norm"], r["mean_mae_norm"]) for r in norm.collect()}
    assert got == {"a": (0.0, 1.0), "b": (1.0, 0.0), "d": (1.0, 1.0)}
    by = chartdata.normalise_metrics(df, ["x"], [], by=["mean_mae"])
    assert {r["model"]: r["x_norm"] for r in by.collect()} == {"a": 0.5, "b": 0.5, "c": 0.0, "d": 1.0}


def test_overlap_is_zero_beyond_the_columns(spark):
    imp = spark.createDataFrame([(f"f{i}", i + 1) for i in range(12)], "feature_name string, rank int")
    sel = spark.createDataFrame([("f0",), ("f7",), ("f11",)], "feature_name string")
    assert [tuple(r) for r in chartdata.importance_overlap(imp, sel).collect()] == [(5, 1, 100 / 3), (10, 2, 200 / 3), (15, 3, 0.0), (20, 3, 0.0)]
