"""The tree scorer of the feature search: brute force, planted columns, partitioning and edge rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from tabsmith.operators import search, split
from tabsmith.operators.tree_search import TreeScorer, TreeSpec, bin_edges
from tabsmith.sources import tables as tb

from .conftest import SF001


def _grow(x, y, depth, least):
    """Plain recursive tree on bins: a function from a row of bins to its value."""
    whole = y.sum() ** 2 / len(y)
    best = (0.0, None, None)
    for j in range(x.shape[1]):
        for b in range(int(x[:, j].max()) + 1):
            low = x[:, j] <= b
            n1 = int(low.sum())
            if least <= n1 <= len(y) - least:
                gain = y[low].sum() ** 2 / n1 + y[~low].sum() ** 2 / (len(y) - n1) - whole
                if gain > best[0] + 1e-9:
                    best = (gain, j, b)
    if depth == 0 or best[1] is None:
        mean = y.mean()
        return lambda row: mean
    _, j, b = best
    low = x[:, j] <= b
    one, two = _grow(x[low], y[low], depth - 1, least), _grow(x[~low], y[~low], depth - 1, least)
    return lambda row: one(row) if row[j] <= b else two(row)


def _brute(x, y, fold, spec):
    out = []
    for f in sorted(set(fold)):
        tr, te = fold != f, fold == f
        trees, left = [], y[tr].copy()
        for _ in range(spec.rounds):
            tree = _grow(x[tr], left, spec.depth, spec.min_rows)
            trees.append(tree)
            left = left - spec.rate * np.array([tree(r) for r in x[tr]])
        err = y[te] - spec.rate * np.array([sum(t(r) for t in trees) for r in x[te]])
        out.append(1 - (err**2).sum() / ((y[te] - y[te].mean()) ** 2).sum())
    return out


def _table(spark, n=400, missing=True):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        a, b, c = (float(v) for v in rng.normal(size=3))
        hot = 1.0 if i % 3 == 0 else float(rng.integers(0, 40))  # a third of the rows hold one value
        y = 2 * abs(a) + (b > 0.3) * 1.5 + 0.1 * hot + float(rng.normal()) * 0.05
        rows.append((i, None if missing and i % 17 == 0 else a, float("nan") if missing and i % 23 == 0 else b, c, hot, y))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, hot double, y double")
    return split.kfold(df, "id", 4, 1)


def test_scores_equal_trees_grown_one_by_one(spark):
    df, cols = _table(spark), ["a", "b", "c", "hot"]
    for spec in (TreeSpec(depth=2, rounds=1, rate=1.0, bins=8), TreeSpec(depth=3, rounds=2, rate=0.5, bins=16, min_rows=5)):
        scorer = TreeScorer(df, cols, "y", spec=spec)
        rows = scorer.table.collect()
        x = np.array([list(r["_bins"]) for r in rows])
        y, fold = np.array([r["_y"] for r in rows]), np.array([r["fold"] for r in rows])
        members = np.array([[1, 1, 0, 0], [0, 0, 1, 0], [1, 1, 1, 1]], dtype=bool)
        for m, got in zip(members, scorer.fold_scores(members)):
            assert np.allclose(got, _brute(x[:, m], y, fold, spec), atol=1e-4)


def test_bins_keep_the_order_and_hot_values(spark):
    df = _table(spark, missing=False)
    far = df.union(df.limit(1).withColumn("a", F.lit(1e300)))
    for table in (df, far):
        for c, edges in zip(["a", "hot"], bin_edges(table, ["a", "hot"], 16)):
            v = np.array([r[0] for r in table.select(c).collect()])
            assert edges == sorted(set(edges)) and len(edges) <= 15
            counts = np.bincount(np.searchsorted(edges, v, side="left"))
            single = max(np.unique(v, return_counts=True)[1])
            assert counts.max() <= max(single, 0) + 2.5 * len(v) / 16
    assert bin_edges(df.limit(0), ["a"], 16) == [[]]


def test_search_finds_the_planted_columns_in_any_partitioning(spark):
    p = split.kfold(tb.planted(spark, SF001), "vec_id", 5, 42)
    feats = [f"f{i}" for i in (1, 3, 8, 17, 22, 33, 40, 51, 60)]
    found = []
    for df in (p, p.repartition(7, F.rand(5))):
        s = search.GeneticSelector(k=3, population=10, generations=8, elite=3, seed=42).search(TreeScorer(df, feats, "y"), len(feats))
        found.append((s.selected_, s.history))
    assert found[0] == found[1]
    assert [feats[i] for i in found[0][0]] == ["f3", "f17", "f40"]


def test_edges(spark):
    df, cols = _table(spark, 60), ["a", "b", "c", "hot"]
    assert TreeScorer(df, cols, "y")(np.zeros((2, 4), dtype=bool)) == [0.0, 0.0]
    one = np.ones((1, 4), dtype=bool)
    assert TreeScorer(df.limit(0), cols, "y")(one) == [0.0]
    assert TreeScorer(df.withColumn("fold", F.lit(0)), cols, "y")(one) == [0.0]
    constant = TreeScorer(df.withColumn("y", F.lit(4.0)), cols, "y")
    assert constant(one) == [1.0]
    odd = df.withColumn("y", F.when(F.col("id") == 3, float("inf")).when(F.col("id") == 4, None).otherwise(F.col("y")))
    assert TreeScorer(odd, cols, "y").table.count() == 58
    none = df.withColumn("a", F.lit(None).cast("double"))
    assert math.isfinite(TreeScorer(none, cols, "y")(one)[0])
    clash = df.withColumnsRenamed({"a": "c0", "b": "v", "c": "lo"})
    assert TreeScorer(clash, ["c0", "v", "lo", "hot"], "y")(one) == TreeScorer(df, cols, "y")(one)
