"""Work that queries of the model suite and the neighbour search share or leave out."""

import numpy as np
import pytest
from pyspark.sql import DataFrame

from tabsmith.operators import knn, models, split, suite
from tabsmith.operators.ordering import written
from tabsmith.plans import modelling

SF = "/root/testdata/sf0.001"


def _folds(spark, n=300, width=3, seed=5):
    x = np.random.default_rng(seed).normal(size=(n, width))
    rows = [(i, *map(float, r), float(r[0] - 2 * r[1])) for i, r in enumerate(x)]
    names = [f"c{j}" for j in range(width)]
    return names, split.kfold(spark.createDataFrame(rows, f"key long, {', '.join(f'{c} double' for c in names)}, y double"), "key", 5, 42)


@pytest.fixture
def nothing_stored(monkeypatch):
    monkeypatch.setattr(modelling, "_TABLES", {})


@pytest.mark.parametrize("query, kind", [("k2_linear_models", "linear"), ("k5_decision_tree_cv", "dt")])
def test_a_query_of_one_kind_fits_that_kind_alone(spark, monkeypatch, nothing_stored, query, kind):
    asked = []
    whole = suite.fold_scores
    monkeypatch.setattr(suite, "fold_scores", lambda specs, *a, **kw: asked.extend(specs) or whole(specs, *a, **kw))
    rows = getattr(modelling, query, None) or __import__("tabsmith.plans.catalog", fromlist=["x"]).REGISTRY[query][0]
    got = {r["model"]: r["error"] for r in rows(spark, SF).collect()}
    assert got == {s.name: None for s in models.SUITE if s.kind == kind}
    assert {s.kind for s in asked} == {kind}
    monkeypatch.setattr(suite, "fold_scores", lambda specs, *a, **kw: pytest.fail("fitted twice"))
    assert {r["model"] for r in rows(spark, SF).collect()} == set(got)


def test_neighbour_models_of_one_metric_share_a_search(spark, monkeypatch):
    cols, table = _folds(spark)
    searches = []
    whole = suite.nearest
    monkeypatch.setattr(suite, "nearest", lambda *a, **kw: searches.append(kw["k"]) or whole(*a, **kw))
    specs = [s for s in models.NONLINEAR_GRID if s.kind == "knn"]
    got = {(r["model"], r["fold"]): r for r in suite.fold_scores(specs, table, "key", cols, "y").collect()}
    assert searches == [7] * 5
    rows = np.array([list(r) for r in table.select("fold", "key", "y", *cols).orderBy("key").collect()])
    for s in specs:
        for f in range(5):
            train, test = rows[rows[:, 0] != f], rows[rows[:, 0] == f]
            far = ((test[:, None, 3:] - train[None, :, 3:]) ** 2).sum(2)
            pred = train[np.argsort(far, axis=1, kind="stable")[:, : s.params["k"]], 2].mean(1)
            r2 = 1 - ((test[:, 2] - pred) ** 2).sum() / ((test[:, 2] - test[:, 2].mean()) ** 2).sum()
            assert got[s.name, f]["error"] is None and got[s.name, f]["r2"] == pytest.approx(r2, rel=1e-9)


def test_an_input_of_one_file_is_dealt_anew(spark, monkeypatch):
    cols, table = _folds(spark)
    one = written(table.coalesce(1))
    monkeypatch.setattr(suite, "PIECE_ROWS", 50)
    dealt = suite._dealt(one, "key")
    assert one.rdd.getNumPartitions() == 1 and len(dealt.inputFiles()) > 1
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, one.collect()))
    monkeypatch.setattr(suite, "PIECE_ROWS", 1000)
    assert suite._dealt(one, "key") is one


def test_bounds_are_worked_out_in_small_blocks(monkeypatch):
    import pyarrow as pa

    blocks, whole = [], knn.bounds
    monkeypatch.setattr(knn, "bounds", lambda a, low, *r: blocks.append(len(a) * len(low)) or whole(a, low, *r))
    rng = np.random.default_rng(1)
    low = rng.random((512, 2))
    cells = (np.arange(512, dtype=np.int32), low, low + 0.01, np.zeros((512, 2)), np.full(512, 1000))
    x = rng.random((1000, 2))
    lists = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), lists(x), lists(np.ones((1000, 1))), lists(np.full((1000, 1), np.inf)), pa.array([0] * 1000)], names=["r_key", "x", "need", "kth", "done"])
    out = next(knn._plan(cells, 2, 1, "nan_euclidean", 4096, 6)([batch]))
    assert max(blocks) <= 1 << 16
    # the first cells read are those with the least bounds
    least = whole(x, *cells[1:4], "nan_euclidean", 6, cells[4])
    for i in (0, 500, 999):
        read = out.column("visits")[i].as_py()
        assert sorted(least[i, read]) == sorted(np.sort(least[i])[: len(read)])


def test_bounds_of_whole_cells_equal_those_of_the_general_way():
    rng = np.random.default_rng(2)
    low = rng.normal(size=(40, 3))
    high, a = low + rng.random((40, 3)), rng.normal(size=(30, 3))
    gap = np.maximum(np.maximum(low[None] - a[:, None], a[:, None] - high[None]), 0.0)
    for metric, weight in (("euclidean", 1.0), ("nan_euclidean", 2.0)):
        got = knn.bounds(a, low, high, np.zeros((40, 3)), metric, 6, np.full(40, 9))
        np.testing.assert_allclose(got, np.sqrt(weight * (gap**2).sum(2)), rtol=1e-9)


def test_screened_pairs_hold_the_nearest_with_unusable_ones_left_out():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(20, 16)) + 1e4, rng.normal(size=(500, 16)) + 1e4
    usable = rng.random((20, 500)) < 0.7
    far = ((a[:, None] - b[None]) ** 2).sum(2)
    for most in (np.full(20, np.inf), np.quantile(far, 0.1, axis=1)):
        row, col, square = knn._screened(a, b, usable, most, 4)
        assert usable[row, col].all()
        np.testing.assert_allclose(square, far[row, col], rtol=1e-12)
        best = np.where(usable & (far <= most[:, None]), far, np.inf)
        found = set(zip(row.tolist(), col.tolist()))
        assert all((i, j) in found for i in range(20) for j in np.argsort(best[i])[:4] if np.isfinite(best[i, j]))


def test_sampled_texts_do_not_pass_the_driver(spark, monkeypatch):
    from tabsmith.llm import toxicity

    docs = spark.createDataFrame([(i, "you vile fool" if i % 3 == 0 else "a fine day for a walk") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    for name in ("collect", "toArrow", "toPandas", "first", "head", "take"):
        plain = getattr(DataFrame, name)
        monkeypatch.setattr(type(docs), name, lambda self, *a, _plain=getattr(type(docs), name, plain): pytest.fail("texts on the driver") if "text" in self.columns else _plain(self, *a))
    model = toxicity.train(docs, labels)
    monkeypatch.undo()
    assert len(model.features) == len(model.weights) > 0
    got = {r["row"]["doc_id"] % 3 == 0: r["score"] for r in toxicity.score(docs, model).collect()}
    assert got[True] >= 0.3 > got[False]
    assert len(toxicity.train(docs, labels.where("toxic > 1")).features) == 0


def test_tree_fits_read_small_pieces_together(spark, monkeypatch):
    # k4_ensemble_grid: every job of a fit had a task for each small piece of the stored table
    cols, table = _folds(spark)
    table = table.select("key", "fold", "y", *cols).repartition(6)
    assert table.rdd.getNumPartitions() == 6
    seen = []
    monkeypatch.setattr(suite, "_fold_scores", lambda spec, train, test, *a: seen.append((train.rdd.getNumPartitions(), train.count() + test.count())) or {"r2": 1.0, "mae": 0.0, "rmse": 0.0})
    monkeypatch.setattr(suite, "written", lambda df: table)
    suite.fold_scores(models.ENSEMBLE_GRID, table, "key", cols, "y").collect()
    assert seen == [(1, 300)] * 20
    monkeypatch.setattr(suite, "TREE_CELLS", 300)  # 900 values: three pieces
    some = suite._merged(table, cols)
    assert some.rdd.getNumPartitions() == 3 and sorted(map(tuple, some.collect())) == sorted(map(tuple, table.collect()))
    monkeypatch.setattr(suite, "TREE_CELLS", 100)
    assert suite._merged(table, cols) is table and suite._merged(table, cols, fits=3).rdd.getNumPartitions() == 3


def test_the_longest_fits_begin_first():
    assert [s.name for s in sorted(models.ENSEMBLE_GRID, key=suite._work)] == ["GB_Aggressive", "GB_Conservative", "RF_Deep", "RF_Wide"]


def test_forests_keep_the_nodes_of_rows_and_grow_the_same_trees(spark):
    cols, table = _folds(spark)
    rows = models._assemble(table.coalesce(1), cols, "y").cache()
    forest = models._ml_estimator(models.ModelSpec("rf", "rf", dict(numTrees=12, maxDepth=10)))
    assert forest.getCacheNodeIds()
    assert forest.fit(rows).toDebugString.split("\n")[1:] == forest.copy({forest.cacheNodeIds: False}).fit(rows).toDebugString.split("\n")[1:]
    rows.unpersist()
