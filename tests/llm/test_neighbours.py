import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import neighbours


def _clustered(n, centres=40, dim=8, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 20
    return middle[rng.integers(centres, size=n)] + rng.normal(size=(n, dim))


def _brute(ids, x, k=10):
    out = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = neighbours.distances(x[i][None], x)[0]
        d[i] = np.inf
        out += [(int(ids[i]), rank + 1, int(ids[j])) for rank, j in enumerate(np.lexsort((ids, d))[:k])]
    return sorted(out)


def _found(df, **kw):
    return sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(df, F.col("id") % 100 == 0, **kw).collect())


@pytest.mark.parametrize("hot", [0, 700])
def test_many_shards_at_factor_one_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(neighbours, "SHARD_BYTES", 128 * 8 * 8)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 3)
    x = _clustered(2000)
    x[:hot] = x[0]  # equal vectors that no ring parts lie in one shard of several pieces
    ids = np.random.default_rng(6).permutation(2000)
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, ID2 string")
    want = _brute(ids, x)
    assert _found(df, relax=1.0) == want
    pairs = lambda rows: {(query, vec) for query, _, vec in rows}
    assert len(pairs(_found(df.repartition(5))) & pairs(want)) >= 0.9 * len(want)


@pytest.mark.parametrize("n", [2000, 8000])
def test_a_query_visits_few_shards_of_clustered_vectors(n):
    x = _clustered(n)
    top = neighbours.TopTree(x[:: 4], n // 50)
    own = top.assign(x)
    assert len(top.paths) == n // 50 and own.min() >= 0 and own.max() < n // 50
    for s in np.unique(own):
        low_high = top.spread(s, x[own == s])
        top.ranges[int(s)] = low_high[:, 0], low_high[:, 1]
    q = np.arange(0, n, 40)
    limit = np.array([np.sort(neighbours.distances(x[i][None], x)[0])[10] for i in q])
    seen = top.visits(x[q], own[q], limit, 1.0)
    for i, shards, most in zip(q, seen, limit):  # nothing near lies in a shard that is passed over
        near = own[neighbours.distances(x[i][None], x)[0] <= most]
        assert set(near) <= {*shards, own[i]}
    assert np.mean([len(s) for s in seen]) <= 1.5 * n / 50 / 40 + 3  # about the shards of one cluster, whatever the number of clusters


def test_several_dimensions_and_several_vectors_of_one_id(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 5.0]), (1, [0.0, 4.0]), (2, [1.0, 0.1]), (200, [1.0, 1.0, 1.0]), (3, [1.0, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert _found(df) == [(100, 1, 1), (100, 2, 2), (200, 1, 3)]  # of id 100 the first in array order, [0, 5]


def test_columns_named_as_in_the_plan(spark):
    rows = [(100, [1.0, 0.0], 1, 1, "a", 5), (1, [0.0, 4.0], 2, 2, "b", 6), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, v int, Shard string, rank int")
    assert _found(df) == [(100, 1, 1)]
