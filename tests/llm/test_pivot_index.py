"""Exact top-k against brute force: clustered, repeated, tied, huge and odd vectors, small pieces and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import pivot_index
from tabsmith.llm.pivot_index import op13_exact_topk, products, top_products

from .conftest import write

SCHEMA = "vec_id long, vector array<bigint>"


def brute(rows, is_query, k):
    by = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v:
            by[i] = min(by.get(i, v), v)
    out = []
    for i, q in by.items():
        if is_query(i):
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in by.items() if j != i and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def check(spark, rows, every=3, k=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in top_products(df, F.col("id") % every == 0, vector_col="vector", k=k).collect())
    assert got == brute(rows, lambda i: i % every == 0, k)


def clustered(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 200, (5, dim))
    return [(int(i), np.floor(centres[rng.integers(5)] + rng.normal(0, 30, dim)).astype(int).tolist()) for i in rng.permutation(n)]


@pytest.fixture
def small(monkeypatch):
    for name, value in {"PIECE_ROWS": 40, "BLOCK_ROWS": 16, "ANNULUS_ROWS": 20, "FIRST_ROWS": 30, "GROWTH": 2, "SAMPLE_ROWS": 200}.items():
        monkeypatch.setattr(pivot_index, name, value)


def test_clusters_in_many_small_cells(spark, small):
    check(spark, clustered(1, 900))


def test_a_third_of_all_rows_equal_and_ties(spark, small):
    rng = np.random.default_rng(2)
    rows = clustered(2, 300) + [(1000 + i, [9, 9, 9, 9, 9, 9, 9, 9]) for i in range(150)]
    rows += [(2000 + i, [int(x) for x in rng.integers(-1, 2, 8)]) for i in range(100)]
    check(spark, rows + rows[:40])


def test_odd_rows(spark):
    rows = [(0, [1, 2]), (3, [2, 1]), (6, None), (9, [1, None]), (None, [5, 5]), (12, []), (13, []), (15, [0, 0]), (18, [3]), (3, [2, 1]), (4, [7, 7]), (4, [1, 9]), (21, [1, 2, 3])]
    check(spark, rows)
    check(spark, rows[:1])
    check(spark, [(3 * i, [2**40 * (i % 7 - 3), 2**45 + i]) for i in range(30)])
    check(spark, [(i, [2**62 * (i % 3 - 1), i]) for i in range(12)])
    assert top_products(spark.createDataFrame([], SCHEMA), F.col("id") >= 0).count() == 0


def test_long_vectors(spark):
    rng = np.random.default_rng(4)
    check(spark, [(i, rng.integers(-300, 300, 5000).tolist()) for i in range(40)])


def test_query_edges_and_clashing_columns(spark, tmp_path):
    nan = float("nan")
    rows = [(0, [0.5, -0.25]), (50, [nan, 1.0]), (100, [0.1, 0.2]), (1, [float("inf"), 0.0]), (2, [0.3, 0.3]), (3, None), (4, [0.0, 0.0]), (100, [0.1, 0.2]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS score", "3 AS rank", "4 AS vector", "5 AS query_id")
    write(df, tmp_path, "embeddings")
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows if e and np.isfinite(e).all()]
    assert sorted(tuple(r) for r in op13_exact_topk(spark, str(tmp_path)).collect()) == brute(whole, lambda i: i % 50 == 0, 5)


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for scale in (300, 2**24, 2**40, 2**62):
        q, x = (rng.integers(-scale, scale, (4, 6)) for _ in range(2))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(r, s)))) for s in x] for r in q]
        assert products(q, x).tolist() == want
