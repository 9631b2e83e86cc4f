"""Runs of words against a brute-force search, and the query against a plain reading of its contract."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tabsmith.llm.periodic_runs import find_runs, op11_periodic_runs, periodic_runs
from tabsmith.llm.recompression import Grammar

from ..conftest import SF001
from .conftest import write


def brute(words: list) -> list[tuple]:
    """(start, length, period) of every run, by comparing all pairs of places."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)  # the smallest period of a stretch comes first
            i = j
    return sorted((s, n_, q) for (s, n_), q in out.items())


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *head, digest(listed), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize("seed", range(40))
def test_grammar_extensions(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(0, 1 + seed % 3, rng.integers(0, 60)) for _ in range(4)]
    parts = [np.tile(p[: 1 + seed % 5], 9) if rng.random() < 0.4 else p for p in parts]
    w = np.concatenate([np.concatenate(([3 + k], p)) for k, p in enumerate(parts)] + [[3 + len(parts)]]).astype(np.int32)
    g = Grammar(w, 3 + len(parts) + 1, len(parts) + 1, seed)
    x, y = np.nonzero(np.triu(np.ones((len(w), len(w)), bool), 1))
    same = lambda a, b: 0 <= a and b < len(w) and w[a] == w[b]
    for forward in (True, False):
        step = 1 if forward else -1
        want = []
        for a, b in zip(x.tolist(), y.tolist()):
            k = 0
            while same(a + k * step, b + k * step):
                k += 1
            want.append(k)
        assert g.extend(x, y, forward).tolist() == want


@pytest.mark.parametrize("seed", range(60))
def test_runs_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(6):
        parts = [np.tile(rng.integers(0, 3, rng.integers(1, 6)), rng.integers(1, 8)) for _ in range(rng.integers(0, 6))]
        texts.append(np.concatenate([np.zeros(0, int), *parts]))
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    d, s, n, q = find_runs(np.concatenate(texts).astype(np.int32), bounds, 3)
    for k, t in enumerate(texts):
        assert sorted(zip(s[d == k].tolist(), n[d == k].tolist(), q[d == k].tolist())) == brute(t.tolist())


def test_candidates_across_documents():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 40, n) for n in rng.integers(6, 30, 300)]
    texts[7] = np.tile([1, 2], 9)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    d, s, n, q = find_runs(np.concatenate(texts).astype(np.int32), bounds, 40)
    assert [(k, *r) for k, t in enumerate(texts) for r in brute(t.tolist())] == list(zip(d.tolist(), s.tolist(), n.tolist(), q.tolist()))


def check(df, docs):
    got = sorted((tuple(r) for r in df.collect()), key=str)
    want = sorted((expected(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=str)
    assert got == want


def test_query_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = op11_periodic_runs(spark, SF001)
    check(out, docs)
    assert out.where("n_runs > 0").count() > 5


def test_edge_rows_and_clashing_columns(spark, tmp_path, edge_docs):
    docs = edge_docs.where("coalesce(length(text), 0) < 100000")
    rows = [(20, "a " * 9), (20, "a " * 9), (21, "x y " * 40 + "z"), (22, "\x0b\x0ca\tb\n" * 5), (None, "k l m " * 8), (23, "é ß " * 4 + "  ")]
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    write(docs, tmp_path, "documents")
    check(op11_periodic_runs(spark, str(tmp_path)), docs)
    named = docs.selectExpr("doc_id", "text", "1 AS row", "2 AS runs", "3 AS n_words", "4 AS h", "lang AS collapsed")
    out = periodic_runs(named)
    assert out.count() == docs.count() and out.select("row.row", "row.runs").distinct().collect() == [(1, 2)]


def test_long_texts(spark):
    texts = ["w " * 200000, "p q r " * 50000, " ".join(str(i % 977) for i in range(120000))]
    out = periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("row.doc_id").collect()
    assert [[tuple(x) for x in r["runs"]] for r in out] == [[(0, 200000, 1)], [(0, 150000, 3)], [(0, 120000, 977)]]
    assert [len(r["collapsed"].split()) for r in out] == [1, 3, 977]
