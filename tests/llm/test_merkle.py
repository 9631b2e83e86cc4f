"""The manifest against a plain reading of its contract, row order, blocks of several rounds and other fan-outs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tabsmith.llm.merkle import FIELDS, fold, leaf_of, merkle_manifest, op12_merkle_manifest, siblings
from tabsmith.operators.ordering import row_numbers

from ..conftest import SF001
from .conftest import DOCS, write


def H(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(r: dict) -> str:
    return H("".join("-" if r[f] is None else f"{len(str(r[f]).encode())}:{r[f]}" for f in FIELDS))


def climb(nodes: list[str], fan: int):
    """Root, and the sibling strings of every node from the bottom up."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            r = i // fan * fan
            ways[k].append("".join(nodes[j] for j in range(r, min(r + fan, len(nodes))) if j != i))
        nodes = [H("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        at = [i // fan for i in at]
    return nodes[0], ways


def expected(rows: list[dict], fan: int = 2):
    by = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r))):
        by.setdefault(r["lang"], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: climb([plain_leaf(r) for r in by[g]], fan) for g in langs}
    root, over = climb([trees[g][0] for g in langs], fan)
    out = []
    for g, top in zip(langs, over):
        for r, way in zip(by[g], trees[g][1]):
            bent = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            out.append((r["doc_id"], plain_leaf(r), trees[g][0], root, H("".join(way + top)), not bent))
    return sorted(out, key=str)


def got(df):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "verified"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_query_on_a_whole_table(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    out = op12_merkle_manifest(spark, SF001)
    assert got(out) == expected(rows)
    assert 0 < out.where("NOT verified").count() < len(rows)


def test_edge_rows(spark, tmp_path, edge_docs):
    write(edge_docs, tmp_path, "documents")
    assert got(op12_merkle_manifest(spark, str(tmp_path))) == expected([r.asDict() for r in edge_docs.collect()])


@pytest.mark.parametrize("n,fan,block_levels", [(1, 2, 2), (2, 2, 1), (5, 2, 1), (33, 2, 2), (64, 2, 3), (65, 2, 3), (130, 3, 2), (41, 5, 1)])
def test_rounds_and_fan_outs(spark, n, fan, block_levels):
    rows = [(7 * i, f"t{i}", ["en", "de", None, "fr", "it"][i % 5] if i > n // 2 else "en", "s", i) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    out = merkle_manifest(docs, FIELDS, fan=fan, block_levels=block_levels)
    out = out.withColumn("folded", fold(F.col("leaf"), F.col("path"))).withColumn("proof", siblings(F.col("path")))
    want = {w[0]: w for w in expected([dict(zip(DOCS.names, r)) for r in rows], fan)}
    for r in out.collect():
        w = want.pop(r["row"]["doc_id"])
        assert (r["leaf"], r["subroot"], r["root"], H(r["proof"])) == w[1:5] and r["folded"] == r["root"]
    assert not want


def test_order_of_rows_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    named = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 AS grp", "2 AS pos", "3 AS node", "4 AS total", "5 AS path", "6 AS block", "7 AS row")
    a = merkle_manifest(named.repartition(7, "source"), FIELDS, carry=["row", "path"])
    b = merkle_manifest(docs.orderBy(F.desc("doc_id")), FIELDS)
    assert a.select("row.doc_id", "leaf", "root", "path").exceptAll(b.select("row.doc_id", "leaf", "root", "path")).count() == 0
    assert a.select("row.row", "row.path").distinct().collect() == [(7, 5)]


def test_any_change_shows(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    paths = merkle_manifest(docs, FIELDS)
    for f in FIELDS:
        other = F.lit(10**9) if f in ("doc_id", "n_chars") else F.concat(F.coalesce(f, F.lit("")), F.lit("x"))
        changed = docs.select(F.col("doc_id").alias("was"), leaf_of([other if c == f else F.col(c) for c in FIELDS]).alias("new"))
        folded = paths.join(changed, F.col("row.doc_id") == F.col("was")).where(fold(F.col("new"), F.col("path")) == F.col("root"))
        assert folded.count() == 0


def test_row_numbers(spark):
    rows = [(i * 7919 % 1000, ["a", None, "b"][i % 3 if i % 2 else 0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "v long, row_number string").repartition(5)
    out = row_numbers(df, ["v"], within=["row_number"], name="k", total="n").collect()
    for g in ("a", "b", None):
        here = sorted((r["k"], r["v"], r["n"]) for r in out if r["row_number"] == g)
        assert [k for k, _, _ in here] == list(range(len(here))) and {n for _, _, n in here} == {len(here)}
        assert [v for _, v, _ in here] == sorted(v for v, x in rows if x == g)
