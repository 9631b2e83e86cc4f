"""Every query with SQL against DuckDB over a whole table, and on the edge rows."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from tabsmith.llm.catalog import load_all

from ..conftest import SF01
from .conftest import write

QUERIES = load_all()
WITH_SQL = [n for n, (_, sql) in QUERIES.items() if sql]


def rows_of(df):
    def plain(v):
        if pd.isna(v):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False))


def compare(spark, name, sf_dir):
    fn, sql = QUERIES[name]
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    theirs = con.sql(sql).df()
    mine = fn(spark, sf_dir).toPandas()
    assert sorted(mine.columns) == sorted(theirs.columns)
    cols = sorted(mine.columns)
    assert rows_of(mine[cols]) == rows_of(theirs[cols])
    return mine


@pytest.mark.parametrize("name", WITH_SQL)
def test_whole_table(spark, name):
    assert len(compare(spark, name, SF01)) > 0


@pytest.mark.parametrize("name", [n for n in WITH_SQL if n.split("_")[0] not in ("op1", "op13")])
def test_unique_edge_rows(spark, edge_docs, tmp_path, name):
    # DuckDB keys on doc_id, so repeated and null ids are tested by the operators' own tests
    write(edge_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), tmp_path, "documents")
    compare(spark, name, str(tmp_path))


@pytest.mark.parametrize("name", [n for n in QUERIES if n.split("_")[0] not in ("op1", "op7", "op13")])
def test_empty_table(spark, no_docs, tmp_path, name):
    write(no_docs, tmp_path, "documents")
    write(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert QUERIES[name][0](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n.split("_")[0] not in ("op1", "op7", "op13")])
def test_edge_rows_do_not_crash(spark, edge_docs, tmp_path, name):
    write(edge_docs, tmp_path, "documents")
    write(spark.createDataFrame([(1, 1, 0), (10, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    rows = QUERIES[name][0](spark, str(tmp_path)).collect()
    assert len(rows) >= edge_docs.count()
