import os

import pytest
from pyspark.sql import functions as F

from tabsmith.llm import jaccard_join, neighbours
from tabsmith.llm.shared import scratch, stored
from tabsmith.session import ensure_checkpoint_dir


@pytest.fixture
def folders(spark):
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    return lambda: {x for x in os.listdir(root) if x.startswith("llm-")}


def test_tables_go_with_their_scratch_and_stay_when_handed_on(spark, folders):
    before = folders()
    with scratch(spark) as outer:
        with scratch(spark) as hand_on:
            one, two = stored(spark.range(3)), stored(spark.range(4))
            kept = hand_on(one.union(two))
            same = hand_on(two)
            assert len(folders() - before) == 3
        assert same is two and kept.count() == 7 and len(folders() - before) == 2
        last = outer(two)
    assert last.count() == 4 and len(folders() - before) == 1


def test_an_error_leaves_no_table(spark, folders):
    before = folders()
    with pytest.raises(ZeroDivisionError), scratch(spark):
        stored(spark.range(3))
        raise ZeroDivisionError
    assert folders() == before


def test_operators_leave_nothing_behind_once_their_result_is_written(spark, folders, edge_docs, tmp_path):
    before = folders()
    with scratch(spark):
        jaccard_join.jaccard_groups(edge_docs).write.parquet(f"{tmp_path}/groups")
        jaccard_join.one_of_each(edge_docs).write.parquet(f"{tmp_path}/rows")
        vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(150)], "vec_id long, embedding array<double>")
        neighbours.nearest(vectors, F.col("id") % 100 == 0).write.parquet(f"{tmp_path}/near")
    assert folders() == before and spark.read.parquet(f"{tmp_path}/near").count() == 20
    jaccard_join.jaccard_groups(edge_docs).write.parquet(f"{tmp_path}/again")
    assert len(folders() - before) == 1  # the result that the caller may still read
