"""Cached tables are released, and every model of a comparison works."""

from tabsmith.operators import models, split
from tabsmith.operators.impute import knn_fill

ROWS = [(i, float(i % 17), None if i % 5 == 0 else float(i % 7), float(i % 11)) for i in range(200)]


def cached(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_nothing_stays_cached(spark):
    before = cached(spark)
    df = spark.createDataFrame(ROWS, "key long, a double, b double, c double")
    folds = split.kfold(df.fillna(0.0), "key", 3)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [66, 67, 67]
    assert split.train_test_split(df, "key").filter("split = 'test'").count() == 40
    assert knn_fill(df, "key", ["a", "b", "c"], k=3, per_bucket=20).filter("b IS NULL").count() == 0
    specs = [s for s in models.SUITE if s.kind in ("linear", "dt")]
    out = models.compare_models(specs, folds, "key", ["a", "b"], "c").collect()
    assert len(out) == len(specs) and all(r["error"] is None and r["mean_r2"] is not None for r in out)
    assert cached(spark) == before
