from pyspark.sql import functions as F

from tabsmith.operators import split


def test_split_and_folds_exact_sizes_and_stable(spark):
    df = spark.range(0, 1037).withColumnRenamed("id", "key")
    s = split.train_test_split(df, "key", 0.2, 42)
    assert s.filter(F.col("split") == "test").count() == 208  # ceil(0.2 * 1037)
    s2 = split.train_test_split(df.repartition(7), "key", 0.2, 42)
    a = {r["key"] for r in s.filter("split = 'test'").collect()}
    b = {r["key"] for r in s2.filter("split = 'test'").collect()}
    assert a == b
    f = split.kfold(df, "key", 5, 42)
    sizes = sorted((r["fold"], r["count"]) for r in f.groupBy("fold").count().collect())
    assert [c for _, c in sizes] == split.fold_sizes(1037, 5)


def test_rank_cuts_multi_level(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "key").withColumn("_h", split.keyed_hash("key", 1, "x"))
    rows = sorted((r["_h"], r["key"]) for r in df.collect())
    cuts = split.rank_cuts(df, "_h", "key", [0, 1234, 4999])
    assert cuts == [rows[0], rows[1234], rows[4999]]
