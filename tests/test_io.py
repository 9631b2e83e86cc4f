import math
import tempfile

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabsmith.operators import score, validate
from tabsmith.operators.quantiles import quantiles
from tabsmith.operators.scale import ZScoreScaler
from tabsmith.sources import files


def test_json_report_and_model_round_trip(spark):
    d = tempfile.mkdtemp(prefix="tabsmith-io-")
    files.write_json_report(spark, f"{d}/report", {"cv": {"r2": float("nan"), "mae": 1.5}}, {"run": "t"})
    back = files.read_json_report(spark, f"{d}/report")
    assert back["cv"] == {"r2": None, "mae": 1.5} and back["metadata"] == {"run": "t"}
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(20)], "x double, y double")
    model = PipelineModel(stages=[ZScoreScaler(inputCols=["x"]).fit(df)])
    files.save_model(model, f"{d}/m", metrics=df.limit(1), features=["x"])
    again = files.load_model(f"{d}/m")
    a = [r["x"] for r in model.transform(df).collect()]
    b = [r["x"] for r in again.transform(df).collect()]
    assert a == b


def test_saved_parts_and_result_order(spark):
    d = tempfile.mkdtemp(prefix="tabsmith-parts-")
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(20)], "x double, y double")
    model = PipelineModel(stages=[ZScoreScaler(inputCols=["x"]).fit(df)])
    sizes = spark.createDataFrame([("a", 0.25), ("b", 0.75), ("c", None)], "feature_name string, importance double")
    files.save_model(model, d, df.limit(1), ["x"], {"alpha": 0.5, "depth": None}, sizes, df)
    got = files.load_saved(d)
    assert got["params"] == {"alpha": 0.5, "depth": None} and got["features"] == ["x"]
    assert [r["feature_name"] for r in got["importances"].collect()] == ["b", "a", "c"]
    assert got["test"].count() == 20 and got["metrics"].count() == 1
    files.save_model(model, d)  # parts of the older model are not taken for this one's
    bare = files.load_saved(d)
    assert bare["features"] == [] and all(bare[p] is None for p in ("metrics", "params", "importances", "test"))

    board = spark.createDataFrame([("m1", 0.5), ("m2", None), ("m3", 0.9), ("m0", 0.5)], "model string, mean_r2 double")
    files.write_results({"validation": board, "history": board.selectExpr("mean_r2 AS generation", "model"), "other": board.limit(0)}, f"{d}/r")
    assert [r["model"] for r in spark.read.option("header", True).csv(f"{d}/r/validation").collect()] == ["m3", "m0", "m1", "m2"]
    assert spark.read.option("header", True).csv(f"{d}/r/history").count() == 4


def test_column_checks(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    assert validate.numeric_features(df, "c").columns == ["a"]
    with pytest.raises(ValueError):
        validate.numeric_features(df, "absent")
    with pytest.raises(ValueError):
        validate.numeric_features(df.select("b"))
    assert validate.subset_by_index(df, ["a", "c"], [1, 0]).columns == ["c", "a"]
    for bad in ([0, 0], [2], [-1]):
        with pytest.raises(ValueError):
            validate.subset_by_index(df, ["a", "c"], bad)
    assert validate.available_features(df, ["c", "z"]) == (["c"], ["z"])
    with pytest.raises(ValueError):
        validate.available_features(df, ["z"])
    assert score.consistency(["a", "b"], ["b", "d"]) == {"missing": ["a"], "extra": ["d"], "scaler": True, "ok": False}
    assert score.consistency(["a"], ["a"], has_scaler=False)["ok"] is False


def test_feature_list_fallbacks(spark):
    d = tempfile.mkdtemp(prefix="tabsmith-list-")
    assert files.read_feature_list(spark, f"{d}/absent", ["a", "y"], "y") == (["a"], "all")
    spark.createDataFrame([("z",)], "name string").write.option("header", True).csv(f"{d}/malformed")
    assert files.read_feature_list(spark, f"{d}/malformed", ["a", "y"], "y") == (["a"], "all")
    spark.createDataFrame([("z", 10), ("k", 9)], "feature string, rank int").write.option("header", True).csv(f"{d}/ranked")
    assert files.read_feature_list(spark, f"{d}/ranked", ["a", "y"], "y") == (["k", "z"], "file")


def test_approximate_quantiles_close(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1001)], "x double")
    got = quantiles(df, ["x"], [0.5], exact=False)["x"][0]
    assert math.isclose(got, 500.0, abs_tol=1.0)
