"""Chart tables: areas, places, points beyond the fences, missing and empty input."""

import numpy as np
import pytest

from tabsmith.operators import chartdata


def test_density_has_area_one(spark):
    df = spark.createDataFrame([(float(v) if v % 7 else None, 3.0) for v in range(100)], "y double, same double")
    rows = chartdata.density(df, ["y", "same"], 15).collect()
    area = sum(r["density"] * (r["bin_end"] - r["bin_start"]) for r in rows if r["column"] == "y")
    assert area == pytest.approx(1.0)
    assert [r["density"] for r in rows if r["column"] == "same"] == [None]
    assert chartdata.density(df.limit(0), ["y"], 15).count() == 0


def test_ranks_have_as_many_bins_as_rows_up_to_ten(spark):
    few = spark.createDataFrame([(1,), (5,), (9,), (None,)], "rank int")
    assert sorted((r["bin"], r["count"]) for r in chartdata.rank_histogram(few).collect()) == [(0, 1), (1, 1), (2, 1)]
    many = spark.range(1, 101).selectExpr("CAST(id AS INT) AS rank")
    assert chartdata.rank_histogram(many).count() == 10
    assert chartdata.rank_histogram(few.limit(0)).count() == 0


def test_points_beyond_the_fences(spark):
    v = [float(x) for x in range(20)] + [1000.0, -1000.0]
    rows = [(i, x, None, x) for i, x in enumerate(v)] + [(99, None, None, float("nan"))]
    df = spark.createDataFrame(rows, "column long, value double, none double, again double")  # names like those of the result
    got = chartdata.box_points(df.withColumnRenamed("column", "id"), "id", ["value", "none", "again"]).collect()
    q1, q3 = np.percentile(v, [25, 75])
    want = {(i, c, x) for i, x in enumerate(v) if not q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1) for c in ("value", "again")}
    assert {(r["id"], r["column"], r["value"]) for r in got} == want and len(want) == 4
    assert chartdata.box_points(df.withColumnRenamed("column", "id"), "id", ["none"]).count() == 0


def test_models_in_run_order(spark):
    res = spark.createDataFrame([("c", 0.1, 0.0), ("a", float("nan"), 0.0), ("b", 0.9, 0.2), ("z", None, None)], "model string, mean_r2 double, std_r2 double")
    got = [(r["position"], r["model"]) for r in chartdata.models_in_order(res, ["a", "b", "z", "c"]).orderBy("position").collect()]
    assert got == [(1, "b"), (2, "c")]


def test_means_and_fit(spark):
    err = spark.createDataFrame([(1.0, None), (3.0, 50.0)], "absolute_error double, relative_error_pct double")
    assert {r["column"]: (r["n"], r["mean"]) for r in chartdata.error_means(err).collect()} == {"absolute_error": (2, 2.0), "relative_error_pct": (1, 50.0)}
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0), (9.0, None), (None, 3.5)], "y double, p double")
    r = chartdata.prediction_fit(df, "y", "p").first()
    assert r["n"] == 3 and r["r2"] == pytest.approx(1 - 1.25 / (14 / 3)) and (r["axis_min"], r["axis_max"]) == (1.0, 9.0)
    assert chartdata.prediction_fit(df.limit(0), "y", "p").first()["n"] == 0
