"""Queries on files, column choices and saved models (A1-A10, B1-B4, L8): tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..operators import correlate, models, profile, score, split, validate
from ..operators.linear import LINEAR_SUITE, fit
from ..operators.sums import gram
from ..session import ensure_checkpoint_dir
from ..sources import files
from ..sources import tables as tb
from .catalog import register, rounded, sql_rounded
from .modelling import FEATS, PLANTED, TRIO, _k13_sql, _univariate_sql, chosen, least_squares_sql, planted_folds
from .scoring import OF, SOF, _split_sql

ORDER_COLS = tb.ORDER_FEATURE_COLS


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


@register("a1_read_table", sql_rounded("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer", ["c_acctbal"], ["c_custkey", "c_nationkey", "c_mktsegment"]))
def a1_read_table(spark, sf_dir):
    """CSV with a given schema, so no pass to infer one; listed columns go, absent ones are ignored."""
    out, customer = _folder(spark, "customer"), tb.table(spark, sf_dir, "customer")
    customer.write.option("header", True).csv(out)
    return rounded(files.read_table(spark, out, "csv", customer.schema, drop=["c_name", "c_phone"]))


@register("a2_training_frame", sql_rounded(f"SELECT o_orderkey, o_totalprice, q, n, d, t, p FROM {OF} x", ["o_totalprice", "q", "d", "t", "p"], ["o_orderkey", "n"]))
def a2_training_frame(spark, sf_dir):
    frame, names = files.training_frame(tb.order_features(spark, sf_dir), "p")
    return rounded(frame.select(*names, "p"))


def _screened(spark, sf_dir, n: int = 5) -> list[str]:
    """The n columns that predict the target best alone."""
    board = models.leaderboard(models.univariate_cv(planted_folds(spark, sf_dir), FEATS, "y"))
    return [r["model"] for r in board.where(F.col("rank") <= n).orderBy("rank").collect()]


def _written_list(spark, sf_dir) -> str:
    out, names = _folder(spark, "features"), _screened(spark, sf_dir)
    listed = files.feature_list_frame(spark, names, [FEATS.index(n) for n in names])
    files.write_report(listed, out, ["rank"])
    return out


@register("a3_feature_list", f"SELECT model AS feature_name, rank::INTEGER AS position, 'file' AS source FROM ({_k13_sql()}) k WHERE rank <= 5")
def a3_feature_list(spark, sf_dir):
    names, source = files.read_feature_list(spark, _written_list(spark, sf_dir), FEATS + ["y"], "y")
    return spark.createDataFrame([(n, i + 1, source) for i, n in enumerate(names)], "feature_name string, position int, source string")


@register("a6_written_feature_list", f"SELECT substr(model, 2)::INTEGER AS feature_index, model AS feature_name, rank::INTEGER AS rank FROM ({_k13_sql()}) k WHERE rank <= 5")
def a6_written_feature_list(spark, sf_dir):
    return files.read_table(spark, _written_list(spark, sf_dir), "csv", "feature_index int, feature_name string, rank int")


@register("a5_selected_table", sql_rounded(f"SELECT {', '.join(TRIO)}, y FROM {PLANTED} p", [*TRIO, "y"], []))
def a5_selected_table(spark, sf_dir):
    out = _folder(spark, "selected")
    files.write_selected(tb.planted(spark, sf_dir), chosen(spark, sf_dir), "y", out)
    return rounded(files.read_table(spark, out))


def _a7_sql() -> str:
    miss = " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS missing FROM {OF} x" for c in ORDER_COLS)
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b" for i, a in enumerate(ORDER_COLS) for b in ORDER_COLS[i + 1:])
    return f"""SELECT 'quality' AS report, row_number() OVER (ORDER BY name)::INTEGER AS position, name FROM ({miss}) m
      UNION ALL SELECT 'correlation', row_number() OVER (ORDER BY a, b)::INTEGER, a || ' ' || b FROM ({pairs}) c
      UNION ALL SELECT 'validation', row_number() OVER (ORDER BY mean_r2 DESC, model)::INTEGER, model FROM ({_univariate_sql(FEATS)}) v"""


@register("a7_result_tables", _a7_sql())
def a7_result_tables(spark, sf_dir):
    """Quality, correlation and validation tables written sorted; each row's place in its file and its name."""
    of, out = tb.order_features(spark, sf_dir), _folder(spark, "results")
    files.write_results({
        "quality": profile.missing_profile(of, ORDER_COLS),
        "correlation": correlate.correlation_long(of, ORDER_COLS),
        "validation": models.univariate_cv(planted_folds(spark, sf_dir), FEATS, "y"),
    }, out)
    shown = {"quality": F.col("column"), "correlation": F.concat_ws(" ", "feature_a", "feature_b"), "validation": F.col("model")}
    parts = [files.read_table(spark, f"{out}/{name}", "csv", None).select(
        F.lit(name).alias("report"), (F.monotonically_increasing_id() + 1).cast("int").alias("position"), what.alias("name")) for name, what in shown.items()]  # one file each
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("a8_json_report", " UNION ALL ".join(f"SELECT 'missing' AS section, '{c}' AS name, (count(*) - count({c}))::BIGINT AS value FROM {OF} x" for c in ORDER_COLS))
def a8_json_report(spark, sf_dir):
    out, of = _folder(spark, "report"), tb.order_features(spark, sf_dir)
    counts = of.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in ORDER_COLS]).first().asDict()
    files.write_json_report(spark, out, {"missing": counts}, {"table": "order_features"})
    back = files.read_json_report(spark, out)["missing"]
    return spark.createDataFrame([("missing", c, n) for c, n in back.items()], "section string, name string, value long")


SPLIT_PLANTED = _split_sql(PLANTED, "vec_id")


def _saved(spark, sf_dir) -> str:
    """Folder of a least-squares model of the selected columns with its metrics, hyper-parameters, importances and test table."""
    out, cols = _folder(spark, "model"), chosen(spark, sf_dir)
    p = split.train_test_split(tb.planted(spark, sf_dir).select("vec_id", *cols, "y"), "vec_id")
    train, test = p.where("split = 'train'"), p.where("split = 'test'")
    g, c = gram(train, [*cols, "y"])
    w, b = fit(g[0], list(range(1, len(cols) + 1)), LINEAR_SUITE[0])
    model = PipelineModel(stages=[score.LinearPredictor(features=cols, coefficients=[float(x) for x in w], intercept=float(c[-1] + b - np.dot(w, c[:-1])))])
    size = spark.createDataFrame([(f, abs(float(x))) for f, x in zip(cols, w)], "feature_name string, importance double")
    files.save_model(model, out, score.performance_metrics(model.transform(test), "y"), cols, {"method": LINEAR_SUITE[0].method, "seed": 42}, size, test)
    return out


_FIT = least_squares_sql(f"(SELECT 1 AS one, * FROM {SPLIT_PLANTED} s WHERE split = 'train')", TRIO, "y", "one")
_SCORED = f"(SELECT vec_id, y, b + {' + '.join(f'w{i} * {c}' for i, c in enumerate(TRIO))} AS prediction FROM {SPLIT_PLANTED} s, ({_FIT}) f WHERE split = 'test')"


@register("a9_saved_parts", sql_rounded(f"""SELECT 'importance' AS part, feature AS name, w AS value FROM (
      {' UNION ALL '.join(f"SELECT '{c}' AS feature, abs(w{i}) AS w FROM ({_FIT}) f" for i, c in enumerate(TRIO))}) i
    UNION ALL SELECT 'metric', 'mae', avg(abs(y - prediction)) FROM {_SCORED} s UNION ALL SELECT 'metric', 'rmse', sqrt(avg((y - prediction) ** 2)) FROM {_SCORED} s
    UNION ALL SELECT 'param', 'seed', 42 UNION ALL SELECT 'test', 'rows', count(*) FROM {_SCORED} s""", ["value"], ["part", "name"]))
def a9_saved_parts(spark, sf_dir):
    """What a saved model holds beside itself, read back."""
    got = files.load_saved(_saved(spark, sf_dir))
    m = got["metrics"].first()
    rows = [("metric", k, float(m[k])) for k in ("mae", "rmse")] + [("param", "seed", float(got["params"]["seed"])), ("test", "rows", float(got["test"].count()))]
    sizes = got["importances"].select(F.lit("importance").alias("part"), F.col("feature_name").alias("name"), F.col("importance").alias("value"))
    return rounded(sizes.unionByName(spark.createDataFrame(rows, "part string, name string, value double")))


@register("a10_loaded_model", sql_rounded(f"SELECT vec_id, prediction FROM {_SCORED} s", ["prediction"], ["vec_id"]))
def a10_loaded_model(spark, sf_dir):
    """The saved test table scored by the loaded model on the loaded columns."""
    got = files.load_saved(_saved(spark, sf_dir))
    return rounded(got["model"].transform(score.prepare(got["test"], got["features"], keep=["vec_id"])).select("vec_id", "prediction"))


@register("b1_numeric_features", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax FROM lineitem")
def b1_numeric_features(spark, sf_dir):
    return validate.numeric_features(tb.table(spark, sf_dir, "lineitem"), "l_quantity")


@register("b2_subset_by_index", sql_rounded(f"SELECT f40, f3, f17 FROM {PLANTED} p", ["f40", "f3", "f17"], []))
def b2_subset_by_index(spark, sf_dir):
    return rounded(validate.subset_by_index(tb.planted(spark, sf_dir), FEATS, [40, 3, 17]))


@register("b3_subset_with_target", sql_rounded(f"SELECT f40, f3, y FROM {PLANTED} p", ["f40", "f3", "y"], []))
def b3_subset_with_target(spark, sf_dir):
    return rounded(validate.subset_by_index(tb.planted(spark, sf_dir), FEATS, [40, 3], "y"))


@register("b4_available_features", sql_rounded(f"SELECT o_orderkey, q, d, 'absent' AS missing FROM {OF} x", ["q", "d"], ["o_orderkey", "missing"]))
def b4_available_features(spark, sf_dir):
    of = tb.order_features(spark, sf_dir)
    have, missing = validate.available_features(of, ["q", "absent", "d"])
    return rounded(of.select("o_orderkey", *have, F.lit(",".join(missing)).alias("missing")))


@register("l8_out_of_range", f"""SELECT s.o_orderkey, coalesce({' OR '.join(f'coalesce(s.{c} < lo_{c} OR s.{c} > hi_{c}, false)' for c in ORDER_COLS)}, false) AS out_of_range
    FROM {SOF} s, (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in ORDER_COLS)} FROM {SOF} t WHERE split = 'train') r WHERE s.split = 'test'""")
def l8_out_of_range(spark, sf_dir):
    """Test rows with any column outside the training range."""
    of = split.train_test_split(tb.order_features(spark, sf_dir), "o_orderkey")
    ranges = score.feature_ranges(of.where("split = 'train'"), ORDER_COLS)
    return score.out_of_range(of.where("split = 'test'"), ranges).select("o_orderkey", "out_of_range")
