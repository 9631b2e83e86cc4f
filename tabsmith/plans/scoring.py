"""Queries for scoring, reports, chart tables, files and checks (L, M, A, B, H7)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..functions.columns import clean
from ..operators import chartdata, correlate, moments, outliers, score, split, validate
from ..operators.linear import LINEAR_SUITE, fit
from ..operators.scale import ZScoreScaler
from ..operators.sums import gram
from ..sources import tables as tb
from .catalog import register, rounded, sql_rounded

OF = tb.ORDER_FEATURES_SQL


def _split_sql(src: str, key: str) -> str:
    return f"""(SELECT t.* EXCLUDE (rn_, rows_), CASE WHEN rn_ <= ceil(0.2 * rows_) THEN 'test' ELSE 'train' END AS split FROM (
      SELECT x.*, row_number() OVER (ORDER BY {split.split_sql(key, 42, 'split')}, {key}) AS rn_, count(*) OVER () AS rows_
      FROM {src} x) t)"""


SOF = _split_sql(OF, "o_orderkey")


def fitted_pipeline(train, x: str = "n", y: str = "q") -> PipelineModel:
    """Training-side chain: z-score of the feature (H7 stage) + least squares from sums."""
    zs = ZScoreScaler(inputCols=[x]).fit(train)
    g, c = gram(zs.transform(train), [x, y])
    w, b = fit(g[0], [1], LINEAR_SUITE[0])
    pred = score.LinearPredictor(features=[x], coefficients=[float(w[0])], intercept=float(c[1] + b - w[0] * c[0]))
    return PipelineModel(stages=[zs, pred])


def _scored(spark, sf_dir):
    of = split.train_test_split(tb.order_features(spark, sf_dir), "o_orderkey").filter(F.col("q").isNotNull())
    model = fitted_pipeline(of.filter(F.col("split") == "train"))
    test = of.filter(F.col("split") == "test")
    return model.transform(score.prepare(test, ["n"], keep=["o_orderkey", "q"])), model


_PRED = f"""(SELECT s.o_orderkey, s.q, a + b * s.n AS prediction FROM {SOF} s,
  (SELECT regr_intercept(q, n) AS a, regr_slope(q, n) AS b FROM {SOF} t WHERE split = 'train' AND q IS NOT NULL) m
  WHERE s.split = 'test' AND s.q IS NOT NULL)"""


@register("l2_prediction_summary", sql_rounded(
    f"SELECT count(prediction)::BIGINT AS n, avg(prediction) AS mean, stddev_pop(prediction) AS std, min(prediction) AS min, max(prediction) AS max FROM {_PRED} p",
    ["mean", "std", "min", "max"], ["n"]))
def l2_prediction_summary(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return rounded(score.prediction_summary(scored))


@register("l3_performance_metrics", sql_rounded(
    f"""SELECT 1 - sum((q - prediction) * (q - prediction)) / (var_pop(q) * count(*)) AS r2, sqrt(avg((q - prediction) * (q - prediction))) AS rmse,
      avg(abs(q - prediction)) AS mae, coalesce(avg(abs((q - prediction) / q)) FILTER (WHERE q <> 0) * 100, 'inf'::DOUBLE) AS mape,
      avg(q - prediction) AS mean_residual, stddev_pop(q - prediction) AS std_residual, corr(q, prediction) AS correlation,
      count(*)::BIGINT AS n FROM {_PRED} p""",
    ["r2", "rmse", "mae", "mape", "mean_residual", "std_residual", "correlation"], ["n"]))
def l3_performance_metrics(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return rounded(score.performance_metrics(scored, "q"))


@register("l4_error_table", sql_rounded(
    f"""SELECT o_orderkey, q::DOUBLE AS true_value, prediction AS predicted_value, q - prediction AS residual, abs(q - prediction) AS absolute_error,
      CASE WHEN q <> 0 THEN abs((q - prediction) / q) * 100 END AS relative_error_pct FROM {_PRED} p""",
    ["true_value", "predicted_value", "residual", "absolute_error", "relative_error_pct"], ["o_orderkey"]))
def l4_error_table(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return rounded(score.error_table(scored, "o_orderkey", "q"))


_GRADE_SQL = "CASE WHEN prediction >= 20 THEN 'high' WHEN prediction >= 15 THEN 'medium-high' WHEN prediction >= 10 THEN 'medium' ELSE 'low' END"


@register("l7_grade_batch", f"SELECT {_GRADE_SQL} AS grade, count(*)::BIGINT AS n FROM {_PRED} p GROUP BY 1")
def l7_grade_batch(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return scored.groupBy(score.grade("prediction").alias("grade")).agg(F.count(F.lit(1)).alias("n"))


@register("l7_grade_stream", f"""SELECT {_GRADE_SQL} AS grade, count(*)::BIGINT AS n FROM (
    SELECT a + b * s.n AS prediction FROM {OF} s, (SELECT regr_intercept(q, n) AS a, regr_slope(q, n) AS b FROM {SOF} t
    WHERE split = 'train' AND q IS NOT NULL) m WHERE s.n IS NOT NULL) p GROUP BY 1""")
def l7_grade_stream(spark, sf_dir):
    """Orders arrive as a file stream; a stream-static join adds the per-order line counts,
    then the saved batch chain scores and grades each micro-batch."""
    from ..streaming.scoring import run_to_table

    of = split.train_test_split(tb.order_features(spark, sf_dir), "o_orderkey").filter(F.col("q").isNotNull())
    model = fitted_pipeline(of.filter(F.col("split") == "train"))
    lines = tb.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    schema = tb.table(spark, sf_dir, "orders").schema
    # a glob keeps the source a directory listing even though the table is a single file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir.rstrip('/')}/orders*.parquet")
    joined = stream.select("o_orderkey").join(lines, "o_orderkey")
    scored = model.transform(joined).withColumn("grade", score.grade("prediction"))
    import uuid

    out = run_to_table(scored, f"l7_stream_{uuid.uuid4().hex[:12]}")
    return out.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


@register("l8_feature_ranges", sql_rounded(
    f"""SELECT 'n' AS feature, min(n)::DOUBLE AS min, max(n)::DOUBLE AS max, (min(n) + max(n)) / 2.0 AS "default" FROM {SOF} s WHERE split = 'train'""",
    ["min", "max", "default"], ["feature"]))
def l8_feature_ranges(spark, sf_dir):
    of = split.train_test_split(tb.order_features(spark, sf_dir), "o_orderkey")
    return rounded(score.feature_ranges(of.filter(F.col("split") == "train"), ["n"]))


@register("h7_standardize_scoring", sql_rounded(
    f"""SELECT s.o_orderkey, (s.n - m) / sd AS n FROM {SOF} s, (SELECT avg(n) AS m, stddev_samp(n) AS sd FROM {SOF} t WHERE split = 'train') z
      WHERE s.split = 'test'""", ["n"], ["o_orderkey"]))
def h7_standardize_scoring(spark, sf_dir):
    of = split.train_test_split(tb.order_features(spark, sf_dir), "o_orderkey")
    zs = ZScoreScaler(inputCols=["n"]).fit(of.filter(F.col("split") == "train"))
    return rounded(zs.transform(of.filter(F.col("split") == "test").select("o_orderkey", clean("n").alias("n"))))


# ---------------------------------------------------------------- chart tables
LI = tb.LINEITEM_COLS


def _hist_sql(cols, bins=20) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", bin, lo + bin * (hi - lo) / {bins} AS bin_start, lo + (bin + 1) * (hi - lo) / {bins} AS bin_end,
          count(*)::BIGINT AS count FROM (SELECT CASE WHEN hi > lo THEN least(floor(({c} - lo) / ((hi - lo) / {bins})), {bins - 1}) ELSE 0 END::INTEGER AS bin, lo, hi
          FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) r WHERE {c} IS NOT NULL) b GROUP BY bin, lo, hi""")
    return sql_rounded("\nUNION ALL\n".join(parts), ["bin_start", "bin_end"], ["column", "bin", "count"])


@register("m1_histogram", _hist_sql(LI))
def m1_histogram(spark, sf_dir):
    return rounded(chartdata.histogram(tb.table(spark, sf_dir, "lineitem"), LI))


def _box_sql(cols, src: str = "lineitem") -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", q1, med AS median, q3,
          min({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
          max({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
          count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::BIGINT AS outliers
          FROM {src} t, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3 FROM {src} u) b
          GROUP BY q1, med, q3""")
    return sql_rounded("\nUNION ALL\n".join(parts), ["q1", "median", "q3", "whisker_low", "whisker_high"], ["column", "outliers"])


@register("m2_box_summary", _box_sql(LI))
def m2_box_summary(spark, sf_dir):
    return rounded(chartdata.box_summary(tb.table(spark, sf_dir, "lineitem"), LI))


def _before_after(measure: str) -> str:
    """feature, before, after: a measure with the column in place of ``{c}``, of the clip columns and their clipped values."""
    from .preparation import CLIP_COLS, CLIP_SQL, clipped_sql

    of = lambda src, c: f"(SELECT {measure.format(c=c)} FROM {src} z)"
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {of(CLIP_SQL, c)} AS before, {of(f'({clipped_sql()})', c)} AS after" for c in CLIP_COLS)


def _m3_sql() -> str:
    def part(label: str, group: str) -> str:
        return f"""SELECT {label} AS skew_class, count(*)::BIGINT AS n, count(*) FILTER (WHERE d > 0)::BIGINT AS improved,
          count(*) FILTER (WHERE d < 0)::BIGINT AS worse, round(avg(d), 6) AS mean_improvement,
          arg_max(feature, d) AS best_feature, arg_min(feature, d) AS worst_feature FROM i {group}"""

    return f"""WITH i AS (SELECT feature, CASE WHEN abs(before) < 1 THEN 'light_skew' WHEN abs(before) < 2 THEN 'moderate_skew' ELSE 'heavy_skew' END AS c,
        abs(before) - abs(after) AS d FROM ({_before_after('skewness({c})')}) z)
      {part('c', 'GROUP BY c')} UNION ALL {part("'all'", '')}"""


@register("m3_skew_improvement", _m3_sql())
def m3_skew_improvement(spark, sf_dir):
    from .preparation import CLIP_COLS, clip_input

    df = clip_input(spark, sf_dir)
    clipped = outliers.SkewClipper(inputCols=CLIP_COLS).fit(df).transform(df)
    imp = chartdata.skew_improvement(moments.skew_kurtosis(df, CLIP_COLS), moments.skew_kurtosis(clipped, CLIP_COLS))
    return rounded(chartdata.skew_improvement_summary(imp))


_M6_SQL = """WITH e AS (SELECT epoch_us(ts) / 3.6e9 - 473352.0 AS x, value AS y FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
  s AS (SELECT covar_pop(x, x) AS a, covar_pop(x, x * x) AS b, covar_pop(x * x, x * x) AS d, covar_pop(x, y) AS u, covar_pop(x * x, y) AS v,
      avg(x) AS mx, avg(x * x) AS mxx, avg(y) AS my FROM e HAVING count(*) > 10),
  w AS (SELECT *, (u * d - b * v) / (a * d - b * b) AS w1, (a * v - b * u) / (a * d - b * b) AS w2 FROM s)
  SELECT round(my - w1 * mx - w2 * mxx, 6) AS a, round(w1, 8) AS b, round(w2, 10) AS c FROM w"""


@register("m6_quadratic_trend", _M6_SQL)
def m6_quadratic_trend(spark, sf_dir):
    ev = tb.table(spark, sf_dir, "events").withColumn("t_hours", F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - F.lit(473352.0))
    r = chartdata.quadratic_trend(ev, "t_hours", "value")
    out = spark.createDataFrame([(r["a"], r["b"], r["c"])] if r else [], "a double, b double, c double")
    return out.select(F.round("a", 6).alias("a"), F.round("b", 8).alias("b"), F.round("c", 10).alias("c"))


@register("m7_series_summary", sql_rounded(
    """SELECT avg(value) AS mean, stddev_pop(value) AS std, max(value) AS max, min(value) AS min, max(value) - min(value) AS range,
      (SELECT avg(value) FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 10)) AS mean_last FROM events""",
    ["mean", "std", "max", "min", "range", "mean_last"], []))
def m7_series_summary(spark, sf_dir):
    ev = tb.table(spark, sf_dir, "events").withColumn("_o", F.struct("ts", "event_id"))
    return rounded(chartdata.series_summary(ev, "value", "_o", 10))


def _importance_and_selection(spark, sf_dir):
    from ..operators import models
    from .modelling import FEATS, chosen

    imp = models.feature_importance(tb.planted(spark, sf_dir), FEATS, "y", num_trees=100)
    sel = spark.createDataFrame([(f,) for f in chosen(spark, sf_dir)], "feature_name string")
    return imp, sel


@register("m8_importance_overlap")
def m8_importance_overlap(spark, sf_dir):
    imp, sel = _importance_and_selection(spark, sf_dir)
    return chartdata.importance_overlap(imp, sel)


@register("m9_importance_selected")
def m9_importance_selected(spark, sf_dir):
    imp, sel = _importance_and_selection(spark, sf_dir)
    return chartdata.importance_with_selection(imp, sel)


def _screen(spark, sf_dir):
    from ..operators import models
    from .modelling import FEATS, planted_folds

    return models.univariate_cv(planted_folds(spark, sf_dir), FEATS, "y")


@register("m10_metric_normalisation")
def m10_metric_normalisation(spark, sf_dir):
    return rounded(chartdata.normalise_metrics(_screen(spark, sf_dir), ["mean_r2"], ["mean_mae", "mean_rmse"]))


@register("m11_model_ranking")
def m11_model_ranking(spark, sf_dir):
    return rounded(chartdata.model_ranking(_screen(spark, sf_dir)))


@register("m12_qq_points")
def m12_qq_points(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    res = scored.withColumn("residual", F.col("q") - F.col("prediction"))
    return rounded(chartdata.qq_points(res, "residual", 50))


def _bins_sql(x: str, y: str, bins: int) -> str:
    bin_ = lambda c: f"least(floor(({c} - lo) / w), {bins - 1})::INTEGER"
    return f"""WITH p AS (SELECT q, prediction, q - prediction AS residual FROM {_PRED} z),
      r AS (SELECT least(min({x}), min({y})) AS lo, (greatest(max({x}), max({y})) - least(min({x}), min({y}))) / {bins} AS w FROM p)
      SELECT {bin_(x)} AS bx, {bin_(y)} AS "by", count(*)::BIGINT AS count FROM p, r GROUP BY ALL"""


@register("m12_residual_bins", _bins_sql("prediction", "residual", 25))
def m12_residual_bins(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return chartdata.binned_pairs(scored.withColumn("residual", F.col("q") - F.col("prediction")), "prediction", "residual", 25)


@register("m12_residual_truth_bins", _bins_sql("q", "residual", 25))
def m12_residual_truth_bins(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return chartdata.binned_pairs(scored.withColumn("residual", F.col("q") - F.col("prediction")), "q", "residual", 25)


def _residuals(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return scored.withColumn("residual", F.col("q") - F.col("prediction"))


@register("l4_error_index", sql_rounded(
    f"SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS index, q - prediction AS residual FROM {_PRED} p", ["residual"], ["o_orderkey", "index"]))
def l4_error_index(spark, sf_dir):
    return rounded(chartdata.row_index(_residuals(spark, sf_dir), "o_orderkey").select("o_orderkey", "index", "residual"))


_INDEX_BINS = f"""WITH p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, q - prediction AS residual FROM {_PRED} z),
  r AS (SELECT min(i) AS x0, (max(i) - min(i)) / 50.0 AS wx, min(residual) AS y0, (max(residual) - min(residual)) / 25 AS wy FROM p)
  SELECT least(floor((i - x0) / wx), 49)::INTEGER AS bx, least(floor((residual - y0) / wy), 24)::INTEGER AS "by", count(*)::BIGINT AS count FROM p, r GROUP BY ALL"""


@register("m12_residual_index_bins", _INDEX_BINS)
def m12_residual_index_bins(spark, sf_dir):
    """Residual against the row index: the index of every row, and 2-D counts in place of one point per row."""
    return chartdata.binned_xy(chartdata.row_index(_residuals(spark, sf_dir), "o_orderkey"), "index", "residual", 50, 25)


@register("m12_residual_histogram", sql_rounded(
    f"""WITH e AS MATERIALIZED (SELECT q - prediction AS residual FROM {_PRED} p) SELECT 'residual' AS "column", bin, lo + bin * (hi - lo) / 20 AS bin_start,
      lo + (bin + 1) * (hi - lo) / 20 AS bin_end, count(*)::BIGINT AS count FROM (
      SELECT CASE WHEN hi > lo THEN least(floor((residual - lo) / ((hi - lo) / 20)), 19) ELSE 0 END::INTEGER AS bin, lo, hi
      FROM e, (SELECT min(residual) AS lo, max(residual) AS hi FROM e) r) b GROUP BY bin, lo, hi""", ["bin_start", "bin_end"], ["column", "bin", "count"]))
def m12_residual_histogram(spark, sf_dir):
    return rounded(chartdata.histogram(_residuals(spark, sf_dir), ["residual"], 20))


@register("m13_error_histogram")
def m13_error_histogram(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return rounded(chartdata.histogram(score.error_table(scored, "o_orderkey", "q"), ["absolute_error", "relative_error_pct"], 20))


@register("m14_augmentation_comparison")
def m14_augmentation_comparison(spark, sf_dir):
    from ..operators import augment
    from .modelling import FEATS

    p = tb.planted(spark, sf_dir)
    a = augment.augment(p, "vec_id", FEATS[:8], "y")
    return rounded(chartdata.augmentation_comparison(p, a, FEATS[:8]))


@register("m15_test_level", """SELECT CASE WHEN r2 >= 0.8 THEN 'excellent' WHEN r2 >= 0.6 THEN 'good' WHEN r2 >= 0.4 THEN 'fair' ELSE 'poor' END AS level
  FROM (SELECT 1 - sum((q - prediction) * (q - prediction)) / (var_pop(q) * count(*)) AS r2 FROM """ + _PRED + " p) x")
def m15_test_level(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return score.performance_metrics(scored, "q").select(chartdata.test_level(F.col("r2")).alias("level"))


@register("m16_axis_range", sql_rounded(
    f"""SELECT lo - 0.05 * (hi - lo) AS axis_min, hi + 0.05 * (hi - lo) AS axis_max FROM (
      SELECT least(min(q), min(prediction)) AS lo, greatest(max(q), max(prediction)) AS hi FROM {_PRED} p) x""",
    ["axis_min", "axis_max"], []))
def m16_axis_range(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return rounded(chartdata.axis_range(scored, "q", "prediction"))


# ---------------------------------------------------------------- checks
@register("b8_matrix_check", """SELECT 'l_quantity' AS "column", count(*) FILTER (WHERE l_quantity IS NULL OR isnan(l_quantity))::BIGINT AS missing,
    count(*) FILTER (WHERE abs(l_quantity) = 'inf'::DOUBLE)::BIGINT AS infinite, coalesce(stddev_pop(l_quantity) = 0, true) AS zero_variance FROM lineitem
  UNION ALL SELECT 'l_extendedprice', count(*) FILTER (WHERE l_extendedprice IS NULL OR isnan(l_extendedprice))::BIGINT,
    count(*) FILTER (WHERE abs(l_extendedprice) = 'inf'::DOUBLE)::BIGINT, coalesce(stddev_pop(l_extendedprice) = 0, true) FROM lineitem""")
def b8_matrix_check(spark, sf_dir):
    return validate.matrix_check(tb.table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")


def _b10_sql() -> str:
    change = lambda x: f"coalesce(abs({x}_after - {x}_before) * 100 / nullif(abs({x}_before), 0), 0) AS {x}_change_pct"
    body = f"""SELECT * FROM (SELECT m.feature AS "column", m.before AS mean_before, m.after AS mean_after, {change('mean')},
        s.before AS std_before, s.after AS std_after, {change('std')}
      FROM ({_before_after('avg({c})')}) m JOIN ({_before_after('stddev_samp({c})')}) s ON m.feature = s.feature) x
      WHERE mean_change_pct > 1 OR std_change_pct > 5"""
    return sql_rounded(body, ["mean_before", "mean_after", "mean_change_pct", "std_before", "std_after", "std_change_pct"], ["column"])


@register("b10_clip_change_report", _b10_sql())
def b10_clip_change_report(spark, sf_dir):
    from .preparation import CLIP_COLS, clip_input

    df = clip_input(spark, sf_dir)
    clipped = outliers.SkewClipper(inputCols=CLIP_COLS).fit(df).transform(df)
    return rounded(validate.change_report(df, clipped, CLIP_COLS))


@register("a4_write_read_splits", f"SELECT split, count(*)::BIGINT AS n FROM {SOF} s GROUP BY split")
def a4_write_read_splits(spark, sf_dir):
    """A4/A7/A1 round trip: split table written partitioned by split into the shared
    checkpoint folder and read back with partition pruning on split."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import files

    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/splits-{uuid.uuid4().hex}"
    of = split.train_test_split(tb.order_features(spark, sf_dir), "o_orderkey")
    files.write_splits(of, out)
    back = files.read_table(spark, out)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("e6_high_pairs_wide")
def e6_high_pairs_wide(spark, sf_dir):
    from .modelling import FEATS

    corr = correlate.correlation_long(tb.planted(spark, sf_dir), FEATS + ["y"])
    return rounded(correlate.strong_pairs(corr, 0.3, top=None))



# ---------------------------------------------------------------- oracles for tables built on SQL-expressible inputs
def _add_sql(name: str, sql: str) -> None:
    from .catalog import REGISTRY

    fn, _ = REGISTRY[name]
    REGISTRY[name] = (fn, sql)


def _late_oracles() -> None:
    from . import modelling as md

    uni = md._univariate_sql(md.FEATS)
    _add_sql("m10_metric_normalisation", sql_rounded(
        f"""SELECT *, CASE WHEN max(mean_r2) OVER () > min(mean_r2) OVER () THEN (mean_r2 - min(mean_r2) OVER ()) / (max(mean_r2) OVER () - min(mean_r2) OVER ()) ELSE 0.5 END AS mean_r2_norm,
          1 - CASE WHEN max(mean_mae) OVER () > min(mean_mae) OVER () THEN (mean_mae - min(mean_mae) OVER ()) / (max(mean_mae) OVER () - min(mean_mae) OVER ()) ELSE 0.5 END AS mean_mae_norm,
          1 - CASE WHEN max(mean_rmse) OVER () > min(mean_rmse) OVER () THEN (mean_rmse - min(mean_rmse) OVER ()) / (max(mean_rmse) OVER () - min(mean_rmse) OVER ()) ELSE 0.5 END AS mean_rmse_norm
          FROM ({uni}) u""",
        md.K9_COLS + ["mean_r2_norm", "mean_mae_norm", "mean_rmse_norm"], ["model"]))
    _add_sql("m11_model_ranking", sql_rounded(
        f"SELECT model, mean_r2, std_r2, min_r2, max_r2, max_r2 - min_r2 AS spread FROM ({uni}) u WHERE mean_r2 IS NOT NULL AND NOT isnan(mean_r2)",
        ["mean_r2", "std_r2", "min_r2", "max_r2", "spread"], ["model"]))
    from .profiling import _e1_wide_sql_raw

    _add_sql("e6_high_pairs_wide", sql_rounded(
        f"SELECT feature_a, feature_b, pos_a, pos_b, n, r FROM (SELECT *, (SELECT count(*) FROM {md.PLANTED} p)::BIGINT AS n FROM ({_e1_wide_sql_raw(md.FEATS + ['y'])}) c) x WHERE abs(r) > 0.3",
        ["r"], ["feature_a", "feature_b", "pos_a", "pos_b", "n"]))
    errs = f"""(SELECT abs(q - prediction) AS absolute_error, CASE WHEN q <> 0 THEN abs((q - prediction) / q) * 100 END AS relative_error_pct FROM {_PRED} p)"""
    parts = []
    for c in ["absolute_error", "relative_error_pct"]:
        parts.append(f"""SELECT '{c}' AS "column", bin, lo + bin * (hi - lo) / 20 AS bin_start, lo + (bin + 1) * (hi - lo) / 20 AS bin_end, count(*)::BIGINT AS count
          FROM (SELECT CASE WHEN hi > lo THEN least(floor(({c} - lo) / ((hi - lo) / 20)), 19) ELSE 0 END::INTEGER AS bin, lo, hi
                FROM e, (SELECT min({c}) AS lo, max({c}) AS hi FROM e) r WHERE {c} IS NOT NULL) b GROUP BY bin, lo, hi""")
    # one materialised copy: two evaluations of a parallel regression may differ in the last bit
    _add_sql("m13_error_histogram", sql_rounded(f"WITH e AS MATERIALIZED {errs} " + "\nUNION ALL\n".join(parts), ["bin_start", "bin_end"],
                                                ["column", "bin", "count"]))
    feats = md.FEATS[:8]
    aug = md._aug_sql(feats)
    parts = []
    for c in feats:
        parts.append(f"""SELECT '{c}' AS feature, (SELECT count(*) FROM {md.PLANTED} o)::BIGINT AS n_original, count(*)::BIGINT AS n_augmented,
          (SELECT avg({c}) FROM {md.PLANTED} o) AS mean_original, avg({c}) AS mean_augmented,
          (SELECT stddev_samp({c}) FROM {md.PLANTED} o) AS std_original, stddev_samp({c}) AS std_augmented FROM a""")
    _add_sql("m14_augmentation_comparison", sql_rounded(f"WITH a AS ({aug}) " + "\nUNION ALL\n".join(parts),
                                                        ["mean_original", "mean_augmented", "std_original", "std_augmented"],
                                                        ["feature", "n_original", "n_augmented"]))


_late_oracles()


# ---------------------------------------------------------------- checks B5, B7, B9 and strategy dispatch F7
_OF_COLS = ["o_orderkey"] + tb.ORDER_FEATURE_COLS


@register("b5_integrity", "SELECT count(*)::BIGINT AS rows, (" + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL OR isnan({c}::DOUBLE))" for c in _OF_COLS)
          + f")::BIGINT AS missing FROM {OF} x")
def b5_integrity(spark, sf_dir):
    r = validate.integrity(tb.order_features(spark, sf_dir), "order_features")
    return spark.createDataFrame([(r["rows"], r["missing"])], "rows long, missing long")


@register("b7_range_check", "SELECT count(*) FILTER (WHERE c_acctbal < 0)::BIGINT AS negative_target FROM customer")
def b7_range_check(spark, sf_dir):
    cu = tb.table(spark, sf_dir, "customer")
    r = validate.range_check(cu, ["c_acctbal"], target="c_acctbal")
    return spark.createDataFrame([(r["negative_target"],)], "negative_target long")


@register("b9_imputation_check", f"""SELECT count(*)::BIGINT AS rows_before, count(*)::BIGINT AS rows_after, true AS shape_ok,
    ({' + '.join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in ['q', 'p', 'n', 'd', 't'])})::BIGINT AS missing_before, 0::BIGINT AS missing_after FROM {OF} x""")
def b9_imputation_check(spark, sf_dir):
    from ..operators import impute

    of = tb.order_features(spark, sf_dir)
    filled, _ = impute.mean_fill(of, ["q", "p", "n", "d", "t"])
    r = impute.imputation_check(of, filled, ["q", "p", "n", "d", "t"])
    return spark.createDataFrame([(r["rows_before"], r["rows_after"], r["shape_ok"], r["missing_before"], r["missing_after"])],
                                 "rows_before long, rows_after long, shape_ok boolean, missing_before long, missing_after long")


@register("f7_apply_strategy")
def f7_apply_strategy(spark, sf_dir):
    """F6 picks a strategy per column and F7 applies it; preconditions that fail fall back to mean with the reason."""
    from ..operators import impute
    from ..operators.ordering import written

    of = written(tb.order_features(spark, sf_dir))
    rows = []
    for c in ["q", "p", "n", "d", "t"]:
        strat = impute.choose_strategy(of, c)
        out, used = impute.apply_strategy(of, c, strat, key="o_orderkey")
        rows.append((c, strat, used, out.filter(F.col(c).isNull()).count()))
    return spark.createDataFrame(rows, "feature string, chosen string, applied string, missing_after long")


# ---------------------------------------------------------------- fills fitted on train, applied to test
def _gap_sql(c: str) -> str:
    return f"""(SELECT s.* REPLACE (CASE WHEN {split.split_sql('o_orderkey', 42, 'gap')} % 5 = 0 THEN NULL ELSE {c}::DOUBLE END AS {c}) FROM {SOF} s WHERE n IS NOT NULL)"""


def _with_gaps(spark, sf_dir, c: str):
    """The split orders that have lines, with every fifth value of one column taken out by the key's hash."""
    of = split.train_test_split(tb.order_features(spark, sf_dir), "o_orderkey").where("n IS NOT NULL")
    return of.withColumn(c, F.when(split.keyed_hash("o_orderkey", 42, "gap") % 5 != 0, F.col(c).cast("double")))


def _saved_and_loaded(model):
    """The model after a round trip through the shared folder."""
    import uuid

    from pyspark.sql import SparkSession

    from ..operators.fill_models import GapFillerModel
    from ..session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(SparkSession.active()).rstrip('/')}/models/fill-{uuid.uuid4().hex}"
    model.write().save(path)
    return GapFillerModel.load(path)


def _fill_test(spark, sf_dir, **kw):
    from ..operators.fill_models import GapFiller

    of = _with_gaps(spark, sf_dir, "q")
    model = _saved_and_loaded(GapFiller(inputCols=["q"], keyCol="o_orderkey", **kw).fit(of.where("split = 'train'")))
    test = of.where("split = 'test'")
    return rounded(model.transform(test.select("o_orderkey", "q", "p", "n")).select("o_orderkey", "q"))


@register("f1_fill_model", sql_rounded(
    f"""SELECT o_orderkey, coalesce(q, a + b * n) AS q FROM {_gap_sql('q')} s, (SELECT regr_intercept(q, n) AS a, regr_slope(q, n) AS b FROM {_gap_sql('q')} t WHERE split = 'train') m
      WHERE split = 'test'""", ["q"], ["o_orderkey"]))
def f1_fill_model(spark, sf_dir):
    """Regression of the training orders, saved, loaded and applied to the test orders."""
    return _fill_test(spark, sf_dir, strategy="regression", predictor="n")


@register("f3_fill_model", sql_rounded(
    f"SELECT o_orderkey, coalesce(q, (SELECT avg(q) FROM {_gap_sql('q')} t WHERE split = 'train')) AS q FROM {_gap_sql('q')} s WHERE split = 'test'", ["q"], ["o_orderkey"]))
def f3_fill_model(spark, sf_dir):
    return _fill_test(spark, sf_dir, strategy="mean")


@register("f9_fill_model")
def f9_fill_model(spark, sf_dir):
    """Neighbours among the training orders over quantity, price and lines."""
    return _fill_test(spark, sf_dir, strategy="knn", referenceCols=["p", "n"], k=5)


@register("f8_multi_regression")
def f8_multi_regression(spark, sf_dir):
    """Three predictors that are present where the target is missing."""
    from ..operators import impute

    of = _with_gaps(spark, sf_dir, "q").drop("split", "o_orderkey", "t", "d")
    out, report = impute.multi_regression_fill(of, "q")
    terms = [("intercept", report["intercept"]), *zip(report["predictors"], report["coef"]), ("missing_after", float(out.where("q IS NULL").count()))]
    return spark.createDataFrame([(t, float(v)) for t, v in terms], "term string, value double")
