"""Further chart tables: densities, ranks, outlier points, boxes before and after clipping, models in run order, error means, prediction against truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment, chartdata, models, moments, outliers, score
from ..operators.ordering import written
from ..sources import tables as tb
from .catalog import register, rounded, sql_rounded
from .modelling import FEATS, PLANTED_POSITIVE, SHIFT, TRIO, _aug_sql, _k13_sql, _univariate_sql, chosen, planted_folds
from .preparation import CLIP_COLS, CLIP_SQL, clip_input, clipped_sql
from .scoring import _PRED, _bins_sql, _box_sql, _scored

LI = tb.LINEITEM_COLS


def _screened(spark, sf_dir):
    return models.univariate_cv(planted_folds(spark, sf_dir), FEATS, "y")


def _density_sql() -> str:
    sources = {"original": f"SELECT y FROM {PLANTED_POSITIVE} p", "augmented": f"SELECT y FROM ({_aug_sql([], src=PLANTED_POSITIVE)}) a"}
    parts = [f"""SELECT '{name}' AS rows, {bins} AS bins, bin, lo + bin * w AS bin_start, lo + (bin + 1) * w AS bin_end, count(*) / (any_value(n) * w) AS density FROM (
        SELECT least(floor((y - lo) / w), {bins - 1})::INTEGER AS bin, lo, w, n FROM s_{name}, (
          SELECT min(y) AS lo, (max(y) - min(y)) / {bins} AS w, count(*) AS n FROM s_{name}) r) b GROUP BY bin, lo, w""" for name in sources for bins in (15, 30)]
    made = ", ".join(f"s_{name} AS MATERIALIZED ({sql})" for name, sql in sources.items())
    return sql_rounded(f"WITH {made} " + " UNION ALL ".join(parts), ["bin_start", "bin_end", "density"], ["rows", "bins", "bin"])


@register("m1_target_density", _density_sql())
def m1_target_density(spark, sf_dir):
    """The target's density in 15 and 30 bins, before and after augmentation."""
    p = tb.planted(spark, sf_dir, shift=SHIFT).select("vec_id", "y")
    sources = {"original": p, "augmented": augment.augment(p, "vec_id", [], "y", factor=3, seed=42)}
    parts = [chartdata.density(df, ["y"], bins).select(F.lit(name).alias("rows"), F.lit(bins).alias("bins"), "bin", "bin_start", "bin_end", "density")
             for name, df in sources.items() for bins in (15, 30)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out)


_RANKS = f"(SELECT rank FROM ({_k13_sql()}) x WHERE model IN ({', '.join(repr(c) for c in TRIO)}))"


@register("m1_rank_histogram", sql_rounded(f"""WITH t AS {_RANKS}, r AS (SELECT min(rank)::DOUBLE AS lo, max(rank)::DOUBLE AS hi, least(10, count(*)) AS k FROM t)
    SELECT 'rank' AS "column", bin, lo + bin * (hi - lo) / k AS bin_start, lo + (bin + 1) * (hi - lo) / k AS bin_end, count(*)::BIGINT AS count FROM (
      SELECT CASE WHEN hi > lo THEN least(floor((rank - lo) / ((hi - lo) / k)), k - 1) ELSE 0 END::INTEGER AS bin, lo, hi, k FROM t, r) b
    GROUP BY bin, lo, hi, k""", ["bin_start", "bin_end"], ["column", "bin", "count"]))
def m1_rank_histogram(spark, sf_dir):
    """Places of the selected columns among all columns that were tried alone."""
    board = models.leaderboard(_screened(spark, sf_dir)).where(F.col("model").isin(chosen(spark, sf_dir)))
    return rounded(chartdata.rank_histogram(board))


@register("m2_outlier_points", sql_rounded(" UNION ALL ".join(f"""SELECT o_orderkey, '{c}' AS "column", {c}::DOUBLE AS value FROM {tb.ORDER_FEATURES_SQL} x, (
    SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {tb.ORDER_FEATURES_SQL} y) b
    WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)""" for c in tb.ORDER_FEATURE_COLS), ["value"], ["o_orderkey", "column"]))
def m2_outlier_points(spark, sf_dir):
    return rounded(chartdata.box_points(tb.order_features(spark, sf_dir), "o_orderkey", tb.ORDER_FEATURE_COLS))


def _boxes_sql() -> str:
    classes = " UNION ALL ".join(f"SELECT '{c}' AS c, (SELECT skewness({c}) FROM {CLIP_SQL} z) AS s" for c in CLIP_COLS)
    return f"""SELECT b.*, CASE WHEN abs(s) < 1 THEN 'light_skew' WHEN abs(s) < 2 THEN 'moderate_skew' ELSE 'heavy_skew' END AS skew_class FROM (
      SELECT *, 'before' AS stage FROM ({_box_sql(CLIP_COLS, CLIP_SQL)}) x UNION ALL SELECT *, 'after' FROM ({_box_sql(CLIP_COLS, f'({clipped_sql()})')}) y) b
      JOIN ({classes}) k ON k.c = b."column" """


@register("m2_box_before_after", _boxes_sql())
def m2_box_before_after(spark, sf_dir):
    df = written(clip_input(spark, sf_dir))  # every fit below reads it again
    clipped = outliers.SkewClipper(inputCols=CLIP_COLS).fit(df).transform(df)
    return rounded(chartdata.box_before_after(df, clipped, moments.skew_kurtosis(df, CLIP_COLS), CLIP_COLS))


@register("m11_models_in_order", sql_rounded(f"""SELECT row_number() OVER (ORDER BY substr(model, 2)::INTEGER)::INTEGER AS position, model, mean_r2, std_r2
    FROM ({_univariate_sql(FEATS)}) u WHERE mean_r2 IS NOT NULL AND NOT isnan(mean_r2)""", ["mean_r2", "std_r2"], ["position", "model"]))
def m11_models_in_order(spark, sf_dir):
    return rounded(chartdata.models_in_order(_screened(spark, sf_dir), FEATS))


@register("m13_error_means", sql_rounded(f"""SELECT 'absolute_error' AS "column", count(*)::BIGINT AS n, avg(abs(q - prediction)) AS mean FROM {_PRED} p
    UNION ALL SELECT 'relative_error_pct', count(*) FILTER (WHERE q <> 0)::BIGINT, avg(abs((q - prediction) / q)) FILTER (WHERE q <> 0) * 100 FROM {_PRED} p""", ["mean"], ["column", "n"]))
def m13_error_means(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return rounded(chartdata.error_means(score.error_table(scored, "o_orderkey", "q")))


@register("m16_prediction_bins", _bins_sql("q", "prediction", 50))
def m16_prediction_bins(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return chartdata.binned_pairs(scored, "q", "prediction", 50)


@register("m16_prediction_fit", sql_rounded(f"""SELECT 1 - sum((q - prediction) ** 2) / (var_pop(q) * count(*)) AS r2, count(*)::BIGINT AS n,
    least(min(q), min(prediction)) AS axis_min, greatest(max(q), max(prediction)) AS axis_max FROM {_PRED} p""", ["r2", "axis_min", "axis_max"], ["n"]))
def m16_prediction_fit(spark, sf_dir):
    """R2 with the shared range of prediction and truth."""
    scored, _ = _scored(spark, sf_dir)
    return rounded(chartdata.prediction_fit(scored, "q", "prediction"))
