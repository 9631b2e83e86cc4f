"""Queries for the profile, moments and correlation operators (C, D, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate, moments, profile
from ..sources import tables as tb
from .catalog import register, rounded, sql_rounded

OF = tb.ORDER_FEATURES_SQL
OF_COLS = tb.ORDER_FEATURE_COLS
LI = tb.LINEITEM_COLS
PLANTED_COLS = [f"f{i}" for i in range(tb.N_DIMS)]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _miss(c: str) -> str:
    return f'("{c}" IS NULL OR isnan(CAST("{c}" AS DOUBLE)))'


def _skew(c: str) -> str:
    return f'skewness("{c}")'


def _kurt(c: str) -> str:
    return f'kurtosis("{c}")'


# ---------------------------------------------------------------- C1
C1_SQL = f"""SELECT count(*)::BIGINT AS n_rows, 7::BIGINT AS n_columns, 7::BIGINT AS n_numeric,
  0::BIGINT AS n_string, 0::BIGINT AS n_other FROM {OF} t"""


@register("c1_basic_info", C1_SQL)
def c1_basic_info(spark, sf_dir):
    return profile.basic_info(tb.order_features(spark, sf_dir))


# ---------------------------------------------------------------- C2
_OF_ALL = ["o_orderkey"] + OF_COLS
C2_SQL = sql_rounded(
    _union([f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {_miss(c)})::BIGINT AS missing_count, "
            f"100.0 * count(*) FILTER (WHERE {_miss(c)}) / count(*) AS missing_pct FROM {OF} t" for c in _OF_ALL]),
    ["missing_pct"], ["column", "missing_count"])


@register("c2_missing", C2_SQL)
def c2_missing(spark, sf_dir):
    return rounded(profile.missing_profile(tb.order_features(spark, sf_dir)))


# ---------------------------------------------------------------- C3
C3_SQL = sql_rounded(
    _union([f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} = 0)::BIGINT AS zero_count, "
            f"100.0 * count(*) FILTER (WHERE {c} = 0) / count(*) AS zero_pct FROM lineitem" for c in LI]),
    ["zero_pct"], ["column", "zero_count"])


@register("c3_zeros", C3_SQL)
def c3_zeros(spark, sf_dir):
    return rounded(profile.zero_profile(tb.table(spark, sf_dir, "lineitem"), LI))


# ---------------------------------------------------------------- C4
def _c4_sql() -> str:
    sev = " + ".join(f"(abs(skewness({c})) > 2)::BIGINT" for c in OF_COLS)
    mod = " + ".join(f"(abs(skewness({c})) > 1 AND abs(skewness({c})) <= 2)::BIGINT" for c in OF_COLS)
    return f"SELECT ({sev})::BIGINT AS severe_skew, ({mod})::BIGINT AS moderate_skew FROM {OF} t"


@register("c4_skew_bands", _c4_sql())
def c4_skew_bands(spark, sf_dir):
    return profile.skew_bands(tb.order_features(spark, sf_dir), OF_COLS)


# ---------------------------------------------------------------- C5
C5_SQL = sql_rounded(
    _union([f"SELECT '{c}' AS \"column\", min({c}) AS min, max({c}) AS max, avg({c}) AS mean, "
            f"stddev_samp({c}) AS std, max({c}) - min({c}) AS range FROM lineitem" for c in LI]),
    ["min", "max", "mean", "std", "range"], ["column"])


@register("c5_ranges", C5_SQL)
def c5_ranges(spark, sf_dir):
    return rounded(profile.value_ranges(tb.table(spark, sf_dir, "lineitem"), LI))


# ---------------------------------------------------------------- C6
def _c6_sql() -> str:
    miss = " + ".join(f"count(*) FILTER (WHERE {_miss(c)})" for c in _OF_ALL)
    zeros = " + ".join(f"count(*) FILTER (WHERE {c} = 0)" for c in _OF_ALL)
    sev = " + ".join(f"coalesce((abs(skewness({c})) > 2)::INT, 0)" for c in _OF_ALL)
    mod = " + ".join(f"coalesce((abs(skewness({c})) > 1 AND abs(skewness({c})) <= 2)::INT, 0)" for c in _OF_ALL)
    inner = f"""SELECT count(*)::DOUBLE AS rows_, ({miss})::DOUBLE AS miss, ({zeros})::DOUBLE AS zeros,
      ({sev})::DOUBLE AS sev, ({mod})::DOUBLE AS modr FROM {OF} t"""
    body = f"""WITH s AS ({inner})
    SELECT 'rows' AS metric, rows_ AS value FROM s UNION ALL
    SELECT 'columns', 7.0 FROM s UNION ALL
    SELECT 'missing_cells', miss FROM s UNION ALL
    SELECT 'missing_pct', miss * 100.0 / (rows_ * 7) FROM s UNION ALL
    SELECT 'zero_cells', zeros FROM s UNION ALL
    SELECT 'severe_skew_features', sev FROM s UNION ALL
    SELECT 'moderate_skew_features', modr FROM s UNION ALL
    SELECT 'numeric_columns', 7.0 FROM s"""
    return sql_rounded(body, ["value"], ["metric"])


@register("c6_quality_summary", _c6_sql())
def c6_quality_summary(spark, sf_dir):
    return rounded(profile.quality_summary(tb.order_features(spark, sf_dir)))


# ---------------------------------------------------------------- C7
def _c7_sql() -> str:
    parts = []
    for c in LI:
        parts.append(f"""SELECT '{c}' AS "column",
          count(*) FILTER (WHERE {c} IS NULL OR isnan({c}))::BIGINT AS missing,
          count(*) FILTER (WHERE abs({c}) = 'inf'::DOUBLE)::BIGINT AS infinite,
          coalesce(stddev_pop({c}) = 0, true) AS zero_variance,
          (SELECT count(*) FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) b
            WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::BIGINT AS iqr_outliers
          FROM lineitem""")
    return _union(parts)


@register("c7_quality_check", _c7_sql())
def c7_quality_check(spark, sf_dir):
    return profile.quality_check(tb.table(spark, sf_dir, "lineitem"), LI)


# ---------------------------------------------------------------- C8
C8_SQL = sql_rounded(
    _union([f"""SELECT '{c}' AS "column", avg({c}) AS mean, stddev_pop({c}) AS std, min({c})::DOUBLE AS min,
      max({c})::DOUBLE AS max, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.25) AS q25,
      quantile_cont({c}, 0.75) AS q75, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis FROM {OF} t""" for c in OF_COLS]),
    ["mean", "std", "min", "max", "median", "q25", "q75", "skewness", "kurtosis"], ["column"])


@register("c8_feature_stats", C8_SQL)
def c8_feature_stats(spark, sf_dir):
    return rounded(profile.feature_statistics(tb.order_features(spark, sf_dir), OF_COLS))


# ---------------------------------------------------------------- C9
def _c9_sql() -> str:
    parts = ["SELECT 'target' AS role, 'o_totalprice' AS \"column\", avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std, "
             f"min(o_totalprice) AS min, max(o_totalprice) AS max, quantile_cont(o_totalprice, 0.5) AS median FROM {OF} t"]
    for c in ["q", "p", "n", "d", "t"]:
        parts.append(f"SELECT 'feature', '{c}', avg({c}), stddev_pop({c}), min({c})::DOUBLE, max({c})::DOUBLE, NULL::DOUBLE FROM {OF} t")
    return sql_rounded(_union(parts), ["mean", "std", "min", "max", "median"], ["role", "column"])


@register("c9_data_summary", _c9_sql())
def c9_data_summary(spark, sf_dir):
    return rounded(profile.data_summary(tb.order_features(spark, sf_dir), ["q", "p", "n", "d", "t"], "o_totalprice"))


# ---------------------------------------------------------------- D1 / D5
D1_SQL = sql_rounded(
    _union([f"SELECT '{c}' AS feature, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis FROM lineitem" for c in LI]),
    ["skewness", "kurtosis"], ["feature"])


@register("d1_skew_kurtosis", D1_SQL)
def d1_skew_kurtosis(spark, sf_dir):
    return rounded(moments.skew_kurtosis(tb.table(spark, sf_dir, "lineitem"), LI))


def _skew_label_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 2 THEN '严重右偏' WHEN {x} > 1 THEN '中度右偏' "
            f"WHEN {x} > 0.5 THEN '轻度右偏' WHEN {x} > -0.5 THEN '近似对称' WHEN {x} > -1 THEN '轻度左偏' "
            f"WHEN {x} > -2 THEN '中度左偏' ELSE '严重左偏' END")


def _kurt_label_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 3 THEN '高峰态' WHEN {x} > 0 THEN '中峰态' ELSE '低峰态' END"


def _d5_sql() -> str:
    m = _union([f"SELECT '{c}' AS feature, skewness({c}) AS s, kurtosis({c}) AS k FROM {OF} t" for c in OF_COLS])
    body = (f"SELECT feature, s AS skewness, {_skew_label_sql('s')} AS skewness_interpretation, "
            f"k AS kurtosis, {_kurt_label_sql('k')} AS kurtosis_interpretation FROM ({m}) m")
    return sql_rounded(body, ["skewness", "kurtosis"], ["feature", "skewness_interpretation", "kurtosis_interpretation"])


@register("d5_distribution_report", _d5_sql())
def d5_distribution_report(spark, sf_dir):
    return rounded(moments.distribution_report(tb.order_features(spark, sf_dir), OF_COLS))


# ---------------------------------------------------------------- D6 / D7 on the 64-column table
PLANTED = tb.planted_sql()


def _planted_moments_sql() -> str:
    return _union([f"SELECT '{c}' AS feature, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis FROM {PLANTED} p" for c in PLANTED_COLS + ["y"]])


def _d6_sql() -> str:
    bands = [
        ("skewness", "severe_right", "skewness > 2"), ("skewness", "moderate_right", "skewness > 1 AND skewness <= 2"),
        ("skewness", "light_right", "skewness > 0.5 AND skewness <= 1"), ("skewness", "symmetric", "skewness >= -0.5 AND skewness <= 0.5"),
        ("skewness", "light_left", "skewness >= -1 AND skewness < -0.5"), ("skewness", "moderate_left", "skewness >= -2 AND skewness < -1"),
        ("skewness", "severe_left", "skewness < -2"), ("kurtosis", "high_peak", "kurtosis > 3"),
        ("kurtosis", "normal_peak", "kurtosis >= 0 AND kurtosis <= 3"), ("kurtosis", "low_peak", "kurtosis < 0"),
    ]
    m = _planted_moments_sql()
    return _union([f"SELECT '{a}' AS measure, '{b}' AS band, count(*) FILTER (WHERE {cond})::BIGINT AS n_features FROM ({m}) m" for a, b, cond in bands])


@register("d6_band_counts", _d6_sql())
def d6_band_counts(spark, sf_dir):
    return moments.band_counts(moments.skew_kurtosis(tb.planted(spark, sf_dir), PLANTED_COLS + ["y"]))


def _d7_sql() -> str:
    m = _planted_moments_sql()
    body = _union([f"SELECT '{c}' AS measure, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, median({c}) AS median FROM ({m}) m" for c in ("skewness", "kurtosis")])
    return sql_rounded(body, ["mean", "std", "min", "max", "median"], ["measure"])


@register("d7_moment_summary", _d7_sql())
def d7_moment_summary(spark, sf_dir):
    return rounded(moments.moment_summary(moments.skew_kurtosis(tb.planted(spark, sf_dir), PLANTED_COLS + ["y"])))


# ---------------------------------------------------------------- E1-E4, E6
def _pairs_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            b = cols[j]
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {i} AS pos_a, {j} AS pos_b, "
                         f"count({a} + {b})::BIGINT AS n, corr({a}, {b}) AS r FROM {src} t")
    return _union(parts)


E1_SQL = sql_rounded(_pairs_sql(OF, OF_COLS), ["r"], ["feature_a", "feature_b", "pos_a", "pos_b", "n"])


@register("e1_correlation", E1_SQL)
def e1_correlation(spark, sf_dir):
    return rounded(correlate.correlation_long(tb.order_features(spark, sf_dir), OF_COLS))


def _e1_wide_sql() -> str:
    cols = PLANTED_COLS + ["y"]
    sel = ", ".join(f"corr({a}, {b}) AS \"{a}__{b}\"" for i, a in enumerate(cols) for b in cols[i + 1:])
    pos = {c: i for i, c in enumerate(cols)}
    body = f"""SELECT split_part(k, '__', 1) AS feature_a, split_part(k, '__', 2) AS feature_b, r
      FROM (UNPIVOT (SELECT {sel} FROM {PLANTED} p) ON COLUMNS(*) INTO NAME k VALUE r)"""
    cases_a = " ".join(f"WHEN '{c}' THEN {i}" for c, i in pos.items())
    body = f"SELECT feature_a, feature_b, CASE feature_a {cases_a} END AS pos_a, CASE feature_b {cases_a} END AS pos_b, r FROM ({body}) u"
    return sql_rounded(body, ["r"], ["feature_a", "feature_b", "pos_a", "pos_b"])


@register("e1_correlation_wide", _e1_wide_sql())
def e1_correlation_wide(spark, sf_dir):
    c = correlate.correlation_long(tb.planted(spark, sf_dir), PLANTED_COLS + ["y"])
    return rounded(c.drop("n"))


E2_SQL = sql_rounded(
    f"SELECT * FROM ({_pairs_sql(OF, OF_COLS)}) c WHERE abs(r) > 0.5 ORDER BY abs(r) DESC, pos_a, pos_b",
    ["r"], ["feature_a", "feature_b", "pos_a", "pos_b", "n"])


@register("e2_strong_pairs", E2_SQL)
def e2_strong_pairs(spark, sf_dir):
    return rounded(correlate.strong_pairs(correlate.correlation_long(tb.order_features(spark, sf_dir), OF_COLS)))


E3_SQL = sql_rounded(f"SELECT * FROM ({_pairs_sql(OF, OF_COLS)}) c WHERE abs(r) >= 0.8",
                     ["r"], ["feature_a", "feature_b", "pos_a", "pos_b", "n"])


@register("e3_high_pairs", E3_SQL)
def e3_high_pairs(spark, sf_dir):
    return rounded(correlate.high_pairs(correlate.correlation_long(tb.order_features(spark, sf_dir), OF_COLS)))


def _e4_sql(target: str, k: int = 3) -> str:
    parts = [f"SELECT '{c}' AS feature, {i} AS pos, abs(corr({target}, {c})) AS abs_r FROM {OF} t"
             for i, c in enumerate(OF_COLS) if c != target]
    body = f"SELECT * FROM ({_union(parts)}) x WHERE abs_r IS NOT NULL ORDER BY abs_r DESC, pos LIMIT {k}"
    return sql_rounded(body, ["abs_r"], ["feature", "pos"])


@register("e4_corr_with_target", _e4_sql("p"))
def e4_corr_with_target(spark, sf_dir):
    return rounded(correlate.corr_with(tb.order_features(spark, sf_dir), "p", OF_COLS, k=3))


def _e6_sql() -> str:
    cols = PLANTED_COLS + ["y"]
    sel = _union([f"SELECT '{c}' AS feature, abs(corr(y, {c})) AS a FROM {PLANTED} p" for c in PLANTED_COLS])
    top = f"SELECT feature FROM ({sel}) s ORDER BY a DESC, feature LIMIT 6"
    pairs = _e1_wide_sql_raw(cols)
    body = f"""SELECT feature_b AS row_feature, feature_a AS col_feature, pos_b AS row_pos, pos_a AS col_pos, r
      FROM ({pairs}) c WHERE feature_a IN ({top}) AND feature_b IN ({top})"""
    return sql_rounded(body, ["r"], ["row_feature", "col_feature", "row_pos", "col_pos"])


def _e1_wide_sql_raw(cols: list[str]) -> str:
    sel = ", ".join(f"corr({a}, {b}) AS \"{a}__{b}\"" for i, a in enumerate(cols) for b in cols[i + 1:])
    cases = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(cols))
    body = f"""SELECT split_part(k, '__', 1) AS feature_a, split_part(k, '__', 2) AS feature_b, r
      FROM (UNPIVOT (SELECT {sel} FROM {PLANTED} p) ON COLUMNS(*) INTO NAME k VALUE r)"""
    return f"SELECT feature_a, feature_b, CASE feature_a {cases} END AS pos_a, CASE feature_b {cases} END AS pos_b, r FROM ({body}) u"


@register("e6_selected_submatrix", _e6_sql())
def e6_selected_submatrix(spark, sf_dir):
    p = tb.planted(spark, sf_dir)
    cols = PLANTED_COLS + ["y"]
    corr = correlate.correlation_long(p, cols)
    top = (
        correlate.corr_with(p, "y", PLANTED_COLS, k=None)
        .orderBy(F.desc("abs_r"), "feature")
        .limit(6)
    )
    return rounded(correlate.selected_submatrix(corr, top))
