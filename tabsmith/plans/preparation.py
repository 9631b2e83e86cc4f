"""Queries for clipping, scaling, splitting and imputation (G, H, I, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import clean
from ..operators import impute, outliers, scale, split
from ..operators.ordering import written
from ..sources import tables as tb
from .catalog import register, rounded, sql_rounded

OF = tb.ORDER_FEATURES_SQL
LI = tb.LINEITEM_COLS
CLIP_COLS = ["o_totalprice", "q", "p", "n", "d", "t", "qp"]
FILL_COLS = ["q", "p", "n", "d", "t"]


def clip_input(spark, sf_dir):
    """order_features plus qp = q * p (heavy right skew)."""
    of = tb.order_features(spark, sf_dir)
    return of.withColumn("qp", F.col("q") * F.col("p"))


CLIP_SQL = f"(SELECT *, q * p AS qp FROM {OF} x)"


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _clip_spec_sql(c: str, src: str) -> str:
    """One row: class, skew, shift, lo, hi for column c (bounds in clip space)."""
    cls = f"CASE WHEN abs(coalesce(sk, 0)) < 1 THEN 'light_skew' WHEN abs(coalesce(sk, 0)) < 2 THEN 'moderate_skew' ELSE 'heavy_skew' END"
    return f"""(WITH s AS (SELECT skewness({c}) AS sk, min({c}) AS mn FROM {src} t),
      c AS (SELECT sk, mn, {cls} AS cl FROM s),
      h AS (SELECT sk, cl, CASE WHEN cl = 'heavy_skew' AND mn <= 0 THEN abs(mn) + 1e-6 ELSE 0.0 END AS shift FROM c),
      v AS (SELECT CASE WHEN h.cl = 'heavy_skew' THEN ln(1 + {c} + h.shift) ELSE {c} END AS x FROM {src} t, h),
      b AS (SELECT quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.10) AS p10, quantile_cont(x, 0.90) AS p90,
                   quantile_cont(x, 0.95) AS p95 FROM v)
      SELECT '{c}' AS feature, cl AS skew_class, sk AS skewness, shift,
        CASE WHEN cl = 'moderate_skew' THEN p10 ELSE p05 END AS lower,
        CASE WHEN cl = 'moderate_skew' THEN p90 ELSE p95 END AS upper FROM h, b)"""


def _g1_sql() -> str:
    parts = []
    for c in CLIP_COLS:
        spec = _clip_spec_sql(c, CLIP_SQL)
        x = f"(CASE WHEN s.skew_class = 'heavy_skew' THEN ln(1 + t.{c} + s.shift) ELSE t.{c} END)"
        parts.append(f"""SELECT s.feature, s.skew_class, s.skewness, s.lower, s.upper,
          count(*) FILTER (WHERE {x} < s.lower OR {x} > s.upper)::BIGINT AS clipped
          FROM {CLIP_SQL} t, {spec} s GROUP BY ALL""")
    return sql_rounded(_union(parts), ["skewness", "lower", "upper"], ["feature", "skew_class", "clipped"])


@register("g1_clip_summary", _g1_sql())
def g1_clip_summary(spark, sf_dir):
    df = clip_input(spark, sf_dir)
    model = outliers.SkewClipper(inputCols=CLIP_COLS).fit(df)
    return rounded(model.summary(df))


def clipped_sql() -> str:
    """Keys and clipped columns, not rounded."""
    sel, joins = [], []
    for i, c in enumerate(CLIP_COLS):
        s = f"s{i}"
        joins.append(f"{_clip_spec_sql(c, CLIP_SQL)} {s}")
        x = f"(CASE WHEN {s}.skew_class = 'heavy_skew' THEN ln(1 + t.{c} + {s}.shift) ELSE t.{c} END)"
        clipped = f"least(greatest({x}, {s}.lower), {s}.upper)"
        sel.append(f"CASE WHEN {s}.skew_class = 'heavy_skew' THEN exp({clipped}) - 1 ELSE {clipped} END AS {c}")
    return f"SELECT t.o_orderkey, {', '.join(sel)} FROM {CLIP_SQL} t, {', '.join(joins)}"


@register("g2_clip_values", sql_rounded(clipped_sql(), CLIP_COLS, ["o_orderkey"]))
def g2_clip_values(spark, sf_dir):
    df = clip_input(spark, sf_dir)
    model = outliers.SkewClipper(inputCols=CLIP_COLS).fit(df)
    return rounded(model.transform(df).select("o_orderkey", *CLIP_COLS))


# events.value has moderate skew: the 10-90 branch
def _g1_events_sql() -> str:
    spec = _clip_spec_sql("value", "events")
    body = f"""SELECT s.feature, s.skew_class, s.skewness, s.lower, s.upper,
      count(*) FILTER (WHERE t.value < s.lower OR t.value > s.upper)::BIGINT AS clipped FROM events t, {spec} s GROUP BY ALL"""
    return sql_rounded(body, ["skewness", "lower", "upper"], ["feature", "skew_class", "clipped"])


@register("g1_clip_summary_events", _g1_events_sql())
def g1_clip_summary_events(spark, sf_dir):
    ev = tb.table(spark, sf_dir, "events")
    model = outliers.SkewClipper(inputCols=["value"]).fit(ev)
    return rounded(model.summary(ev))


def _iqr_mask_sql() -> str:
    return """SELECT event_id, coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false) AS is_outlier
      FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) b"""


@register("g4_iqr_mask", _iqr_mask_sql())
def g4_iqr_mask(spark, sf_dir):
    ev = tb.table(spark, sf_dir, "events")
    return outliers.iqr_mask(ev, "value").select("event_id", "is_outlier")


@register("g5_zscore_mask", """SELECT event_id, coalesce(abs((value - m) / s) > 3, false) AS is_outlier
  FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) b""")
def g5_zscore_mask(spark, sf_dir):
    ev = tb.table(spark, sf_dir, "events")
    return outliers.zscore_mask(ev, "value").select("event_id", "is_outlier")


def _g6_sql() -> str:
    parts = []
    for c in LI:
        parts.append(f"""SELECT '{c}' AS "column", q1 - 1.5 * (q3 - q1) AS iqr_lower, q3 + 1.5 * (q3 - q1) AS iqr_upper,
          count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::BIGINT AS iqr_outliers,
          count(*) FILTER (WHERE s > 0 AND abs(({c} - m) / s) > 3)::BIGINT AS zscore_outliers,
          count({c})::BIGINT AS non_null
          FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
                                 avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem) b GROUP BY ALL""")
    return sql_rounded(_union(parts), ["iqr_lower", "iqr_upper"], ["column", "iqr_outliers", "zscore_outliers", "non_null"])


@register("g6_outlier_stats", _g6_sql())
def g6_outlier_stats(spark, sf_dir):
    return rounded(outliers.outlier_statistics(tb.table(spark, sf_dir, "lineitem"), LI))


# ---------------------------------------------------------------- I1 / I2
def _hash_sql(key: str, purpose: str, seed: int = 42) -> str:
    return split.split_sql(key, seed, purpose)


I1_SQL = f"""SELECT o_orderkey, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY {_hash_sql('o_orderkey', 'split')}, o_orderkey) AS rn,
         count(*) OVER () AS n FROM orders) x"""


@register("i1_train_test_split", I1_SQL)
def i1_train_test_split(spark, sf_dir):
    o = tb.table(spark, sf_dir, "orders").select("o_orderkey")
    return split.train_test_split(o, "o_orderkey", 0.2, 42)


I2_SQL = f"""SELECT o_orderkey, (CASE
    WHEN rn <= 1 * (n // 5) + least(n % 5, 1) THEN 0
    WHEN rn <= 2 * (n // 5) + least(n % 5, 2) THEN 1
    WHEN rn <= 3 * (n // 5) + least(n % 5, 3) THEN 2
    WHEN rn <= 4 * (n // 5) + least(n % 5, 4) THEN 3 ELSE 4 END)::INTEGER AS fold FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY {_hash_sql('o_orderkey', 'fold')}, o_orderkey) AS rn,
         count(*) OVER () AS n FROM orders) x"""


@register("i2_kfold", I2_SQL)
def i2_kfold(spark, sf_dir):
    o = tb.table(spark, sf_dir, "orders").select("o_orderkey")
    return split.kfold(o, "o_orderkey", 5, 42)


# ---------------------------------------------------------------- H1-H5
SPLIT_OF = f"""(SELECT t.* EXCLUDE (rn_, rows_), CASE WHEN rn_ <= ceil(0.2 * rows_) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT x.*, row_number() OVER (ORDER BY {_hash_sql('o_orderkey', 'split')}, o_orderkey) AS rn_, count(*) OVER () AS rows_
  FROM {OF} x) t)"""
SCALE_COLS = ["q", "p", "n", "d", "t"]


def _h1_sql() -> str:
    stats = ", ".join(
        f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS i_{c}" for c in SCALE_COLS
    )
    sel = ", ".join(f"({c} - m_{c}) / CASE WHEN i_{c} = 0 OR i_{c} IS NULL THEN 1 ELSE i_{c} END AS {c}" for c in SCALE_COLS)
    body = f"SELECT o_orderkey, split, o_totalprice, {sel} FROM {SPLIT_OF} s, (SELECT {stats} FROM {SPLIT_OF} s WHERE split = 'train') b"
    return sql_rounded(body, ["o_totalprice"] + SCALE_COLS, ["o_orderkey", "split"])


@register("h1_robust_scale", _h1_sql())
def h1_robust_scale(spark, sf_dir):
    of = split.train_test_split(tb.order_features(spark, sf_dir), "o_orderkey")
    model = scale.RobustScaler(inputCols=SCALE_COLS).fit(of.filter(F.col("split") == "train"))
    return rounded(model.transform(of).select("o_orderkey", "split", "o_totalprice", *[F.col(c).cast("double").alias(c) for c in SCALE_COLS]))


def _affine_sql(stats_fn, guard) -> str:
    cols = ["c_acctbal"]
    stats = ", ".join(stats_fn(c) for c in cols)
    sel = ", ".join(f"CASE WHEN {guard(c)} THEN (c_acctbal - a_{c}) / b_{c} ELSE c_acctbal END AS c_acctbal" for c in cols)
    return sql_rounded(f"SELECT c_custkey, {sel} FROM customer, (SELECT {stats} FROM customer) b", ["c_acctbal"], ["c_custkey"])


@register("h2_zscore_scale", _affine_sql(lambda c: f"avg({c}) AS a_{c}, stddev_samp({c}) AS b_{c}", lambda c: f"b_{c} > 0"))
def h2_zscore_scale(spark, sf_dir):
    cu = tb.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(scale.ZScoreScaler(inputCols=["c_acctbal"]).fit(cu).transform(cu))


@register("h3_minmax_scale", _affine_sql(lambda c: f"min({c}) AS a_{c}, max({c}) - min({c}) AS b_{c}", lambda c: f"b_{c} > 0"))
def h3_minmax_scale(spark, sf_dir):
    cu = tb.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(scale.MinMaxScaler(inputCols=["c_acctbal"]).fit(cu).transform(cu))


H4_SQL = sql_rounded(
    """SELECT c_custkey, CASE WHEN mad > 0 THEN (c_acctbal - med) / mad ELSE c_acctbal END AS c_acctbal
  FROM customer, (SELECT med, quantile_cont(abs(c_acctbal - med), 0.5) AS mad
                  FROM customer, (SELECT quantile_cont(c_acctbal, 0.5) AS med FROM customer) m GROUP BY med) b""",
    ["c_acctbal"], ["c_custkey"])


@register("h4_mad_scale", H4_SQL)
def h4_mad_scale(spark, sf_dir):
    cu = tb.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(scale.MadScaler(inputCols=["c_acctbal"]).fit(cu).transform(cu))


H5_SQL = sql_rounded(
    """SELECT c_custkey, ln(1 + c_acctbal + CASE WHEN mn <= 0 THEN 1 - mn ELSE 0 END) AS c_acctbal
  FROM customer, (SELECT min(c_acctbal) AS mn FROM customer) b""",
    ["c_acctbal"], ["c_custkey"])


@register("h5_log_transform", H5_SQL)
def h5_log_transform(spark, sf_dir):
    cu = tb.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(scale.LogTransformer(inputCols=["c_acctbal"]).fit(cu).transform(cu))


def _h5_auto_sql() -> str:
    # columns of the documents table with abs(skew) > 1 are logged (n_chars)
    return sql_rounded(
        """SELECT doc_id, CASE WHEN abs(sk) > 1 THEN ln(1 + n_chars + CASE WHEN mn <= 0 THEN 1 - mn ELSE 0 END) ELSE n_chars END AS n_chars
      FROM documents, (SELECT skewness(n_chars) AS sk, min(n_chars) AS mn FROM documents) b""",
        ["n_chars"], ["doc_id"])


@register("h5_log_auto", _h5_auto_sql())
def h5_log_auto(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    out = scale.LogTransformer(target="doc_id").fit(d).transform(d)
    return rounded(out.select("doc_id", F.col("n_chars").cast("double").alias("n_chars")))


# ---------------------------------------------------------------- F1-F6, F9
F1_STATS = f"""(SELECT regr_slope(p, o_totalprice) AS slope, regr_intercept(p, o_totalprice) AS intercept,
   regr_r2(p, o_totalprice) AS r2, corr(p, o_totalprice) AS r, regr_count(p, o_totalprice)::BIGINT AS n_fit,
   count(*) FILTER (WHERE p IS NULL AND o_totalprice IS NOT NULL)::BIGINT AS n_filled FROM {OF} x)"""

F1_SQL = sql_rounded(
    f"""SELECT o_orderkey, CASE WHEN p IS NULL AND o_totalprice IS NOT NULL THEN intercept + slope * o_totalprice ELSE p END AS p
    FROM {OF} x, {F1_STATS} s""", ["p"], ["o_orderkey"])


@register("f1_regression_fill", F1_SQL)
def f1_regression_fill(spark, sf_dir):
    out, _ = impute.regression_fill(tb.order_features(spark, sf_dir), "p", "o_totalprice")
    return rounded(out.select("o_orderkey", "p"))


@register("f1_regression_report", sql_rounded(f"SELECT * FROM {F1_STATS} s", ["slope", "intercept", "r2", "r"], ["n_fit", "n_filled"]))
def f1_regression_report(spark, sf_dir):
    _, st = impute.regression_fill(tb.order_features(spark, sf_dir), "p", "o_totalprice")
    row = [(st["slope"], st["intercept"], st["r2"], st["r"], st["n_fit"], st["n_filled"])]
    return rounded(spark.createDataFrame(row, "slope double, intercept double, r2 double, r double, n_fit long, n_filled long"))


def _fill_sql(stat, scalar: bool = False) -> str:
    stats = ", ".join(f"{stat(c)} AS s_{c}" for c in FILL_COLS)
    sel = ", ".join(f"coalesce({c}::DOUBLE, s_{c}) AS {c}" for c in FILL_COLS)
    src = f"(SELECT {stats})" if scalar else f"(SELECT {stats} FROM {OF} y)"
    return sql_rounded(f"SELECT o_orderkey, {sel} FROM {OF} x, {src} s", FILL_COLS, ["o_orderkey"])


def _fill_out(df):
    return rounded(df.select("o_orderkey", *[clean(c).alias(c) for c in FILL_COLS]))


@register("f3_mean_fill", _fill_sql(lambda c: f"avg({c})"))
def f3_mean_fill(spark, sf_dir):
    return _fill_out(impute.mean_fill(tb.order_features(spark, sf_dir), FILL_COLS)[0])


@register("f4_median_fill", _fill_sql(lambda c: f"quantile_cont({c}, 0.5)"))
def f4_median_fill(spark, sf_dir):
    return _fill_out(impute.median_fill(tb.order_features(spark, sf_dir), FILL_COLS)[0])


@register("f5_mode_fill", _fill_sql(lambda c: f"(SELECT v FROM (SELECT {c} AS v, count(*) AS k FROM {OF} z WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY k DESC, v LIMIT 1)", scalar=True))
def f5_mode_fill(spark, sf_dir):
    return _fill_out(impute.mode_fill(tb.order_features(spark, sf_dir), FILL_COLS)[0])


@register("f5_mode_fill_string", """SELECT p_partkey, coalesce(p_brand, (SELECT v FROM (SELECT p_brand AS v, count(*) AS k FROM part
  WHERE p_brand IS NOT NULL GROUP BY 1) ORDER BY k DESC, v LIMIT 1)) AS p_brand FROM part""")
def f5_mode_fill_string(spark, sf_dir):
    pt = tb.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return impute.mode_fill(pt, ["p_brand"])[0]


def _f6_sql() -> str:
    cols = ["o_orderkey"] + tb.ORDER_FEATURE_COLS
    parts = []
    for c in tb.ORDER_FEATURE_COLS:
        others = [o for o in cols if o != c]
        mx = "greatest(" + ", ".join(f"coalesce(abs(corr({c}, {o})), 0)" for o in others) + ")"
        parts.append(f"""SELECT '{c}' AS feature, CASE WHEN count(*) FILTER (WHERE {c} IS NULL) / count(*) > 0.5 THEN 'mean'
          WHEN {mx} > 0.5 THEN 'regression' WHEN count(*) > 20 AND {len(others)} <= 10 THEN 'knn' ELSE 'mean' END AS strategy
          FROM {OF} x""")
    return _union(parts)


@register("f6_choose_strategy", _f6_sql())
def f6_choose_strategy(spark, sf_dir):
    of = tb.order_features(spark, sf_dir)
    rows = [(c, impute.choose_strategy(of, c)) for c in tb.ORDER_FEATURE_COLS]
    return spark.createDataFrame(rows, "feature string, strategy string")


KNN_COLS = tb.ORDER_FEATURE_COLS


def _f2_sql(k: int = 5) -> str:
    cols = KNN_COLS
    both = [f"(r.{c} IS NOT NULL AND d.{c} IS NOT NULL)" for c in cols]
    sq = " + ".join(f"CASE WHEN {b} THEN (r.{c} - d.{c}) * (r.{c} - d.{c}) ELSE 0 END" for b, c in zip(both, cols))
    shared = " + ".join(f"{b}::INT" for b in both)
    dist = f"CASE WHEN ({shared}) > 0 THEN sqrt({len(cols)}.0 / ({shared}) * ({sq})) END"
    recv = " OR ".join(f"{c} IS NULL" for c in cols)
    parts = []
    for c in cols:
        parts.append(f"""SELECT r.o_orderkey, '{c}' AS target, d.{c} AS v, {dist} AS dist, d.o_orderkey AS dk
          FROM (SELECT * FROM {OF} a WHERE {c} IS NULL) r, {OF} d
          WHERE d.{c} IS NOT NULL AND d.o_orderkey <> r.o_orderkey""")
    cand = _union(parts)
    top = f"""SELECT o_orderkey, target, avg(v) AS v FROM (
        SELECT *, row_number() OVER (PARTITION BY o_orderkey, target ORDER BY dist, dk) AS rn FROM ({cand}) c WHERE dist IS NOT NULL)
      WHERE rn <= {k} GROUP BY ALL"""
    means = ", ".join(f"avg({c}) AS m_{c}" for c in cols)
    sel = ", ".join(
        f"coalesce(x.{c}::DOUBLE, (SELECT v FROM ({top}) f WHERE f.o_orderkey = x.o_orderkey AND f.target = '{c}'), m_{c}) AS {c}"
        for c in cols
    )
    body = f"""WITH t AS ({top}) SELECT x.o_orderkey, {', '.join(
        f"coalesce(x.{c}::DOUBLE, t_{c}.v, m_{c}) AS {c}" for c in cols)}
      FROM {OF} x CROSS JOIN (SELECT {means} FROM {OF} y) m
      {' '.join(f"LEFT JOIN (SELECT * FROM t WHERE target = '{c}') t_{c} ON t_{c}.o_orderkey = x.o_orderkey" for c in cols)}"""
    del sel, recv
    return sql_rounded(body, cols, ["o_orderkey"])


@register("f2_knn_fill", _f2_sql())
def f2_knn_fill(spark, sf_dir):
    of = written(tb.order_features(spark, sf_dir))
    out = impute.knn_fill(of, "o_orderkey", KNN_COLS, k=5, pivot="o_totalprice")
    return rounded(out.select("o_orderkey", *[clean(c).alias(c) for c in KNN_COLS]))
