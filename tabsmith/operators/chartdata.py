"""Tables behind the diagnostic charts (M1-M16); drawing itself is not built.

Each is a grouped aggregate or window over the data it summarises, so it
scales with the input rather than plotting one point per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.columns import clean, melt, name_of, q
from ..functions.stats import r2_expr
from .ordering import row_numbers
from .quantiles import quantiles


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 20) -> DataFrame:
    """M1: equal-width bins per column over [min, max]; the max falls in the last bin."""
    cols = list(cols)
    long = melt(df, cols).filter(F.col("v").isNotNull())
    rng = long.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    w = (F.col("hi") - F.col("lo")) / bins
    b = F.when(w > 0, F.least(F.floor((F.col("v") - F.col("lo")) / w), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    h = long.join(F.broadcast(rng), "k").groupBy("k", b.alias("bin"), "lo", "hi").count()
    return h.select(name_of(cols).alias("column"), "bin",
                    (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_end"), F.col("count"))


def density(df: DataFrame, cols: Sequence[str], bins: int) -> DataFrame:
    """M1 as a density: the counts of the bins over rows and bin width (NULL for a constant column), so the bars' area is 1."""
    h = histogram(df, cols, bins)
    rows = h.groupBy("column").agg(F.sum("count").alias("_n"))
    share = F.try_divide(F.col("count"), F.col("_n") * (F.col("bin_end") - F.col("bin_start")))
    return h.join(F.broadcast(rows), "column").select(*h.columns, share.alias("density"))  # a row for each column


def rank_histogram(ranks: DataFrame, rank: str = "rank", most: int = 10) -> DataFrame:
    """M1 of ranks: min(``most``, n) bins for n ranks."""
    n = ranks.where(F.col(rank).isNotNull()).count()
    return histogram(ranks, [rank], max(1, min(most, n)))


def box_summary(df: DataFrame, cols: Sequence[str], multiplier: float = 1.5, exact: bool = True) -> DataFrame:
    """M2: quartiles, whiskers (furthest values inside the 1.5 IQR fences), outlier count."""
    cols = list(cols)
    qs = quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact)

    def arr(j):
        return F.element_at(F.array(*[F.lit(qs[c][j]).cast("double") for c in cols]), F.col("k") + 1)

    q1, med, q3 = arr(0), arr(1), arr(2)
    lo, hi = q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)
    v = F.col("v")
    inside = (v >= lo) & (v <= hi)
    return melt(df, cols).groupBy("k").agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers"),
    ).select(name_of(cols).alias("column"), q1.alias("q1"), med.alias("median"), q3.alias("q3"), "whisker_low", "whisker_high", "outliers")


def box_points(df: DataFrame, key: str, cols: Sequence[str], multiplier: float = 1.5, exact: bool = True) -> DataFrame:
    """M2: key, column and value of every point beyond the 1.5 IQR fences; rows stay where they are, nothing is shuffled."""
    cols = list(cols)
    qs = quantiles(df, cols, [0.25, 0.75], exact=exact)
    points = []
    for c in cols:
        if qs[c][0] is not None:
            q1, q3 = qs[c]
            v = clean(c)
            beyond = (v < q1 - multiplier * (q3 - q1)) | (v > q3 + multiplier * (q3 - q1))
            points.append(F.when(beyond, F.struct(F.lit(c).alias("column"), v.alias("value"))))
    if not points:
        points = [F.lit(None).cast("struct<column: string, value: double>")]
    found = df.select(q(key), F.explode(F.filter(F.array(*points), lambda e: e.isNotNull())).alias("_p"))
    return found.select(q(key), F.col("_p.column").alias("column"), F.col("_p.value").alias("value"))


def box_before_after(before: DataFrame, after: DataFrame, skewness: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M2: box summaries before and after clipping, with the clip class of the column's skewness before it."""
    classes = skewness.select(F.col("feature").alias("column"), bands.clip_class(F.col("skewness")).alias("skew_class"))
    both = box_summary(before, cols).withColumn("stage", F.lit("before")).unionByName(box_summary(after, cols).withColumn("stage", F.lit("after")))
    return both.join(F.broadcast(classes), "column")  # a row for each column


def skew_improvement(before: DataFrame, after: DataFrame) -> DataFrame:
    """M3: per feature abs(skew before) - abs(skew after), with the clip class of the before value."""
    b = before.select("feature", F.col("skewness").alias("skew_before"))
    a = after.select("feature", F.col("skewness").alias("skew_after"))
    return b.join(a, "feature").select(
        "feature", bands.clip_class(F.col("skew_before")).alias("skew_class"), "skew_before", "skew_after",
        (F.abs("skew_before") - F.abs("skew_after")).alias("improvement"))


def skew_improvement_summary(imp: DataFrame) -> DataFrame:
    """M3 summary per class and overall: improved/worse counts, mean, best and worst feature."""
    aggs = [F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("improvement") > 0, 1)).alias("improved"),
            F.count(F.when(F.col("improvement") < 0, 1)).alias("worse"), F.avg("improvement").alias("mean_improvement"),
            F.max_by("feature", F.struct("improvement", F.col("feature"))).alias("best_feature"),
            F.min_by("feature", F.struct("improvement", F.col("feature"))).alias("worst_feature")]
    per = imp.groupBy("skew_class").agg(*aggs)
    allr = imp.agg(*aggs).select(F.lit("all").alias("skew_class"), "*")
    return per.unionByName(allr)


def quadratic_trend(df: DataFrame, x: str, y: str) -> dict | None:
    """M6: least-squares y = a + b x + c x^2 (only with more than 10 points)."""
    from .linear import LinearSpec, fit
    from .sums import gram

    d = df.select(clean(x).alias("_x"), (clean(x) * clean(x)).alias("_x2"), clean(y).alias("_y"))
    g, c = gram(d, ["_x", "_x2", "_y"])
    m = g.get(0)
    if m is None or m[0, 0] <= 10:
        return None
    w, b = fit(m, [1, 2], LinearSpec("trend"))
    a = float(c[2] + b - w[0] * c[0] - w[1] * c[1])
    return {"a": a, "b": float(w[0]), "c": float(w[1])}


def series_summary(df: DataFrame, value: str, order: str, last: int = 10) -> DataFrame:
    """M7: mean, std (ddof 0), max, min, range of a series, and the mean of its last ``last`` rows.

    The tail is a distributed top-k (``orderBy(desc).limit``), not a global window.
    """
    v = F.col(value)
    tail = df.orderBy(F.desc(order)).limit(last).agg(F.avg(value)).first()[0]
    return df.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"),
                  (F.max(v) - F.min(v)).alias("range"), F.lit(tail).cast("double").alias("mean_last"))


def importance_overlap(importance: DataFrame, selected: DataFrame, tops: Sequence[int] = (5, 10, 15, 20)) -> DataFrame:
    """M8: selected features inside the top-n by importance, percent of min(n, #selected); 0 where n exceeds the columns."""
    sel = selected.select("feature_name").distinct()
    r = importance.select("feature_name", "rank").join(sel.withColumn("_hit", F.lit(1)), "feature_name", "left")
    counts = r.agg(F.count(F.lit(1)).alias("columns"), F.count("_hit").alias("found"), *[F.count(F.when(F.col("rank") <= t, F.col("_hit"))).alias(f"top_{t}") for t in tops]).first()
    n_sel = sel.count()
    rows = [(t, counts[f"top_{t}"], counts[f"top_{t}"] * 100.0 / min(t, n_sel) if t <= counts["columns"] and n_sel else 0.0) for t in tops]
    return importance.sparkSession.createDataFrame(rows, "top_n int, overlap long, overlap_pct double")


def importance_with_selection(importance: DataFrame, selected: DataFrame, top: int = 20) -> DataFrame:
    """M9: top-n importances with a joined 'selected' flag (flags travel with their feature)."""
    sel = selected.select("feature_name").withColumn("selected", F.lit(True))
    return (importance.join(sel, "feature_name", "left").fillna({"selected": False})
            .orderBy("rank").limit(top))


def normalise_metrics(df: DataFrame, higher_better: Sequence[str], lower_better: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Min-max to [0, 1] across rows (per group), inverted for lower-is-better, 0.5 if constant."""
    cols = [*higher_better, *lower_better]
    ends = [f(c).alias(f"_{n}_{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]
    if by:
        far = df.groupBy(*by).agg(*ends).select(*[F.col(b).alias(f"_by_{i}") for i, b in enumerate(by)], *[f"_{n}_{i}" for i in range(len(cols)) for n in ("lo", "hi")])
        match = [F.col(b).eqNullSafe(F.col(f"_by_{i}")) for i, b in enumerate(by)]
        out = df.join(far, match, "inner")
        end = lambda n, i: F.col(f"_{n}_{i}")
    else:  # one row of ranges, taken as literals: no window over all rows
        far = df.agg(*ends).first()
        out = df
        end = lambda n, i: F.lit(far[f"_{n}_{i}"])
    norms = []
    for i, c in enumerate(cols):
        lo, hi = end("lo", i), end("hi", i)
        x = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.5))
        norms.append(((1 - x) if c in lower_better else x).alias(f"{c}_norm"))
    return out.select(*df.columns, *norms)


def model_ranking(results: DataFrame, r2: str = "mean_r2", std: str = "std_r2") -> DataFrame:
    """Models by mean R2 with std, min, max and spread; NaN scores dropped."""
    ok = results.filter(F.col(r2).isNotNull() & ~F.isnan(r2))
    return ok.select("model", r2, std, "min_r2", "max_r2", (F.col("max_r2") - F.col("min_r2")).alias("spread")).orderBy(F.desc(r2))


def models_in_order(results: DataFrame, order: Sequence[str], r2: str = "mean_r2", std: str = "std_r2") -> DataFrame:
    """M11, second view: score and std of each model at its place in the run; models without a score are left out and take no place."""
    ran = results.sparkSession.createDataFrame([(m, i) for i, m in enumerate(order)], "model string, _at int")
    ok = results.filter(F.col(r2).isNotNull() & ~F.isnan(r2)).join(F.broadcast(ran), "model")  # a row for each model
    placed = row_numbers(ok.select("model", r2, std, "_at"), ["_at"], name="position")
    return placed.select((F.col("position") + 1).cast("int").alias("position"), "model", r2, std)


def inverse_normal(p: F.Column) -> F.Column:
    """Standard normal quantile, Acklam's rational approximation (|error| < 1.2e-9)."""
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]

    def poly(coef, x):
        out = F.lit(coef[0])
        for k in coef[1:]:
            out = out * x + F.lit(k)
        return out

    plow = 0.02425
    qq = F.sqrt(-2 * F.log(p))
    low = poly(c, qq) / (poly(d, qq) * qq + 1)
    qh = F.sqrt(-2 * F.log(1 - p))
    high = -poly(c, qh) / (poly(d, qh) * qh + 1)
    r = (p - 0.5) * (p - 0.5)
    mid = poly(a, r) * (p - 0.5) / (poly(b, r) * r + 1)
    return F.when(p < plow, low).when(p > 1 - plow, high).otherwise(mid)


def qq_points(df: DataFrame, col: str, points: int = 100, exact: bool = True) -> DataFrame:
    """M12 normal Q-Q: sample quantiles at a fixed grid of plotting positions vs N(0,1) quantiles."""
    probs = [(i + 0.5) / points for i in range(points)]
    vals = quantiles(df, [col], probs, exact=exact)[col]
    spark = df.sparkSession
    t = spark.createDataFrame([(float(p), v) for p, v in zip(probs, vals)], "p double, sample double")
    return t.withColumn("theoretical", inverse_normal(F.col("p")))


def binned_pairs(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """2-D counts on a shared equal-width grid instead of one point per row."""
    r = df.agg(F.least(F.min(clean(x)), F.min(clean(y))).alias("lo"), F.greatest(F.max(clean(x)), F.max(clean(y))).alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bx int, by int, count long")
    w = (hi - lo) / bins if hi > lo else 1.0

    def b(c):
        return F.least(F.floor((clean(c) - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("int")

    return df.filter(clean(x).isNotNull() & clean(y).isNotNull()).groupBy(b(x).alias("bx"), b(y).alias("by")).count()


def row_index(df: DataFrame, order: str, name: str = "index") -> DataFrame:
    """The place 0..n-1 of each row along ``order``, from counts of sorted ranges."""
    return row_numbers(df, [order], name=name)


def binned_xy(df: DataFrame, x: str, y: str, bins_x: int = 50, bins_y: int = 25) -> DataFrame:
    """2-D counts, each axis on its own equal-width grid."""
    r = df.agg(F.min(clean(x)).alias("x0"), F.max(clean(x)).alias("x1"), F.min(clean(y)).alias("y0"), F.max(clean(y)).alias("y1")).first()
    if r["x0"] is None or r["y0"] is None:
        return df.sparkSession.createDataFrame([], "bx int, by int, count long")

    def b(c, lo, hi, bins):
        return F.least(F.floor((clean(c) - F.lit(lo)) / F.lit((hi - lo) / bins if hi > lo else 1.0)), F.lit(bins - 1)).cast("int")

    kept = df.filter(clean(x).isNotNull() & clean(y).isNotNull())
    return kept.groupBy(b(x, r["x0"], r["x1"], bins_x).alias("bx"), b(y, r["y0"], r["y1"], bins_y).alias("by")).count()


def augmentation_comparison(original: DataFrame, augmented: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows, and per feature mean and std (ddof 1) of original vs augmented."""
    def stats(df, tag):
        return melt(df, features).groupBy("k").agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.avg("v").alias(f"mean_{tag}"),
                                                   F.stddev_samp("v").alias(f"std_{tag}"))
    return stats(original, "original").join(stats(augmented, "augmented"), "k").select(
        name_of(list(features)).alias("feature"), "n_original", "n_augmented", "mean_original", "mean_augmented", "std_original", "std_augmented")


def test_level(r2: F.Column) -> F.Column:
    """Overall level of a test R2 (0.8 / 0.6 / 0.4)."""
    return bands.level(r2, bands.TEST_LEVELS, bands.LEVEL_NAMES)


def error_means(errors: DataFrame, cols: Sequence[str] = ("absolute_error", "relative_error_pct")) -> DataFrame:
    """Rows and mean of each error distribution (rows without the error are left out)."""
    cols = list(cols)
    return melt(errors, cols).groupBy("k").agg(F.count("v").alias("n"), F.avg("v").alias("mean")).select(name_of(cols).alias("column"), "n", "mean")


def axis_range(df: DataFrame, x: str, y: str, pad: float = 0.05) -> DataFrame:
    """Shared axis range over truth and prediction, padded."""
    lo = F.least(F.min(clean(x)), F.min(clean(y)))
    hi = F.greatest(F.max(clean(x)), F.max(clean(y)))
    return df.agg(lo.alias("lo"), hi.alias("hi")).select((F.col("lo") - pad * (F.col("hi") - F.col("lo"))).alias("axis_min"),
                                                        (F.col("hi") + pad * (F.col("hi") - F.col("lo"))).alias("axis_max"))


def prediction_fit(df: DataFrame, y: str, pred: str) -> DataFrame:
    """R2, rows and the unpadded shared range of truth and prediction in one aggregate."""
    t, p = clean(y), clean(pred)
    return df.agg(r2_expr(F.when(p.isNotNull(), t), F.when(t.isNotNull(), p)).alias("r2"), F.count(t - p).alias("n"),
                  F.least(F.min(t), F.min(p)).alias("axis_min"), F.greatest(F.max(t), F.max(p)).alias("axis_max"))
