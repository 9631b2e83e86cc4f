"""Imputation.

Fitting is aggregate-only (regression coefficients, means, medians, modes,
correlations), so fills are literal ``coalesce``/``when`` projections; the
KNN fill is the exact bucketed search of :mod:`knn` joined back on the key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean, melt, numeric_columns, q
from ..functions.stats import safe_corr
from .knn import knn_average
from .quantiles import quantiles
from .sums import gram


def regression_fill(df: DataFrame, target: str, predictor: str) -> tuple[DataFrame, dict]:
    """least-squares fill of ``target`` from one ``predictor``.

    Fitted on rows where both exist; fills only where the target is missing
    and the predictor present.  Report: r, slope, intercept, r2, rows used,
    cells filled.
    """
    a, b = clean(target), clean(predictor)
    st = df.agg(
        F.regr_slope(a, b).alias("slope"),
        F.regr_intercept(a, b).alias("intercept"),
        F.regr_r2(a, b).alias("r2"),
        safe_corr(a, b).alias("r"),
        F.regr_count(a, b).alias("n_fit"),
        F.count(F.when(a.isNull() & b.isNotNull(), 1)).alias("n_filled"),
    ).first().asDict()
    if st["slope"] is None:
        return df, st
    fill = F.when(a.isNull() & b.isNotNull(), F.lit(st["intercept"]) + F.lit(st["slope"]) * b).otherwise(a)
    return df.withColumn(target, fill), st


def _fill_values(df: DataFrame, fills: dict) -> DataFrame:
    return df.select(
        *[F.coalesce(clean(f.name), F.lit(fills[f.name])).alias(f.name) if fills.get(f.name) is not None
          and isinstance(f.dataType, T.NumericType)
          else (F.coalesce(q(f.name), F.lit(fills[f.name])).alias(f.name) if fills.get(f.name) is not None else q(f.name))
          for f in df.schema.fields]
    )


def mean_fill(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict]:
    """mean of the present values."""
    cols = list(cols)
    rows = melt(df, cols).groupBy("k").agg(F.avg("v").alias("m")).collect()
    fills = {cols[r["k"]]: r["m"] for r in rows}
    return _fill_values(df, fills), fills


def median_fill(df: DataFrame, cols: Sequence[str], exact: bool = True) -> tuple[DataFrame, dict]:
    """interpolated median (exact by default)."""
    fills = {c: v[0] for c, v in quantiles(df, cols, [0.5], exact=exact).items()}
    return _fill_values(df, fills), fills


def mode_values(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent value per column, smallest on ties (None if all missing).

    ``groupBy(column, value).count()`` is a distributed, map-side combined
    count; the winner per column is a ``min_by`` over (-count, value), so no
    task ever holds a whole column's value map.
    """
    out = {}
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in cols if isinstance(types[c], T.NumericType)]
    oth = [c for c in cols if c not in num]
    if num:
        counts = melt(df, num).filter(F.col("v").isNotNull()).groupBy("k", "v").count()
        best = counts.groupBy("k").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("m")).collect()
        out.update({num[r["k"]]: r["m"] for r in best})
    for c in oth:
        r = (
            df.filter(q(c).isNotNull()).groupBy(q(c).alias("v")).count()
            .agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("m")).first()
        )
        out[c] = r["m"] if r else None
    return {c: out.get(c) for c in cols}


def mode_fill(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict]:
    """mode fill; 0 when a numeric column has no value at all."""
    types = {f.name: f.dataType for f in df.schema.fields}
    fills = mode_values(df, cols)
    fills = {c: (0 if v is None and isinstance(types[c], T.NumericType) else v) for c, v in fills.items()}
    return _fill_values(df, fills), fills


def choose_strategy(df: DataFrame, feature: str, threshold: float = 0.5) -> str:
    """mean if > 50 % missing; mode if non-numeric; regression if some
    abs(r) > threshold; knn if n > 20 and <= 10 other numeric columns; else mean."""
    types = {f.name: f.dataType for f in df.schema.fields}
    num = numeric_columns(df)
    others = [c for c in num if c != feature]
    x = clean(feature) if isinstance(types[feature], T.NumericType) else q(feature)
    aggs = [F.count(F.lit(1)).alias("n"), F.count(F.when(x.isNull(), 1)).alias("miss")]
    if isinstance(types[feature], T.NumericType) and others:
        aggs.append(F.array(*[F.abs(safe_corr(clean(feature), clean(c))) for c in others]).alias("r"))
    st = df.agg(*aggs).first()
    n = st["n"]
    if n == 0 or st["miss"] / n > 0.5:
        return "mean"
    if not isinstance(types[feature], T.NumericType):
        return "mode"
    rs = [v for v in (st["r"] or []) if v is not None and not np.isnan(v)] if others else []
    if rs and max(rs) > threshold:
        return "regression"
    if n > 20 and len(others) <= 10:
        return "knn"
    return "mean"


def multi_regression(df: DataFrame, target: str, n_predictors: int = 3, min_rows: int = 5) -> tuple[float, dict[str, float]]:
    """F8: intercept and coefficients of the most correlated numeric columns.

    A column that is missing on every row where the target is missing could never
    fill a gap, so it is no predictor.
    """
    others = [c for c in numeric_columns(df) if c != target]
    if not others:
        raise ValueError("no predictor columns")
    gap = clean(target).isNull()
    r = df.agg(*[F.abs(safe_corr(clean(target), clean(c))).alias(f"r{i}") for i, c in enumerate(others)], F.count(F.when(gap, 1)).alias("gaps"),
               *[F.count(F.when(gap & clean(c).isNotNull(), 1)).alias(f"n{i}") for i, c in enumerate(others)]).first()
    ranked = sorted(((r[f"r{i}"], i) for i in range(len(others)) if r[f"r{i}"] is not None and (r[f"n{i}"] or not r["gaps"])), key=lambda t: (-t[0], t[1]))
    preds = [others[i] for _, i in ranked[:n_predictors]]
    if not preds:
        raise ValueError("no correlated predictor")
    g, centre = gram(df, preds + [target])
    m = g.get(0)
    if m is None or m[0, 0] < min_rows:
        raise ValueError("not enough complete rows")
    beta, intercept = _solve(m, centre, len(preds))
    return intercept, {p: float(b) for p, b in zip(preds, beta)}


def multi_regression_fill(df: DataFrame, target: str, n_predictors: int = 3, min_rows: int = 5) -> tuple[DataFrame, dict]:
    """F8: fill from the ``n_predictors`` most correlated numeric columns.

    Least squares on complete rows from the Gram matrix (one distributed
    pass, a (p+2)^2 matrix back); fails if predictors are missing where the
    target is missing, or with fewer than ``min_rows`` complete rows.
    """
    intercept, coef = multi_regression(df, target, n_predictors, min_rows)
    preds, beta = list(coef), list(coef.values())
    lacks = F.greatest(*[clean(p).isNull() for p in preds]) if len(preds) > 1 else clean(preds[0]).isNull()
    bad = df.filter(clean(target).isNull() & lacks).limit(1).count()
    if bad:
        raise ValueError("predictors missing where the target is missing")
    pred = F.lit(intercept) + sum((F.lit(b) * clean(p) for b, p in zip(beta, preds)), F.lit(0.0))
    out = df.withColumn(target, F.coalesce(clean(target), pred))
    return out, {"predictors": preds, "coef": beta, "intercept": intercept}


def _solve(m: np.ndarray, centre: Sequence[float], p: int, ridge: float = 0.0) -> tuple[np.ndarray, float]:
    """OLS from Z'Z of [1, x_1..x_p, y] on centred columns."""
    n = m[0, 0]
    sx = m[0, 1 : p + 1]
    sy = m[0, p + 1]
    sxx = m[1 : p + 1, 1 : p + 1] - np.outer(sx, sx) / n
    sxy = m[1 : p + 1, p + 1] - sx * sy / n
    beta = np.linalg.lstsq(sxx + ridge * np.eye(p), sxy, rcond=None)[0]
    mx = sx / n + np.asarray(centre[:p])
    my = sy / n + centre[p]
    return beta, float(my - beta @ mx)


def knn_fill(
    df: DataFrame,
    key: str,
    cols: Sequence[str],
    k: int = 5,
    pivot: str | None = None,
    fallback_mean: bool = True,
    per_bucket: int = 256,
) -> DataFrame:
    """every missing cell of ``cols`` becomes the mean of its k nearest
    donors under the NaN-aware Euclidean distance over ``cols``.

    Cells of the search use all known columns, so ``pivot`` has no effect.
    No usable donor -> column mean.
    """
    cols = list(cols)
    missing_any = F.greatest(*[clean(c).isNull() for c in cols]) if len(cols) > 1 else clean(cols[0]).isNull()
    receivers = df.filter(missing_any)
    got = knn_average(receivers, df, key, cols, cols, k=k, per_bucket=per_bucket)
    filled = got.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("target", "value"))).alias("_fill"))
    means = mean_fill(df, cols)[1] if fallback_mean else {}
    out = df.join(filled, key, "left")
    return out.select(
        *[
            F.coalesce(clean(f.name), F.col("_fill")[f.name], F.lit(means.get(f.name))).alias(f.name) if f.name in cols else q(f.name)
            for f in df.schema.fields
        ]
    )


def apply_strategy(df: DataFrame, feature: str, strategy: str, key: str | None = None) -> tuple[DataFrame, str]:
    """run one strategy; a strategy whose preconditions fail falls back to mean, and says so."""
    try:
        if strategy == "mean":
            return mean_fill(df, [feature])[0], "mean"
        if strategy == "median":
            return median_fill(df, [feature])[0], "median"
        if strategy == "mode":
            return mode_fill(df, [feature])[0], "mode"
        if strategy == "regression":
            return multi_regression_fill(df, feature)[0], "regression"
        if strategy == "knn":
            if key is None:
                raise ValueError("knn needs a key column")
            cols = numeric_columns(df, exclude=[key])
            return knn_fill(df, key, cols, k=max(1, min(5, df.count() - 1))), "knn"
        raise ValueError(f"unknown strategy {strategy}")
    except ValueError as e:
        return mean_fill(df, [feature])[0], f"mean (fallback: {e})"


def imputation_check(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> dict:
    """Shape unchanged, remaining missing cells, before/after missing counts."""
    def miss(d):
        r = d.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(clean(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        return r["n"], sum(r[f"m{i}"] for i in range(len(cols)))

    nb, mb = miss(before)
    na, ma = miss(after)
    return {"rows_before": nb, "rows_after": na, "shape_ok": nb == na and len(before.columns) == len(after.columns),
            "missing_before": mb, "missing_after": ma}


def handle_missing(df: DataFrame, key: str, target: str, predictor: str, knn_reference: Sequence[str] = (), k: int = 5) -> tuple[DataFrame, dict]:
    """F1 regression fill, then KNN over the still-missing columns plus
    reference columns (mean fill if fewer than two columns), then B9."""
    step1, reg = regression_fill(df, target, predictor)
    num = numeric_columns(step1, exclude=[key])
    counts = step1.agg(*[F.count(F.when(clean(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(num)]).first()
    missing_cols = [c for i, c in enumerate(num) if counts[f"m{i}"] > 0]
    report = {"regression": reg, "knn_columns": []}
    if not missing_cols:
        out = step1
    else:
        feats = list(dict.fromkeys(missing_cols + [c for c in knn_reference if c in step1.columns]))
        if len(feats) >= 2:
            out = knn_fill(step1, key, feats, k=k)
            report["knn_columns"] = feats
        else:
            out = mean_fill(step1, missing_cols)[0]
    report["check"] = imputation_check(df, out, num)
    return out, report
