"""Scoring and error reports.

A fitted chain is a ``PipelineModel`` (scaler + predictor stages), so
batch and stream scoring share one code path; reports are single aggregates
or narrow projections over the scored rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.columns import clean, q
from ..functions.stats import r2_expr, safe_corr


class LinearPredictor(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Prediction stage for coefficients fitted from sums: pred = b + sum w_i x_i."""

    features = Param(Params._dummy(), "features", "feature columns", typeConverter=TypeConverters.toListString)
    coefficients = Param(Params._dummy(), "coefficients", "coefficients", typeConverter=TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", typeConverter=TypeConverters.toFloat)
    predictionCol = Param(Params._dummy(), "predictionCol", "output column", typeConverter=TypeConverters.toString)

    def __init__(self, features=None, coefficients=None, intercept=None, predictionCol="prediction") -> None:
        super().__init__()
        self._setDefault(features=[], coefficients=[], intercept=0.0, predictionCol="prediction")
        self._set(**{k: v for k, v in dict(features=features, coefficients=coefficients, intercept=intercept,
                                          predictionCol=predictionCol).items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fs = self.getOrDefault(self.features)
        ws = self.getOrDefault(self.coefficients)
        pred = F.lit(self.getOrDefault(self.intercept)) + sum((F.lit(w) * clean(f) for f, w in zip(fs, ws)), F.lit(0.0))
        return dataset.withColumn(self.getOrDefault(self.predictionCol), pred)


def prepare(df: DataFrame, features: Sequence[str], scaler: Model | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """L1: select the features (in training order) and apply the training scaler."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"scoring table lacks features {missing}")
    out = df.select(*[q(c) for c in keep], *[clean(f).alias(f) for f in features])
    return scaler.transform(out) if scaler is not None else out


def prediction_summary(scored: DataFrame, pred: str = "prediction") -> DataFrame:
    """L2: count, mean, std (ddof 0), min, max of the predictions."""
    p = clean(pred)
    return scored.agg(F.count(p).alias("n"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"))


def performance_metrics(scored: DataFrame, y: str, pred: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """L3: R2, RMSE, MAE, MAPE (y = 0 skipped; inf if every y is 0), residual
    mean and std (ddof 0), correlation and n, in one aggregate."""
    t, p = clean(y), clean(pred)
    res = t - p
    mape = F.avg(F.when(t != 0, F.abs(res / t))) * 100
    aggs = [
        r2_expr(t, p).alias("r2"),
        F.sqrt(F.avg(res * res)).alias("rmse"),
        F.avg(F.abs(res)).alias("mae"),
        F.coalesce(mape, F.lit(float("inf"))).alias("mape"),
        F.avg(res).alias("mean_residual"),
        F.stddev_pop(res).alias("std_residual"),
        safe_corr(t, p).alias("correlation"),
        F.count(res).alias("n"),
    ]
    return scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)


def error_table(scored: DataFrame, key: str, y: str, pred: str = "prediction") -> DataFrame:
    """L4: per row truth, prediction, residual, abs error, relative error % (NULL when y = 0)."""
    t, p = clean(y), clean(pred)
    return scored.select(
        q(key), t.alias("true_value"), p.alias("predicted_value"), (t - p).alias("residual"), F.abs(t - p).alias("absolute_error"),
        (F.abs(F.try_divide(t - p, t)) * 100).alias("relative_error_pct"),
    )


def grade(pred: str = "prediction") -> F.Column:
    """L7 grade of a predicted value."""
    return bands.level(clean(pred), bands.GRADE_LEVELS, bands.GRADE_NAMES)


def feature_ranges(df: DataFrame, features: Sequence[str], fallback: dict | None = None) -> DataFrame:
    """Accepted (min, max) per feature, midpoint default; ``fallback`` fills features with no data."""
    fallback = fallback or {}
    r = df.agg(*[x for i, f in enumerate(features) for x in (F.min(clean(f)).alias(f"lo{i}"), F.max(clean(f)).alias(f"hi{i}"))]).first()
    rows = []
    for i, f in enumerate(features):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        if lo is None and f in fallback:
            lo, hi = fallback[f]
        rows.append((f, lo, hi, (lo + hi) / 2 if lo is not None else None))
    return df.sparkSession.createDataFrame(rows, "feature string, min double, max double, default double")


def out_of_range(scored: DataFrame, ranges: DataFrame) -> DataFrame:
    """L8 flag on scored rows: any feature outside its accepted range."""
    rs = {r["feature"]: (r["min"], r["max"]) for r in ranges.collect()}
    conds = [(clean(f) < F.lit(lo)) | (clean(f) > F.lit(hi)) for f, (lo, hi) in rs.items() if lo is not None]
    flag = F.coalesce(F.greatest(*conds), F.lit(False)) if len(conds) > 1 else (F.coalesce(conds[0], F.lit(False)) if conds else F.lit(False))
    return scored.withColumn("out_of_range", flag)


def consistency(train_cols: Sequence[str], score_cols: Sequence[str], has_scaler: bool = True) -> dict:
    """Missing and extra names between training and scoring schemas."""
    a, b = set(train_cols), set(score_cols)
    return {"missing": sorted(a - b), "extra": sorted(b - a), "scaler": has_scaler, "ok": not (a - b) and has_scaler}
