"""Data-quality profile.

A profile stage scans the table once.  Per-column statistics use the long
form (``melt`` = one Expand, then ``groupBy`` on the column index), so the
partial aggregate holds one buffer per column however wide the table is;
table-level summaries are a single ``agg`` turned into rows by exploding an
array of structs.  Results stay DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean, explode_structs, melt, name_of, numeric_columns, q
from ..functions.stats import kurt_sample, skew_sample
from .quantiles import quantiles


def _missing(name: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return clean(name).isNull()
    return q(name).isNull()


def basic_info(df: DataFrame) -> DataFrame:
    """Rows, columns and column counts per type family (one row)."""
    fields = df.schema.fields
    n_num = sum(isinstance(f.dataType, T.NumericType) for f in fields)
    n_str = sum(isinstance(f.dataType, T.StringType) for f in fields)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(fields)).cast("bigint").alias("n_columns"),
        F.lit(n_num).cast("bigint").alias("n_numeric"),
        F.lit(n_str).cast("bigint").alias("n_string"),
        F.lit(len(fields) - n_num - n_str).cast("bigint").alias("n_other"),
    )


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing cells per column (NaN counts as missing), percent of rows."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols) if cols is not None else list(df.columns)
    flags = melt(df, cols, value=lambda c: _missing(c, types[c]).cast("long"))
    return (
        flags.groupBy("k")
        .agg(F.sum("v").alias("missing_count"), F.try_divide(F.sum("v") * 100.0, F.count(F.lit(1))).alias("missing_pct"))
        .select(name_of(cols).alias("column"), "missing_count", "missing_pct")
        .orderBy(F.desc("missing_count"), "column")
    )


def zero_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Exact zeros per numeric column."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    zero = F.count(F.when(F.col("v") == 0, 1))
    return (
        melt(df, cols)
        .groupBy("k")
        .agg(zero.alias("zero_count"), F.try_divide(zero * 100.0, F.count(F.lit(1))).alias("zero_pct"))
        .select(name_of(cols).alias("column"), "zero_count", "zero_pct")
        .orderBy(F.desc("zero_count"), "column")
    )


def value_ranges(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Min, max, mean, std (ddof 1), range; NULLs and NaNs ignored."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    v = F.col("v")
    return (
        melt(df, cols)
        .groupBy("k")
        .agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
        .select(name_of(cols).alias("column"), "min", "max", "mean", "std", (F.col("max") - F.col("min")).alias("range"))
    )


def skew_bands(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """C4: features with abs(skew) > 2 (severe) and in (1, 2] (moderate)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    sk = [F.abs(skew_sample(clean(c))) for c in cols]
    return df.agg(
        sum((F.coalesce((s > 2).cast("long"), F.lit(0)) for s in sk), F.lit(0).cast("long")).alias("severe_skew"),
        sum((F.coalesce(((s > 1) & (s <= 2)).cast("long"), F.lit(0)) for s in sk), F.lit(0).cast("long")).alias("moderate_skew"),
    )


def quality_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The eight-line summary (metric, value) from one scan."""
    num = list(cols) if cols is not None else numeric_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    n = F.count(F.lit(1))
    miss = sum((F.sum(_missing(c, types[c]).cast("long")) for c in df.columns), F.lit(0).cast("long"))
    zeros = sum((F.count(F.when(clean(c) == 0, 1)) for c in num), F.lit(0).cast("long"))
    sk = [F.abs(skew_sample(clean(c))) for c in num]
    severe = sum((F.coalesce((s > 2).cast("long"), F.lit(0)) for s in sk), F.lit(0).cast("long"))
    moderate = sum((F.coalesce(((s > 1) & (s <= 2)).cast("long"), F.lit(0)) for s in sk), F.lit(0).cast("long"))
    ncols = len(df.columns)
    rows = [
        ("rows", n.cast("double")),
        ("columns", F.lit(float(ncols))),
        ("missing_cells", miss.cast("double")),
        ("missing_pct", F.try_divide(miss * 100.0, n * ncols)),
        ("zero_cells", zeros.cast("double")),
        ("severe_skew_features", severe.cast("double")),
        ("moderate_skew_features", moderate.cast("double")),
        ("numeric_columns", F.lit(float(len(num)))),
    ]
    return explode_structs(df, [F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in rows])


def quality_check(df: DataFrame, cols: Sequence[str], multiplier: float = 1.5, exact: bool = True) -> DataFrame:
    """Missing, infinite, zero-variance flag and IQR outliers per feature.

    Quartiles are fitted first (small literals), then one conditional ``agg``.
    """
    qs = quantiles(df, cols, [0.25, 0.75], exact=exact)
    structs = []
    for c in cols:
        raw = q(c).cast("double")
        v = clean(c)
        q1, q3 = qs[c]
        if q1 is None:
            out = F.lit(0).cast("long")
        else:
            iqr = q3 - q1
            lo, hi = q1 - multiplier * iqr, q3 + multiplier * iqr
            out = F.count(F.when((v < F.lit(lo)) | (v > F.lit(hi)), 1))
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.when(F.isnan(raw) | raw.isNull(), 1)).alias("missing"),
                F.count(F.when(F.abs(raw) == F.lit(float("inf")), 1)).alias("infinite"),
                F.coalesce(F.stddev_pop(v) == 0, F.lit(True)).alias("zero_variance"),
                out.alias("iqr_outliers"),
            )
        )
    return explode_structs(df, structs)


def feature_statistics(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Mean, std (ddof 0), min, max, median, q25, q75, skew, kurtosis."""
    cols = list(cols)
    qs = quantiles(df, cols, [0.5, 0.25, 0.75], exact=exact)
    v = F.col("v")
    lookup = lambda j: F.element_at(F.array(*[F.lit(qs[c][j]).cast("double") for c in cols]), F.col("k") + 1)
    return (
        melt(df, cols)
        .groupBy("k")
        .agg(
            F.avg(v).alias("mean"),
            F.stddev_pop(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            skew_sample(v).alias("skewness"),
            kurt_sample(v).alias("kurtosis"),
        )
        .select(
            name_of(cols).alias("column"), "mean", "std", "min", "max",
            lookup(0).alias("median"), lookup(1).alias("q25"), lookup(2).alias("q75"), "skewness", "kurtosis",
        )
    )


def data_summary(df: DataFrame, features: Sequence[str], target: str, exact: bool = True) -> DataFrame:
    """Target mean/std/min/max/median plus per-feature mean/std(ddof 0)/min/max.

    Long table (role, column, mean, std, min, max, median); median only for
    the target.
    """
    med = quantiles(df, [target], [0.5], exact=exact)[target][0]
    y = clean(target)
    structs = [
        F.struct(
            F.lit("target").alias("role"),
            F.lit(target).alias("column"),
            F.avg(y).alias("mean"),
            F.stddev_pop(y).alias("std"),
            F.min(y).alias("min"),
            F.max(y).alias("max"),
            F.lit(med).cast("double").alias("median"),
        )
    ]
    for c in features:
        v = clean(c)
        structs.append(
            F.struct(
                F.lit("feature").alias("role"),
                F.lit(c).alias("column"),
                F.avg(v).alias("mean"),
                F.stddev_pop(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                F.lit(None).cast("double").alias("median"),
            )
        )
    return explode_structs(df, structs)
