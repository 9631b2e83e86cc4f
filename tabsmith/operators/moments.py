"""Moments and distribution labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.columns import explode_structs, melt, name_of, numeric_columns
from ..functions.stats import kurt_sample, skew_sample


def skew_kurtosis(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Bias-adjusted skewness and excess kurtosis per column, one scan."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    v = F.col("v")
    return (
        melt(df, cols)
        .groupBy("k")
        .agg(skew_sample(v).alias("skewness"), kurt_sample(v).alias("kurtosis"))
        .select(name_of(cols).alias("feature"), "skewness", "kurtosis")
    )


def distribution_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Feature, skewness + label (D2), kurtosis + label (D3)."""
    m = skew_kurtosis(df, cols)
    return m.select(
        "feature",
        "skewness",
        bands.skew_label(F.col("skewness")).alias("skewness_interpretation"),
        "kurtosis",
        bands.kurt_label(F.col("kurtosis")).alias("kurtosis_interpretation"),
    )


# D6 bands: the summary closes its intervals differently from the D2/D3 labels.
SKEW_SUMMARY_BANDS = [
    ("severe_right", lambda s: s > 2),
    ("moderate_right", lambda s: (s > 1) & (s <= 2)),
    ("light_right", lambda s: (s > 0.5) & (s <= 1)),
    ("symmetric", lambda s: (s >= -0.5) & (s <= 0.5)),
    ("light_left", lambda s: (s >= -1) & (s < -0.5)),
    ("moderate_left", lambda s: (s >= -2) & (s < -1)),
    ("severe_left", lambda s: s < -2),
]
KURT_SUMMARY_BANDS = [
    ("high_peak", lambda k: k > 3),
    ("normal_peak", lambda k: (k >= 0) & (k <= 3)),
    ("low_peak", lambda k: k < 0),
]


def band_counts(moments: DataFrame) -> DataFrame:
    """Number of features per skew band and kurtosis band (all bands listed)."""
    structs = []
    for name, rule in SKEW_SUMMARY_BANDS:
        structs.append(F.struct(F.lit("skewness").alias("measure"), F.lit(name).alias("band"), F.count(F.when(rule(F.col("skewness")), 1)).alias("n_features")))
    for name, rule in KURT_SUMMARY_BANDS:
        structs.append(F.struct(F.lit("kurtosis").alias("measure"), F.lit(name).alias("band"), F.count(F.when(rule(F.col("kurtosis")), 1)).alias("n_features")))
    return explode_structs(moments, structs)


def moment_summary(moments: DataFrame) -> DataFrame:
    """Mean, std (ddof 1), min, max, median of the skew and kurtosis columns.

    ``moments`` has one row per feature, so the median's input is bounded by
    the column count.
    """
    structs = []
    for m in ("skewness", "kurtosis"):
        c = F.col(m)
        structs.append(
            F.struct(
                F.lit(m).alias("measure"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
                F.median(c).alias("median"),
            )
        )
    return explode_structs(moments, structs)
