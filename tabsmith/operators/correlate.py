"""Pearson correlation tables (E1-E6), long form.

E1 uses the one-pass pairwise-complete sums of :func:`sums.pair_sums`, so any
number of columns costs two scans (centres, sums) instead of one aggregate per
pair.  A column that is constant over the shared rows gives NULL, never an
error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean, explode_structs
from ..functions.stats import safe_corr
from .sums import pair_sums


def _name(cols: Sequence[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in cols]), idx + 1)


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, pos_a, pos_b, n, r) for every pair pos_a < pos_b."""
    cols = list(cols)
    s = pair_sums(df, cols)
    vxx = F.col("n") * F.col("saa") - F.col("sa") * F.col("sa")
    vyy = F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb")
    cov = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    ok = (vxx > F.lit(1e-12) * F.col("n") * F.col("saa")) & (vyy > F.lit(1e-12) * F.col("n") * F.col("sbb"))
    r = F.when(ok, F.try_divide(cov, F.sqrt(vxx) * F.sqrt(vyy)))
    return s.select(
        _name(cols, F.col("i")).alias("feature_a"),
        _name(cols, F.col("j")).alias("feature_b"),
        F.col("i").alias("pos_a"),
        F.col("j").alias("pos_b"),
        F.col("n").cast("long").alias("n"),
        F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)).alias("r"),
    )


def strong_pairs(corr: DataFrame, threshold: float = 0.5, top: int | None = None) -> DataFrame:
    """Pairs with abs(r) > threshold, strongest first; a plot may ask for the ``top`` ones."""
    out = corr.filter(F.abs("r") > threshold).orderBy(F.desc(F.abs("r")), "pos_a", "pos_b")
    return out.limit(top) if top else out


def high_pairs(corr: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs with abs(r) >= threshold in column order."""
    return corr.filter(F.abs("r") >= threshold).orderBy("pos_a", "pos_b")


def corr_with(df: DataFrame, target: str, cols: Sequence[str], k: int | None = 3) -> DataFrame:
    """Abs correlation of ``target`` with each column, strongest ``k``."""
    t = clean(target)
    structs = [
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("pos"), F.abs(safe_corr(t, clean(c))).alias("abs_r"))
        for i, c in enumerate(cols)
        if c != target
    ]
    out = explode_structs(df, structs).filter(F.col("abs_r").isNotNull()).orderBy(F.desc("abs_r"), "pos")
    return out.limit(k) if k else out


def correlation_change(original: DataFrame, augmented: DataFrame) -> DataFrame:
    """E5: augmented minus original r for each pair (inner match on the pair)."""
    a = augmented.select("feature_a", "feature_b", F.col("r").alias("r_augmented"))
    o = original.select("feature_a", "feature_b", F.col("r").alias("r_original"))
    return o.join(a, ["feature_a", "feature_b"]).select(
        "feature_a", "feature_b", "r_original", "r_augmented", (F.col("r_augmented") - F.col("r_original")).alias("r_change")
    )


def selected_submatrix(corr: DataFrame, selected: DataFrame) -> DataFrame:
    """Correlations among the selected features, strict lower triangle.

    ``selected`` has a ``feature`` column; semi joins keep pairs whose both
    ends are selected; rows are reported as (row = later column, col = earlier).
    """
    sel = selected.select(F.col("feature"))
    x = corr.join(sel.withColumnRenamed("feature", "feature_a"), "feature_a", "left_semi")
    x = x.join(sel.withColumnRenamed("feature", "feature_b"), "feature_b", "left_semi")
    return x.select(
        F.col("feature_b").alias("row_feature"),
        F.col("feature_a").alias("col_feature"),
        F.col("pos_b").alias("row_pos"),
        F.col("pos_a").alias("col_pos"),
        "r",
    )
