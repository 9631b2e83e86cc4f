"""Aggregate expressions with the reference's statistical conventions.

* skewness / kurtosis are the bias-adjusted (sample) estimators, while Spark's
  built-ins are the population ones; the adjustment is applied here.
* correlation is pairwise-complete and NULL (not an error) on a constant column.
* every division goes through ``try_divide`` because ANSI mode raises on x/0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _n(c: Column) -> Column:
    return F.count(c).cast("double")


def skew_sample(c: Column) -> Column:
    """G1 = g1 * sqrt(n(n-1)) / (n-2); NULL for n < 3 or a constant column."""
    n = _n(c)
    return F.try_divide(F.skewness(c) * F.sqrt(n * (n - 1)), n - 2)


def kurt_sample(c: Column) -> Column:
    """G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6); NULL for n < 4 or constant."""
    n = _n(c)
    return F.try_divide((n - 1) * ((n + 1) * F.kurtosis(c) + 6), (n - 2) * (n - 3))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson r over rows where both are present; NULL on zero variance."""
    a2 = F.when(b.isNotNull(), a)
    b2 = F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a2) * F.stddev_pop(b2))


def std_pop(c: Column) -> Column:
    return F.stddev_pop(c)


def std_samp(c: Column) -> Column:
    return F.stddev_samp(c)


def r2_expr(y: Column, pred: Column) -> Column:
    """1 - SSE/SST over rows where both exist.

    SST comes from Spark's stable central-moment ``var_pop``; a constant truth
    gives 1 when the predictions are exact and 0 otherwise.
    """
    y2 = F.when(pred.isNotNull(), y)
    sse = F.sum((y - pred) * (y - pred))
    sst = F.var_pop(y2) * F.count(y2)
    return F.when(sst > 0, 1 - F.try_divide(sse, sst)).when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
