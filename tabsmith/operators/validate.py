"""Projections and validation checks (B1-B12) as single aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean, numeric_columns, q


def numeric_features(df: DataFrame, target: str | None = None) -> DataFrame:
    """B1: the numeric columns minus the target; fails without target or numeric columns."""
    if target is not None and target not in df.columns:
        raise ValueError(f"target {target!r} not found")
    cols = numeric_columns(df, exclude=[target] if target else [])
    if not cols:
        raise ValueError("no numeric feature columns")
    return df.select(*[q(c) for c in cols])


def subset_by_index(df: DataFrame, names: Sequence[str], idx: Sequence[int], target: str | None = None) -> DataFrame:
    """Columns at positions ``idx`` of ``names`` (bounds and duplicates checked), target appended."""
    if len(set(idx)) != len(idx):
        raise ValueError("duplicate feature indices")
    bad = [i for i in idx if i < 0 or i >= len(names)]
    if bad:
        raise ValueError(f"feature indices out of range: {bad}")
    cols = [names[i] for i in idx] + ([target] if target else [])
    return df.select(*[q(c) for c in cols])


def available_features(df: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """(available, missing) requested columns; fails when none is available."""
    have = [c for c in wanted if c in df.columns]
    miss = [c for c in wanted if c not in df.columns]
    if not have:
        raise ValueError("none of the requested features is present")
    return have, miss


def integrity(df: DataFrame, stage: str = "") -> dict:
    """Table must have rows and not be entirely missing (one aggregate)."""
    cols = df.columns
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(clean(c).isNull() if c in numeric_columns(df) else q(c).isNull(), 1)).alias(f"m{i}")
                                                for i, c in enumerate(cols)]).first()
    n = r["n"]
    miss = sum(r[f"m{i}"] for i in range(len(cols)))
    if n == 0:
        raise ValueError(f"{stage}: empty table")
    if miss == n * len(cols):
        raise ValueError(f"{stage}: every value is missing")
    return {"rows": n, "missing": miss}


def range_check(df: DataFrame, cols: Sequence[str], target: str | None = None) -> dict:
    """Infinities are errors, a negative target is a warning."""
    inf = [F.count(F.when(F.abs(q(c).cast("double")) == F.lit(float("inf")), 1)).alias(f"i{i}") for i, c in enumerate(cols)]
    neg = [F.count(F.when(clean(target) < 0, 1)).alias("neg")] if target else []
    r = df.agg(*inf, *neg).first()
    infs = {c: r[f"i{i}"] for i, c in enumerate(cols) if r[f"i{i}"]}
    if infs:
        raise ValueError(f"infinite values in {sorted(infs)}")
    return {"negative_target": r["neg"] if target else 0}


def matrix_check(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Per column NaN/NULL, infinities and zero variance, from one aggregate."""
    cols = list(features) + [target]
    structs = []
    for c in cols:
        raw = q(c).cast("double")
        structs.append(F.struct(F.lit(c).alias("column"), F.count(F.when(raw.isNull() | F.isnan(raw), 1)).alias("missing"),
                                F.count(F.when(F.abs(raw) == F.lit(float("inf")), 1)).alias("infinite"),
                                F.coalesce(F.stddev_pop(clean(c)) == 0, F.lit(True)).alias("zero_variance")))
    from ..functions.columns import explode_structs

    return explode_structs(df, structs)


def change_report(before: DataFrame, after: DataFrame, cols: Sequence[str], mean_pct: float = 1.0, std_pct: float = 5.0) -> DataFrame:
    """Columns whose mean moved more than ``mean_pct`` % or std (ddof 1) more than ``std_pct`` %
    (change 0 when the base is 0); the two aggregates are unpivoted and joined on the column."""
    from ..functions.columns import melt, name_of

    def stats(df, tag):
        return melt(df, cols).groupBy("k").agg(F.avg("v").alias(f"mean_{tag}"), F.stddev_samp("v").alias(f"std_{tag}"))

    j = stats(before, "before").join(stats(after, "after"), "k")
    dm = F.coalesce(F.try_divide(F.abs(F.col("mean_after") - F.col("mean_before")) * 100, F.abs(F.col("mean_before"))), F.lit(0.0))
    ds = F.coalesce(F.try_divide(F.abs(F.col("std_after") - F.col("std_before")) * 100, F.abs(F.col("std_before"))), F.lit(0.0))
    return j.select(name_of(list(cols)).alias("column"), "mean_before", "mean_after", dm.alias("mean_change_pct"),
                    "std_before", "std_after", ds.alias("std_change_pct")).filter((F.col("mean_change_pct") > mean_pct) | (F.col("std_change_pct") > std_pct))
