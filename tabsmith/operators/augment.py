"""Noise augmentation (I3-I5) and its check.

Copies are generated with ``explode(sequence(0, factor-1))`` (a generator,
no join), every draw is a keyed hash of (seed, round, column, key), so the
augmented table is reproducible under any partitioning and recomputation.
Statistics (mean, std ddof 0, min, max) come from one aggregate and enter
the projection as literals.

Fixed values from the reference configuration: 3 noisy copies, feature noise
intensity 0.05 growing by 2 % per round, target noise intensity 0.015 growing
by 0.5 % per round; feature noise = 0.7 * normal + 0.3 * uniform; features
clamped to [min - 0.2 range, max + 0.2 range]; target clamped to
[max(0.8 min, 0.1), max + 0.05 range].
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean, explode_structs, q
from ..functions.randomness import normal, uniform

FACTOR = 3
FEATURE_INTENSITY = 0.05
FEATURE_GROWTH = 0.02
TARGET_INTENSITY = 0.015
TARGET_GROWTH = 0.005


def _stats(df: DataFrame, cols: Sequence[str]) -> dict:
    aggs = []
    for i, c in enumerate(cols):
        v = clean(c)
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    r = df.agg(*aggs).first()
    return {c: {"mean": r[f"m{i}"], "std": r[f"s{i}"] or 0.0, "min": r[f"lo{i}"], "max": r[f"hi{i}"]} for i, c in enumerate(cols)}


def augment(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    target: str,
    factor: int = FACTOR,
    seed: int = 42,
    stats: dict | None = None,
) -> DataFrame:
    """Original rows (aug_round = -1) plus ``factor`` noisy copies (0..factor-1)."""
    features = list(features)
    st = stats or _stats(df, features + [target])
    base = df.select(q(key), *[clean(c).alias(c) for c in features], clean(target).alias(target))
    orig = base.withColumn("aug_round", F.lit(-1))
    rounds = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("aug_round"))
    rnd = F.col("aug_round")
    cols = [q(key)]
    for c in features:
        s = st[c]
        rng = (s["max"] - s["min"]) if s["min"] is not None else 0.0
        inten = F.lit(FEATURE_INTENSITY) * (1 + rnd * FEATURE_GROWTH)
        noise = 0.7 * normal(seed, rnd, c, q(key)) * F.lit(s["std"]) * inten + 0.3 * (
            (uniform(seed, rnd, c, "u", q(key)) - 0.5) * F.lit(rng) * inten
        )
        lo, hi = (s["min"] - 0.2 * rng, s["max"] + 0.2 * rng) if s["min"] is not None else (None, None)
        cols.append(F.least(F.greatest(F.col(c) + noise, F.lit(lo)), F.lit(hi)).alias(c))
    t = st[target]
    t_inten = F.lit(TARGET_INTENSITY) * (1 + rnd * TARGET_GROWTH)
    tn = normal(seed, rnd, target, q(key)) * F.lit(t["std"]) * t_inten
    if t["min"] is None:  # no target value, so no noisy rows
        return orig
    t_lo = max(0.8 * t["min"], 0.1)
    t_hi = t["max"] + 0.05 * (t["max"] - t["min"])
    cols.append(F.least(F.greatest(F.col(target) + tn, F.lit(t_lo)), F.lit(t_hi)).alias(target))
    noisy = rounds.select(*cols, rnd)
    return orig.unionByName(noisy)


def augmentation_check(original: DataFrame, augmented: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Per column mean and std (ddof 1) shift in percent of abs(original);
    ok when < 10 % / < 20 % for features and < 5 % / < 15 % for the target."""
    cols = list(features) + [target]
    a = _stats2(original, cols)
    b = _stats2(augmented, cols)
    rows = []
    for c in cols:
        mo, so = a[c]
        ma, sa = b[c]
        md = abs(ma - mo) / abs(mo) * 100 if mo else None
        sd = abs(sa - so) / abs(so) * 100 if so else None
        lim = (5.0, 15.0) if c == target else (10.0, 20.0)
        ok = md is not None and sd is not None and md < lim[0] and sd < lim[1]
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(md).cast("double").alias("mean_shift_pct"),
                             F.lit(sd).cast("double").alias("std_shift_pct"), F.lit(ok).alias("ok")))
    return explode_structs(original.limit(1), rows)


def _stats2(df: DataFrame, cols: Sequence[str]) -> dict:
    r = df.agg(*[x for i, c in enumerate(cols) for x in (F.avg(clean(c)).alias(f"m{i}"), F.stddev_samp(clean(c)).alias(f"s{i}"))]).first()
    return {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(cols)}
