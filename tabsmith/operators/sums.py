"""Sufficient statistics in one distributed pass (K1 and the pairwise sums of E1).

Each partition reduces its Arrow batches with NumPy matrix products and emits
a handful of partial rows; Spark then sums the partials per key
(``groupBy``, map-side combined).  Nothing row-sized reaches the driver: what
comes back is a (p+2) x (p+2) matrix per group, bounded by the column count.

Columns are shifted by a per-column centre before squaring so that sums of
squares do not cancel catastrophically at 100 TB scale.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean


def _centres(df: DataFrame, cols: Sequence[str]) -> list[float]:
    row = df.agg(*[F.avg(clean(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return [float(row[f"m{i}"]) if row[f"m{i}"] is not None else 0.0 for i in range(len(cols))]


def gram(
    df: DataFrame,
    cols: Sequence[str],
    group: str | None = None,
    centre: Sequence[float] | None = None,
) -> tuple[dict, list[float]]:
    """Cross-product matrix of Z = [1, cols...] over complete rows, per group.

    Returns ``({group value: Z'Z as ndarray}, centre)``; entry [0,0] is n,
    [0,j] the centred sums, [i,j] the centred cross products.
    """
    cols = list(cols)
    k = len(cols) + 1
    if centre is None:
        centre = _centres(df, cols)
    names = [f"c{i}" for i in range(len(cols))]
    sel = [clean(c).alias(n) for c, n in zip(cols, names)]
    gcol = F.col(group).cast("bigint").alias("g") if group else F.lit(0).cast("bigint").alias("g")
    src = df.select(gcol, *sel).dropna()
    shift = np.asarray(centre, dtype=np.float64)

    def part(batches):
        import pandas as pd

        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            for g, sub in pdf.groupby("g", sort=False):
                x = sub[names].to_numpy(dtype=np.float64) - shift
                z = np.hstack([np.ones((x.shape[0], 1)), x])
                m = z.T @ z
                acc[g] = acc[g] + m if g in acc else m
        rows = [(int(g), i, m[i].tolist()) for g, m in acc.items() for i in range(k)]
        if rows:
            yield pd.DataFrame(rows, columns=["g", "i", "v"])

    partial = src.mapInPandas(part, "g long, i int, v array<double>")
    summed = partial.groupBy("g", "i").agg(
        F.array(*[F.sum(F.col("v")[j]) for j in range(k)]).alias("v")
    )
    out: dict = {}
    for r in summed.collect():
        out.setdefault(r["g"], np.zeros((k, k)))[r["i"]] = np.asarray(r["v"], dtype=np.float64)
    return out, list(centre)


def gram_runs(df: DataFrame, cols: Sequence[str], tags: str, centre: Sequence[float] | None = None) -> tuple[dict, list[float]]:
    """K1 for several groupings at once: ``tags`` is an array column with the row's group in each of them.

    Returns ``({(grouping, group): Z'Z}, centre)`` as ``gram`` does, from one scan: a
    row is read once and added to one matrix of each grouping.
    """
    cols = list(cols)
    k = len(cols) + 1
    if centre is None:
        centre = _centres(df, cols)
    names = [f"c{i}" for i in range(len(cols))]
    src = df.select(F.col(tags).cast("array<bigint>").alias("g"), *[clean(c).alias(n) for c, n in zip(cols, names)]).dropna()
    shift = np.asarray(centre, dtype=np.float64)

    def part(batches):
        import pandas as pd

        acc: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            x = pdf[names].to_numpy(dtype=np.float64) - shift
            z = np.hstack([np.ones((x.shape[0], 1)), x])
            for run, groups in enumerate(np.stack(pdf["g"].to_numpy()).T):
                for g in np.unique(groups):
                    own = z[groups == g]
                    m = own.T @ own
                    acc[run, g] = acc[run, g] + m if (run, g) in acc else m
        if acc:
            yield pd.DataFrame([(run, int(g), i, m[i].tolist()) for (run, g), m in acc.items() for i in range(k)], columns=["run", "g", "i", "v"])

    summed = src.mapInPandas(part, "run int, g long, i int, v array<double>").groupBy("run", "g", "i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(k)]).alias("v"))
    out: dict = {}
    for r in summed.collect():
        out.setdefault((r["run"], r["g"]), np.zeros((k, k)))[r["i"]] = np.asarray(r["v"], dtype=np.float64)
    return out, list(centre)


def pair_sums(df: DataFrame, cols: Sequence[str], centre: Sequence[float] | None = None) -> DataFrame:
    """Pairwise-complete sums for every column pair (i, j), i < j.

    Columns: i, j, n, sa, sb, saa, sbb, sab (on centred values).  One pass,
    partial matrices per partition, summed by ``groupBy(i, j)``.
    """
    cols = list(cols)
    if centre is None:
        centre = _centres(df, cols)
    names = [f"c{i}" for i in range(len(cols))]
    src = df.select(*[clean(c).alias(n) for c, n in zip(cols, names)])
    shift = np.asarray(centre, dtype=np.float64)
    p = len(cols)
    iu, ju = np.triu_indices(p, 1)

    def part(batches):
        import pandas as pd

        tot = None
        for pdf in batches:
            if pdf.empty:
                continue
            x = pdf[names].to_numpy(dtype=np.float64) - shift
            m = (~np.isnan(x)).astype(np.float64)
            x0 = np.where(m > 0, x, 0.0)
            x2 = x0 * x0
            mats = [m.T @ m, x0.T @ m, x2.T @ m, x0.T @ x0]
            tot = mats if tot is None else [a + b for a, b in zip(tot, mats)]
        if tot is not None:
            n, sx, sxx, sab = tot
            yield pd.DataFrame(
                {
                    "i": iu.astype(np.int32),
                    "j": ju.astype(np.int32),
                    "n": n[iu, ju],
                    "sa": sx[iu, ju],
                    "sb": sx[ju, iu],
                    "saa": sxx[iu, ju],
                    "sbb": sxx[ju, iu],
                    "sab": sab[iu, ju],
                }
            )

    partial = src.mapInPandas(part, "i int, j int, n double, sa double, sb double, saa double, sbb double, sab double")
    return partial.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
