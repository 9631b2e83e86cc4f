"""Exact (interpolated) quantiles without gathering a column in one task.

``F.percentile`` is exact but merges a value->count map of the whole column
in one final task, which does not survive a 100 TB column.  This operator
narrows each wanted order statistic with equal-width histograms instead:

1. one ``agg``: count, min, max per column;
2. while a bracket still holds more than ``final_max`` values: one job buckets
   the rows inside every open bracket (``groupBy(bracket, bucket)`` with
   count/min/max, map-side combined), and the driver walks the returned
   histogram (at most ``brackets x buckets`` rows) to the bucket holding the
   rank.  Bucketing is monotone in the value, so each bucket is a contiguous
   run of the sorted column and its min/max are exact new bracket ends;
3. once a bracket is small, its rows are sorted per bracket on the executors
   and only the wanted elements come back.

A hot value (a third of all rows equal) resolves at once: its bucket has
min == max.  Interpolation matches ``numpy.percentile(method="linear")``,
Spark ``percentile`` and DuckDB ``quantile_cont``.  ``exact=False`` uses
``percentile_approx`` in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    exact: bool = True,
    accuracy: int = 10000,
    buckets: int = 4096,
    final_max: int = 200_000,
) -> dict[str, list[float | None]]:
    """``{column: [value at p for p in probs]}``; ``None`` for an all-null column."""
    cols = list(cols)
    probs = [float(p) for p in probs]
    if not cols:
        return {}
    src = df.select(*[clean(c).alias(f"v{i}") for i, c in enumerate(cols)])
    if not exact:
        row = src.agg(
            *[F.percentile_approx(f"v{i}", F.array(*[F.lit(p) for p in probs]), accuracy).alias(f"v{i}") for i in range(len(cols))]
        ).first()
        return {c: (list(row[f"v{i}"]) if row[f"v{i}"] is not None else [None] * len(probs)) for i, c in enumerate(cols)}

    aggs = []
    for i in range(len(cols)):
        v = F.col(f"v{i}")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    base = src.agg(*aggs).first()

    # target = (column index, 0-based rank); state = [lo, hi, below, count]
    state: dict[tuple[int, int], list] = {}
    value: dict[tuple[int, int], float] = {}
    plan: dict[tuple[int, float], tuple[int, int, float]] = {}
    for i in range(len(cols)):
        n = base[f"n{i}"]
        if not n:
            continue
        for p in probs:
            h = (n - 1) * p
            r0 = int(math.floor(h))
            r1 = min(r0 + 1, n - 1)
            plan[(i, p)] = (r0, r1, h - r0)
            for r in (r0, r1):
                state[(i, r)] = [base[f"lo{i}"], base[f"hi{i}"], 0, n]

    def settle() -> None:
        for t, (lo, hi, _below, _cnt) in list(state.items()):
            if lo == hi:
                value[t] = lo
                del state[t]

    settle()
    while any(s[3] > final_max for s in state.values()):
        open_ = sorted({(t[0], s[0], s[1]) for t, s in state.items() if s[3] > final_max})
        ids = {b: k for k, b in enumerate(open_)}
        entries = []
        for (i, lo, hi), k in ids.items():
            v = F.col(f"v{i}")
            # infinite ends get buckets of their own, the finite values between them are cut on the next round
            if math.isinf(lo) or math.isinf(hi):
                bucket = F.when(v == F.lit(-math.inf), -1).when(v == F.lit(math.inf), 1).otherwise(0).cast("int")
            else:
                width = hi / buckets - lo / buckets
                bucket = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(buckets - 1)).cast("int")
            entries.append(F.when((v >= F.lit(lo)) & (v <= F.lit(hi)), F.struct(F.lit(k).alias("b"), bucket.alias("k"), v.alias("v"))))
        hist = (
            src.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
            .groupBy("e.b", "e.k")
            .agg(F.count("*").alias("c"), F.min("e.v").alias("mn"), F.max("e.v").alias("mx"))
            .collect()
        )
        by_bracket: dict[int, list] = {}
        for r in hist:
            by_bracket.setdefault(r["b"], []).append((r["k"], r["c"], r["mn"], r["mx"]))
        for t, s in state.items():
            if s[3] <= final_max:
                continue
            rows = sorted(by_bracket[ids[(t[0], s[0], s[1])]])
            was, seen = tuple(s), s[2]
            for _k, c, mn, mx in rows:
                if seen + c > t[1]:
                    s[:] = [mn, mx, seen, c]
                    break
                seen += c
            if tuple(s) == was and s[0] != s[1]:
                raise ArithmeticError(f"quantile bracket {was[:2]} of column {cols[t[0]]!r} does not shrink")
        settle()

    if state:
        closed = sorted({(t[0], s[0], s[1]) for t, s in state.items()})
        ids = {b: k for k, b in enumerate(closed)}
        entries = []
        for (i, lo, hi), k in ids.items():
            v = F.col(f"v{i}")
            entries.append(F.when((v >= F.lit(lo)) & (v <= F.lit(hi)), F.struct(F.lit(k).alias("b"), v.alias("v"))))
        wanted = sorted({(ids[(t[0], s[0], s[1])], t[1] - s[2] + 1) for t, s in state.items()})
        want_df = src.sparkSession.createDataFrame(wanted, "b int, pos int")
        sorted_ = (
            src.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
            .groupBy(F.col("e.b").alias("b"))
            .agg(F.sort_array(F.collect_list("e.v")).alias("s"))
        )
        got = {
            (r["b"], r["pos"]): r["x"]
            for r in sorted_.join(F.broadcast(want_df), "b").select("b", "pos", F.element_at("s", F.col("pos")).alias("x")).collect()
        }
        for t, s in state.items():
            value[t] = got[(ids[(t[0], s[0], s[1])], t[1] - s[2] + 1)]

    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        vals: list[float | None] = []
        for p in probs:
            if (i, p) not in plan:
                vals.append(None)
                continue
            r0, r1, frac = plan[(i, p)]
            a, b = value[(i, r0)], value[(i, r1)]
            vals.append(a + (b - a) * frac if frac else a)
        out[c] = vals
    return out
