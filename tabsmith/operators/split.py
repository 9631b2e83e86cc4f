"""Reproducible train/test split and k-fold assignment.

Rows are ordered by a keyed 32-bit hash ``h = hash(seed, purpose, key)`` with
the key as tie-break, so the assignment is a pure function of the key (stable
under repartitioning and task retries, unlike ``randomSplit``).  Exact sizes
need the row at a few cut ranks; those are found without a global sort:
count rows per hash bucket (12 bits at a time), descend only into the bucket
that holds a cut, and rank rows inside a bucket only once it is small.  The
split/fold column is then a narrow projection against literal cut points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from ..functions.randomness import hash32

LEVELS = [(20, 4096), (8, 4096), (0, 256)]  # (shift, buckets) over the 32 hash bits


def keyed_hash(key_col: str, seed: int, purpose: str) -> Column:
    return hash32(seed, purpose, q(key_col))


def rank_cuts(df: DataFrame, h: str, key: str, ranks: Sequence[int]) -> list[tuple[int, object]]:
    """(h, key) of the rows at the 0-based ``ranks`` in (h, key) order."""
    ranks = sorted(set(ranks))
    if not ranks:
        return []
    # each open search: (lo_h, hi_h inclusive, rows before lo_h)
    todo = {r: (0, (1 << 32) - 1, 0) for r in ranks}
    found: dict[int, tuple[int, object]] = {}
    for shift, _nb in LEVELS:
        groups = sorted(set(todo.values()))
        if not groups:
            break
        cnt_cond = F.lit(False)
        for lo, hi, _ in groups:
            cnt_cond = cnt_cond | F.col(h).between(lo, hi)
        counts = (
            df.filter(cnt_cond)
            .groupBy(F.shiftright(F.col(h), shift).alias("b"))
            .count()
            .collect()
        )
        counts = sorted((r["b"], r["count"]) for r in counts)
        new = {}
        for r, (lo, hi, before) in todo.items():
            seen = before
            for b, c in counts:
                blo, bhi = b << shift, ((b + 1) << shift) - 1
                if bhi < lo or blo > hi:
                    continue
                if seen + c > r:
                    new[r] = (blo, bhi, seen, c)
                    break
                seen += c
        todo = {}
        small = {}
        for r, (blo, bhi, seen, c) in new.items():
            if shift == 0:  # rows of one hash value are ranked by key
                small[r] = (blo, bhi, seen)
            else:
                todo[r] = (blo, bhi, seen)
        if small:
            _rank_inside(df, h, key, small, found)
    return [found[r] for r in ranks]


def _rank_inside(df, h, key, small, found) -> None:
    brackets = sorted({(lo, hi) for lo, hi, _ in small.values()})
    ids = {b: i for i, b in enumerate(brackets)}
    which = None
    for (lo, hi), i in ids.items():
        cond = F.col(h).between(lo, hi)
        which = F.when(cond, F.lit(i)) if which is None else which.when(cond, F.lit(i))
    want = {(ids[(lo, hi)], r - seen + 1): r for r, (lo, hi, seen) in small.items()}
    w = Window.partitionBy("_b").orderBy(h, key)
    ranked = (
        df.select(F.col(h), q(key).alias(key), which.alias("_b"))
        .filter(F.col("_b").isNotNull())
        .withColumn("_rn", F.row_number().over(w))
    )
    cond = F.lit(False)
    for b, rn in want:
        cond = cond | ((F.col("_b") == b) & (F.col("_rn") == rn))
    for row in ranked.filter(cond).collect():
        found[want[(row["_b"], row["_rn"])]] = (row[h], row[key])


def _le(h: str, key: str, cut: tuple[int, object]) -> Column:
    return (F.col(h) < F.lit(cut[0])) | ((F.col(h) == F.lit(cut[0])) & (q(key) <= F.lit(cut[1])))


@contextmanager
def _hashed(df: DataFrame, key: str, seed: int, purpose: str) -> Iterator[DataFrame]:
    """Hash and key of every row, kept (spilling to disk) while the cuts are searched."""
    d = df.select(keyed_hash(key, seed, purpose).alias("_h"), q(key)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield d
    finally:
        d.unpersist()


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, name: str = "split") -> DataFrame:
    """``name`` = 'test' for the first ceil(test_size * n) rows in hash order, else 'train'."""
    with _hashed(df, key, seed, "split") as d:
        n_test = int(math.ceil(test_size * d.count()))
        if n_test == 0:
            return df.withColumn(name, F.lit("train"))
        cut = rank_cuts(d, "_h", key, [n_test - 1])[0]
    marked = df.withColumn("_h", keyed_hash(key, seed, "split"))
    return marked.withColumn(name, F.when(_le("_h", key, cut), F.lit("test")).otherwise(F.lit("train"))).drop("_h")


def fold_sizes(n: int, k: int) -> list[int]:
    return [n // k + (1 if f < n % k else 0) for f in range(k)]


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, name: str = "fold", purpose: str = "fold") -> DataFrame:
    """Contiguous chunks of the hash order; the first n % k folds get one extra row."""
    with _hashed(df, key, seed, purpose) as d:
        sizes = fold_sizes(d.count(), k)
        ends = [sum(sizes[: f + 1]) - 1 for f in range(k - 1) if sizes[f] > 0]
        cuts = rank_cuts(d, "_h", key, ends)
    expr = None
    for f, cut in enumerate(cuts):
        cond = _le("_h", key, cut)
        expr = F.when(cond, F.lit(f)) if expr is None else expr.when(cond, F.lit(f))
    fold = F.lit(k - 1) if expr is None else expr.otherwise(F.lit(len(cuts)))
    return df.withColumn("_h", keyed_hash(key, seed, purpose)).withColumn(name, fold.cast("int")).drop("_h")


def kfold_runs(df: DataFrame, key: str, k: int, seeds: Sequence[int], name: str = "folds", purpose: str = "fold") -> DataFrame:
    """I2 for many seeds at once: an array column with the fold that ``kfold`` gives for each seed.

    One histogram job per level serves all seeds: rows are counted by (seed, hash
    bucket), and only the buckets that hold a cut are counted finer.  What comes back
    is at most 4096 counts a seed and level.  The column itself is a narrow
    comparison with the cuts.
    """
    seeds = list(seeds)
    hashes = F.array(*[keyed_hash(key, s, purpose).alias("h") for s in seeds])
    d = df.select(hashes.alias("_hs"), q(key).alias("_key")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = fold_sizes(d.count(), k)
        ends = [sum(sizes[: f + 1]) - 1 for f in range(k - 1) if sizes[f] > 0]
        cuts = _cuts_of_runs(d, len(seeds), ends)
    finally:
        d.unpersist()
    folds = []
    for run, seed in enumerate(seeds):
        h = keyed_hash(key, seed, purpose)
        past = [F.when((h < F.lit(c[0])) | ((h == F.lit(c[0])) & (q(key) <= F.lit(c[1]))), 0).otherwise(1) for c in cuts[run]]
        folds.append(sum(past, F.lit(0)).cast("int") if past else F.lit(k - 1))
    return df.withColumn(name, F.array(*folds))


def _cuts_of_runs(d: DataFrame, runs: int, ranks: Sequence[int]) -> list[list[tuple[int, object]]]:
    """For each run the (hash, key) of the rows at the 0-based ranks of its hash order."""
    if not ranks:
        return [[] for _ in range(runs)]
    spark = d.sparkSession
    long = d.select(F.posexplode("_hs").alias("run", "h"), "_key")
    at = {(run, r): (0, 0) for run in range(runs) for r in ranks}  # bucket and the rows before it
    above = 32
    for shift, _ in LEVELS:
        inside = long
        if above < 32:
            held = spark.createDataFrame(sorted({(run, b) for (run, _), (b, _) in at.items()}), "run int, up long")
            inside = long.withColumn("up", F.shiftright("h", above)).join(F.broadcast(held), ["run", "up"], "left_semi")
        counts: dict[tuple[int, int], list] = {}
        for row in inside.groupBy("run", F.shiftright("h", shift).alias("b")).count().collect():
            counts.setdefault((row["run"], row["b"] >> (above - shift)), []).append((row["b"], row["count"]))
        for (run, r), (b, seen) in at.items():
            for finer, n in sorted(counts[(run, b)]):
                if seen + n > r:
                    at[(run, r)] = (finer, seen)
                    break
                seen += n
        above = shift
    # rows of one hash value are ranked by key
    held = spark.createDataFrame(sorted({(run, b) for (run, _), (b, _) in at.items()}), "run int, h long")
    wanted = spark.createDataFrame([(run, b, r - seen + 1, r) for (run, r), (b, seen) in at.items()], "run int, h long, place int, rank long")
    w = Window.partitionBy("run", "h").orderBy("_key")
    placed = long.join(F.broadcast(held), ["run", "h"], "left_semi").withColumn("place", F.row_number().over(w))
    found = {(r["run"], r["rank"]): (r["h"], r["_key"]) for r in placed.join(F.broadcast(wanted), ["run", "h", "place"]).collect()}
    return [[found[(run, r)] for r in ranks] for run in range(runs)]


def split_sql(key: str, seed: int, purpose: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', '{purpose}', CAST({key} AS VARCHAR))), 1, 8))::BIGINT"
