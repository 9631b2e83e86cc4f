"""Exact k-nearest-neighbour averages without an all-pairs join.

Donors are dealt to cells, and each cell knows the range of every coordinate in it.
For a receiver those boxes bound its distance to any donor of a cell from below, in
all coordinates at once; for the NaN-aware Euclidean distance with the factor
total / (coordinates the receiver and some donor of the cell have), since the weight
total / shared of a pair is at least that, and over the coordinates that no donor
of the cell lacks.

Up to ``TREE_WIDTH`` coordinates, cells are the leaves of a tree of median splits of
a sample, up to ``LEAVES`` for about ``per_bucket`` donors each, and donors that lack
different coordinates have leaves of their own.  Beyond, they are dealt to reference
rows (k-means centres of a sample).  Under the NaN-aware distance, receivers that
know the same coordinates are searched together in cells of just these, if all
pairs of them and donors would be ``PATTERN_PAIRS`` or more; a cell of all columns
says little to a receiver that knows one.

A receiver takes the cells in the order of their bounds, in rounds that each read
``GROWTH`` times as many donors as the one before, only cells that it has not read,
and stops when the next bound is beyond its k-th distance for every target it
needs.  So the result is that of a search of all donors; sampling, splits and centres
decide the cost only.  ``exact=False`` stops after the first round.

A round meets cells and receivers in blocks: a cell of any size is dealt into
pieces of ``PIECE_ROWS`` donors and its receivers into blocks of ``BLOCK_ROWS``, so
a value that many donors share makes more pieces, not a larger task.  Of donors
that are equal in all coordinates a piece keeps those with the k + 1 smallest keys of
each target, as no other can be among the k nearest.  The boxes travel with the
tasks: two numbers a coordinate for each cell.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean, q
from .ordering import written

SAMPLE_ROWS = 4096
#: Cells of wide tables: up to ``WIDE_CELLS`` of any size, more for more than ``PIECE_ROWS`` donors each.
CELLS, WIDE_CELLS = 256, 64
#: Leaves of narrow tables, and sampled rows for each.
LEAVES, LEAF_SAMPLE = 8192, 8
TREE_WIDTH = 6
#: Receivers with the same known coordinates have cells of their own from this many pairs on, for at most so many sets of coordinates.
PATTERN_PAIRS, PATTERNS = 1 << 30, 64
CELL_ROWS = 1024
GROWTH = 8
PIECE_ROWS = 16384
BLOCK_ROWS = 8192
#: Bounds are lowered by this share, far above the rounding error of a distance.
SLACK = 1e-12
_CHUNK = 1 << 20
#: Bounds worked out at a time: what fits a core's cache.
_BOUNDS = 1 << 16
#: Products screen the pairs of tables wider than this; the distances of what is left are summed as ever.
_SCREEN_WIDTH = 8


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column of doubles as a matrix; NULL is NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def distances(a: np.ndarray, b: np.ndarray, metric: str, total: int | None = None) -> np.ndarray:
    """All distances between rows of a and rows of b, summed coordinate by coordinate; NaN where there is none.

    ``total``: columns of the NaN-aware distance, if a and b hold only some of them.
    """
    total = a.shape[1] if total is None else total
    out = np.zeros((len(a), len(b)))
    shared = np.zeros((len(a), len(b))) if metric == "nan_euclidean" else None
    if metric != "manhattan" and np.isfinite(a).all() and np.isfinite(b).all():
        for c in range(a.shape[1]):
            gap = a[:, c, None] - b[None, :, c]
            out += gap * gap
        return np.sqrt(out) if shared is None else np.sqrt(total / a.shape[1] * out)
    for c in range(a.shape[1]):
        gap = a[:, c, None] - b[None, :, c]
        if metric == "manhattan":
            out += np.abs(gap)
            continue
        known = ~np.isnan(gap)
        out += np.where(known, gap * gap, 0.0)
        if shared is not None:
            shared += known
    if metric == "manhattan":
        return out
    if shared is None:
        return np.sqrt(out)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, np.sqrt(total / shared * out), np.nan)


def centres(sample: np.ndarray, number: int, rounds: int = 4) -> np.ndarray:
    """Reference rows: k-means centres of complete rows from far-apart starts."""
    rng = np.random.default_rng(17)
    found = [sample[rng.integers(len(sample))]]
    near = ((sample - found[0]) ** 2).sum(1)
    while len(found) < number and near.max() > 0:
        found.append(sample[rng.choice(len(sample), p=near / near.sum())])
        near = np.minimum(near, ((sample - found[-1]) ** 2).sum(1))
    found = np.array(found)
    for _ in range(rounds):
        own = _nearest(sample, found)
        for c in np.unique(own):
            found[c] = sample[own == c].mean(0)
    return found


def _nearest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Number of a point that is (up to rounding) nearest to each row."""
    return ((points**2).sum(1)[None] - 2 * (x @ points.T)).argmin(1)


def median_splits(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Split column and value of every inner node of a complete binary tree: the widest column at its median."""
    column, value = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
    rows = {0: np.arange(len(sample))}
    for node in range(len(column)):
        own = rows.pop(node)
        if len(own) > 1:
            x = sample[own]
            c = int(x.std(0).argmax())
            column[node], value[node] = c, np.median(x[:, c])
            if value[node] == x[:, c].max():  # most rows share the largest value: what is below it goes left
                below = x[:, c][x[:, c] < value[node]]
                value[node] = below.max() if len(below) else np.inf
        right = sample[own, column[node]] > value[node]
        rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    return column, value


def leaves(x: np.ndarray, column: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Number of the leaf of each row."""
    node, depth = np.zeros(len(x), np.int64), (len(column) + 1).bit_length() - 1
    for _ in range(depth):
        node = 2 * node + 1 + (x[np.arange(len(x)), column[node]] > value[node])
    return node - len(column)


def _known(x: np.ndarray) -> np.ndarray:
    """Which coordinates a row has, as a number."""
    return (~np.isnan(x)) @ (1 << np.arange(x.shape[1], dtype=np.int64))


def _placed(width: int, place):
    """The cell of each donor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = place(matrix(batch.column("x"), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return run


def _by_centres(points: np.ndarray, means: np.ndarray, scale: np.ndarray):
    return lambda x: _nearest(np.where(np.isfinite(x), x, means) / scale, points)


def _by_splits(column: np.ndarray, value: np.ndarray, means: np.ndarray, shifts: dict[int, int]):
    """Rows that lack the same coordinates share leaves, joined 2 ** shift at a time where such rows are few."""
    first, shift = np.zeros(1 << len(means), np.int64), np.zeros(1 << len(means), np.int64)
    at = 0
    for mask, s in sorted(shifts.items()):
        first[mask], shift[mask] = at, s
        at += ((len(column) + 1) >> s) or 1

    def place(x: np.ndarray) -> np.ndarray:
        mask = _known(x)
        return first[mask] + (leaves(np.where(np.isfinite(x), x, means), column, value) >> shift[mask])

    return place


def _fewest(width: int, targets: int, k: int):
    """A piece sorted by key without donors that k + 1 keys with the same coordinates and the same target precede."""

    def run(donors: pa.Table) -> pa.Table:
        donors = donors.take(pc.sort_indices(donors.column("d_key")))
        if donors.num_rows <= k + 1 or width > TREE_WIDTH:
            return donors
        bits = np.ascontiguousarray(matrix(donors.column("x"), width)).view(np.int64)
        t = matrix(donors.column("t"), targets)
        key = np.asarray(donors.column("d_key").combine_chunks().dictionary_encode(null_encoding="encode").indices)
        order = np.lexsort((key, *bits.T))  # sorted rows are encoded in their order
        bits, key = bits[order], key[order]
        head = np.append(True, (bits[1:] != bits[:-1]).any(1))
        keep = np.zeros(len(key), bool)
        for j in range(targets):
            has = np.flatnonzero(~np.isnan(t[order, j]))
            if not len(has):
                continue
            group = np.cumsum(head)[has]
            fresh = np.append(True, group[1:] != group[:-1])
            other = np.cumsum(fresh | np.append(True, key[has][1:] != key[has][:-1]))
            start = other[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            keep[has[other - start <= k]] = True
        return donors.take(pa.array(np.sort(order[keep])))

    return run


def _ranges(width: int):
    """Per task and cell: rows, and of each coordinate the range and the number of missing values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            x, cell = matrix(batch.column("x"), width), np.asarray(batch.column("cell"))
            order = np.argsort(cell, kind="stable")
            x, cell = x[order], cell[order]
            heads = np.flatnonzero(np.diff(cell, prepend=-1))
            if not len(heads):
                continue
            low, high = np.fmin.reduceat(x, heads), np.fmax.reduceat(x, heads)
            gone, n = np.add.reduceat(np.isnan(x).astype(np.int64), heads), np.diff(np.append(heads, len(cell)))
            for i, c in enumerate(cell[heads].tolist()):
                was = found.get(c)
                found[c] = [low[i], high[i], gone[i], n[i]] if was is None else [np.fmin(was[0], low[i]), np.fmax(was[1], high[i]), was[2] + gone[i], was[3] + n[i]]
        for c, (low, high, gone, n) in found.items():
            cols = [pa.array([c] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(low), pa.array(high), pa.array(gone), pa.array([n] * width, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["cell", "c", "low", "high", "gone", "n"])

    return run


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray, gone: np.ndarray, metric: str, total: int | None = None, size: np.ndarray | None = None) -> np.ndarray:
    """Least possible distance of each row of a to any donor of each cell; ``size``: donors of the cells."""
    total = a.shape[1] if total is None else total
    out = np.zeros((len(a), len(low)))
    whole = metric != "manhattan" and not gone.any() and np.isfinite(a).all() and np.isfinite(low).all() and np.isfinite(high).all()
    if whole:  # every weight is the same
        gap, above = np.empty_like(out), np.empty_like(out)
        for c in range(a.shape[1]):
            np.subtract(low[None, :, c], a[:, c, None], out=gap)
            np.subtract(a[:, c, None], high[None, :, c], out=above)
            np.maximum(gap, above, out=gap)
            np.maximum(gap, 0.0, out=gap)
            gap *= gap
            out += gap
        if metric == "nan_euclidean":
            out *= total / max(a.shape[1], 1)
        np.sqrt(out, out=out)
        out *= 1 - SLACK
        return out
    for c in range(a.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, c] - a[:, c, None], a[:, c, None] - high[None, :, c]), 0.0)
        np.copyto(gap, 0.0, where=np.isnan(gap))
        if metric != "manhattan":
            gap *= gap
            gap[:, gone[:, c] > 0] = 0.0
        out += gap
    if metric == "nan_euclidean":
        has = (~np.isnan(a)).astype(np.float64)
        some = np.ones(low.shape) if size is None else (gone < size[:, None]).astype(np.float64)
        shared = has @ some.T
        out *= total / np.maximum(shared, 1)
        if size is not None:
            out[shared == 0] = np.inf
    return (out if metric == "manhattan" else np.sqrt(out)) * (1 - SLACK)


def _plan(cells: tuple, width: int, targets: int, metric: str, budget: int, total: int):
    """The cells that each receiver reads this round."""
    code, low, high, gone, size = cells
    first = min(len(code), 64) - 1

    def visited(x: np.ndarray, limit: np.ndarray, done: np.ndarray) -> list[np.ndarray]:
        least, visits = bounds(x, low, high, gone, metric, total, size), []
        if np.isinf(limit).any():
            # the cells in order, as far as the budget can reach; equal bounds stay together
            reach = int(np.searchsorted(np.cumsum(np.sort(size)), budget)) + int(done.max()) + 1
            bar = np.partition(least, min(max(first, reach), len(code) - 1), axis=1)[:, min(max(first, reach), len(code) - 1)]
            limit = np.minimum(limit, bar)
        for i in range(len(done)):
            near = np.flatnonzero(least[i] <= limit[i])
            near = near[np.isfinite(least[i, near])]
            ahead = near[np.argsort(least[i, near], kind="stable")][done[i] :]
            n = 1 + int(np.searchsorted(np.cumsum(size[ahead])[:-1], budget)) if len(ahead) else 0
            visits.append(code[ahead[:n]])
            done[i] += n
        return visits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            need, kth = matrix(batch.column("need"), targets) > 0, matrix(batch.column("kth"), targets)
            limit = np.where(need, kth, -np.inf).max(1)
            done = np.asarray(batch.column("done")).copy()
            step, visits = max(1, _BOUNDS // len(code)), []
            for i in range(0, len(x), step):
                visits += visited(x[i : i + step], limit[i : i + step], done[i : i + step])
            ends = np.concatenate(([0], np.cumsum([len(v) for v in visits]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *visits]), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("r_key", "x", "need", "kth")), pa.array(done, pa.int64()), lists], names=["r_key", "x", "need", "kth", "done", "visits"])

    return run


def _screened(a: np.ndarray, b: np.ndarray, usable: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and exact squared distances of all pairs that can be among a row's k nearest within ``most`` (squared)."""
    own, other = (a * a).sum(1), (b * b).sum(1)
    near = a @ (-2.0 * b).T
    near += other  # less the square of the row itself
    # far above the rounding error of the sum and of the products
    slack = 4 * (a.shape[1] + 8) * np.finfo(float).eps * (own + other.max())
    if not usable.all():
        np.copyto(near, np.inf, where=~usable)
    bar = most + slack - own
    found = near <= bar[:, None]
    if len(b) > k and np.count_nonzero(found) > 8 * k * len(a):
        bar = np.minimum(bar, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack)
        found = near <= bar[:, None]
    row, col = np.divmod(np.flatnonzero(found), len(b))
    fits = usable[row, col]
    row, col = row[fits], col[fits]
    square = np.zeros(len(row))
    for c in range(a.shape[1]):
        gap = a[row, c] - b[col, c]
        square += gap * gap
    return row, col, square


def _meet(width: int, targets: int, k: int, metric: str, same_key: bool, schema: pa.Schema, total: int):
    """The k nearest donors of one piece for each receiver of one block and each target that it needs."""

    def run(donors: pa.Table, receivers: pa.Table) -> pa.Table:
        if not donors.num_rows or not receivers.num_rows:
            return schema.empty_table()
        donors = donors.take(pc.sort_indices(donors.column("d_key")))  # ties go to the smaller key
        b, t = matrix(donors.column("x"), width), matrix(donors.column("t"), targets)
        a, need, kth = (matrix(receivers.column(c), w) for c, w in (("x", width), ("need", targets), ("kth", targets)))
        own: dict = {}
        if not same_key:
            for j, key in enumerate(donors.column("d_key").to_pylist()):
                own.setdefault(key, []).append(j)
        keys = receivers.column("r_key").to_pylist() if own else []
        out, step = [], max(1, _CHUNK // len(b))
        screen = metric != "manhattan" and width > _SCREEN_WIDTH and np.isfinite(a).all() and np.isfinite(b).all()
        weight = total / width if metric == "nan_euclidean" else 1.0
        for i in range(0, len(a), step):
            part = a[i : i + step]
            dist = None if screen else distances(part, b, metric, total)
            free = np.ones((len(part), len(b)), bool)
            for r, key in enumerate(keys[i : i + step]):
                free[r, own.get(key, [])] = False
            for j in range(targets):
                wanted = need[i : i + step, j] > 0
                usable = free & ~np.isnan(t[None, :, j]) & wanted[:, None]
                cut = kth[i : i + step, j]
                if screen:
                    row, col, square = _screened(part, b, usable, cut * cut / weight * (1 + 1e-9), k)
                    far = np.sqrt(weight * square) if metric == "nan_euclidean" else np.sqrt(square)
                    fits = (far <= cut[row]) & np.isfinite(far)
                    row, col, far = row[fits], col[fits], far[fits]
                else:
                    d = np.where(usable & ~np.isnan(dist), dist, np.inf)
                    if len(b) > k:
                        cut = np.minimum(cut, np.partition(d, k - 1, axis=1)[:, k - 1])
                    row, col = np.nonzero((d <= cut[:, None]) & np.isfinite(d))
                    far = d[row, col]
                order = np.lexsort((col, far, row))
                row, col, far = row[order], col[order], far[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col, far = row[first], col[first], far[first]
                out.append(pa.table([
                    receivers.column("r_key").take(pa.array(row + i)), pa.array(np.full(len(row), j, np.int32)), pa.array(far),
                    donors.column("d_key").take(pa.array(col)), pa.array(t[col, j]),
                ], schema=schema))
        return pa.concat_tables(out)

    return run


def nearest(
    receivers: DataFrame,
    donors: DataFrame,
    key: str,
    coords: Sequence[str],
    targets: Sequence[str],
    k: int = 5,
    metric: str = "nan_euclidean",
    fill_only_missing: bool = True,
    same_key: bool = False,
    exact: bool = True,
    per_bucket: int = CELL_ROWS,
) -> DataFrame:
    """r_key, t (number of the target), dist, d_key, value: the k nearest donors that have the target, of each receiver that needs it."""
    coords, targets = list(coords), list(targets)
    width, nt = len(coords), len(targets)
    doubles = "array<double>"
    d = donors.select(q(key).alias("d_key"), F.array(*[clean(c).cast("double") for c in coords]).cast(doubles).alias("x"), F.array(*[clean(t).cast("double") for t in targets]).cast(doubles).alias("t"))
    d = written(d.where("exists(t, v -> v IS NOT NULL) AND (exists(x, v -> v IS NOT NULL))" if metric == "nan_euclidean" else "exists(t, v -> v IS NOT NULL)"))
    need = F.array(*[clean(t).isNull().cast("double") if fill_only_missing else F.lit(1.0) for t in targets])
    r = receivers.select(q(key).alias("r_key"), F.array(*[clean(c).cast("double") for c in coords]).cast(doubles).alias("x"), need.cast(doubles).alias("need")).where("exists(need, v -> v > 0)")
    found_type = T.StructType([T.StructField("r_key", r.schema["r_key"].dataType), T.StructField("t", T.IntegerType()), T.StructField("dist", T.DoubleType()), T.StructField("d_key", d.schema["d_key"].dataType), T.StructField("value", T.DoubleType())])
    n = d.count()
    if not n:
        return donors.sparkSession.createDataFrame([], found_type)
    if metric != "nan_euclidean":
        return _search(r, d, n, width, width, nt, k, metric, same_key, exact, per_bucket, found_type)

    # receivers that know the same coordinates; those that know none have no neighbour
    r = written(r.where("exists(x, v -> v IS NOT NULL)"))
    known = F.transform("x", lambda v: v.isNotNull())
    common = r.groupBy(known.alias("known")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * F.lit(n) >= PATTERN_PAIRS).where(F.exists("known", lambda v: ~v)).orderBy(F.desc("n"), F.col("known").cast("string")).limit(PATTERNS).collect()
    parts, rest = [], r
    for sort in (row["known"] for row in common):
        at = [c for c in range(width) if sort[c]]
        own = F.array(*[F.col("x")[c] for c in at])
        same = known == F.array(*[F.lit(v) for v in sort])
        rest = rest.where(~same)
        near = d.where(F.greatest(*[F.col("x")[c].isNotNull() for c in at]) if len(at) > 1 else F.col("x")[at[0]].isNotNull()).withColumn("x", own)
        parts.append(_search(r.where(same).withColumn("x", own), near, n, len(at), width, nt, k, metric, same_key, exact, per_bucket, found_type))
    if not parts or not rest.isEmpty():
        parts.append(_search(rest, d, n, width, width, nt, k, metric, same_key, exact, per_bucket, found_type))
    return parts[0] if len(parts) == 1 else _best(functools.reduce(DataFrame.union, parts), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Of each receiver and target the k nearest."""
    rank = F.row_number().over(Window.partitionBy("r_key", "t").orderBy("dist", "d_key"))
    return found.withColumn("place", rank).where(F.col("place") <= k).drop("place")


def _cells(d: DataFrame, n: int, width: int, per_bucket: int, metric: str):
    """Function from rows to the numbers of their cells."""
    narrow = width <= TREE_WIDTH
    number = max(1, n // per_bucket)
    number = min(LEAVES, number) if narrow else min(number, CELLS, max(WIDE_CELLS, n // PIECE_ROWS))
    rows = max(SAMPLE_ROWS, LEAF_SAMPLE * number)
    drawn = d.select("x") if n <= rows else d.where(F.pmod(F.xxhash64("d_key", "x"), F.lit(n)) < rows).select("x")
    sample = matrix(drawn.limit(2 * rows).toArrow().column("x"), width)
    whole = [F.avg(F.when(F.abs(F.col("x")[c]) < float("inf"), F.col("x")[c])).alias(f"m{c}") for c in range(width)]
    spread = [F.stddev_pop(F.when(F.abs(F.col("x")[c]) < float("inf"), F.col("x")[c])).alias(f"s{c}") for c in range(width)]
    stats = d.agg(*whole, *spread).first()
    means = np.array([stats[f"m{c}"] or 0.0 for c in range(width)])
    sample = np.where(np.isfinite(sample), sample, means) if len(sample) else means[None]
    if narrow:
        depth = (number - 1).bit_length()
        mask = functools.reduce(lambda a, b: a + b, [F.col("x")[c].isNotNull().cast("int") * (1 << c) for c in range(width)])
        sizes = {row["mask"]: row["n"] for row in d.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 ** TREE_WIDTH rows
        shifts = {m: max(0, depth - max(0, (max(1, number * s // n) - 1).bit_length())) for m, s in sizes.items()}
        return _by_splits(*median_splits(sample, depth), means, shifts)
    scale = np.ones(width) if metric != "nan_euclidean" else np.array([s if (s := stats[f"s{c}"]) and np.isfinite(s) else 1.0 for c in range(width)])
    return _by_centres(centres(sample / scale, number), means, scale)


def _search(r: DataFrame, d: DataFrame, n: int, width: int, total: int, nt: int, k: int, metric: str, same_key: bool, exact: bool, per_bucket: int, found_type: T.StructType) -> DataFrame:
    """The k nearest of donors with ``width`` of ``total`` coordinates; ``n``: about how many there are."""
    spark, doubles = d.sparkSession, "array<double>"
    fields = T.StructType([T.StructField("r_key", found_type["r_key"].dataType), *T._parse_datatype_string(f"x {doubles}, need {doubles}, kth {doubles}, done long, visits array<int>").fields])
    part = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))

    placed = d.mapInArrow(_placed(width, _cells(d, n, width, per_bucket, metric)), T.StructType([*d.schema.fields, T.StructField("cell", T.IntegerType())]))
    sizes = [(row["cell"], -(-row["n"] // PIECE_ROWS)) for row in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row for each cell
    if not sizes:
        return spark.createDataFrame([], found_type)
    pieces = placed.join(F.broadcast(spark.createDataFrame(sizes, "cell int, pieces int")), "cell").withColumn("piece", part("d_key", "pieces"))
    dealt = written(pieces.select(*placed.columns, "piece").groupBy("cell", "piece").applyInArrow(_fewest(width, nt, k), T.StructType([*placed.schema.fields, T.StructField("piece", T.IntegerType())])).drop("piece"))
    ranges = dealt.mapInArrow(_ranges(width), "cell int, c int, low double, high double, gone long, n long")
    box = ranges.groupBy("cell", "c").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("gone").alias("gone"), F.sum("n").alias("n")).orderBy("cell", "c").toArrow()
    code = np.asarray(box.column("cell"))[::width].astype(np.int32)
    cells = (code, *(box.column(c).to_numpy().astype(np.float64).reshape(-1, width) for c in ("low", "high", "gone")), np.asarray(box.column("n"))[::width])
    pieces = {int(c): -(-int(m) // PIECE_ROWS) for c, m in zip(code, cells[-1])}

    far = F.array(*[F.lit(float("inf"))] * nt)
    budget = 4 * per_bucket
    state = r.withColumn("kth", far).withColumn("done", F.lit(0).cast("long"))
    best = spark.createDataFrame([], found_type)
    # Spark's own mapping of the key types to Arrow
    arrow = spark.createDataFrame([], found_type).toArrow().schema
    while True:
        planned = written(state.mapInArrow(_plan(cells, width, nt, metric, budget, total), fields))
        visits = planned.select(F.explode("visits").alias("cell"), "r_key", "x", "need", "kth")
        wanted = [(row["cell"], pieces[row["cell"]], -(-row["n"] // BLOCK_ROWS)) for row in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row for each cell
        if not wanted:
            return best
        deal = F.broadcast(spark.createDataFrame(wanted, "cell int, pieces int, blocks int"))
        store = dealt.join(deal, "cell").select("cell", "d_key", "x", "t", part("d_key", "pieces").alias("piece"), every("blocks").alias("block"))
        seek = visits.join(deal, "cell").select("cell", "r_key", "x", "need", "kth", part("r_key", "blocks").alias("block"), every("pieces").alias("piece"))
        by = ["cell", "piece", "block"]
        found = store.groupBy(*by).cogroup(seek.groupBy(*by)).applyInArrow(_meet(width, nt, k, metric, same_key, arrow, total), found_type)
        best = written(_best(best.union(found), k))
        if not exact:
            return best
        last = best.groupBy("r_key", "t").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("dist")).where(F.col("n") >= k)
        last = last.groupBy(F.col("r_key").alias("l_key")).agg(F.map_from_entries(F.collect_list(F.struct("t", "dist"))).alias("last"))
        kth = F.transform(F.sequence(F.lit(0), F.lit(nt - 1)), lambda j: F.coalesce(F.try_element_at("last", j), F.lit(float("inf"))))
        # who reads nothing this round is done
        state = planned.where(F.size("visits") > 0).join(last, F.col("r_key").eqNullSafe(F.col("l_key")), "left").select("r_key", "x", "need", kth.alias("kth"), "done")
        budget *= GROWTH


def knn_average(
    receivers: DataFrame,
    donors: DataFrame,
    key: str,
    coords: Sequence[str],
    targets: Sequence[str],
    k: int = 5,
    metric: str = "nan_euclidean",
    fill_only_missing: bool = True,
    same_key: bool = False,
    exact: bool = True,
    pivot: str | None = None,
    per_bucket: int = CELL_ROWS,
) -> DataFrame:
    """(key, target, value, n_neighbours) for each receiver and target column.

    ``fill_only_missing``: only targets NULL in the receiver are answered
    (imputation); otherwise every target (prediction).  Donors for a target
    are the donor rows where it is present; a donor with the receiver's key is
    excluded unless ``same_key`` says that the two tables' keys are unrelated.
    Ties in distance go to the smaller donor key.  No donor -> no row.
    ``per_bucket``: donors that a cell should hold, a quarter of what the first
    round reads.  Cells use all coordinates, so ``pivot`` has no effect.
    """
    near = nearest(receivers, donors, key, coords, targets, k, metric, fill_only_missing, same_key, exact, per_bucket)
    out = near.groupBy("r_key", "t").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_neighbours"))
    names = F.array(*[F.lit(t) for t in targets])
    return out.select(F.col("r_key").alias(key), F.element_at(names, F.col("t") + 1).alias("target"), "value", "n_neighbours")
