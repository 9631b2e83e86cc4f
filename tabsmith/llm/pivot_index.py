"""Exact top-k by inner product with a pivot-distance index (operator 13).

With one coordinate more, sqrt(M - |x|^2) for the largest squared norm M, all
vectors lie on a sphere, and the larger the inner product with a query the
smaller the distance to it.  Every vector is keyed by its nearest pivot and its
distance to that pivot; the distances of a pivot are cut into annuli.  For a query
the triangle inequality bounds the inner product in every annulus:

    q.x <= (|q|^2 + M - gap^2) / 2,   gap = how far |q - pivot| lies outside [rmin, rmax]

A query takes the annuli in the order of their bounds, in rounds that each read
eight times the rows of the one before, and stops when the next bound is below its
k-th score.  The bounds carry a slack far above rounding, scores are exact
integers, so the result is that of a search of all rows.

Plan: vectors are compared once with the pivots (a fixed number, k-means centres
of a sample of ``SAMPLE_ROWS`` rows by hash; pivots change the cost, not the
result) and written with their key.  The directory of annuli has at most
``PIVOTS * BANDS`` rows, and one more for each further dimension that occurs; it
travels with the tasks.  A round meets annuli and queries in cells: an annulus is
dealt into pieces of ``PIECE_ROWS`` rows and its queries into blocks of
``BLOCK_ROWS``, so no task depends on the size of an annulus or on the number of
queries that want it.  Equal vectors are one row with their k + 1 smallest ids,
cut down before the shuffle: no larger id can be among the k of any query.

Edge rows: vectors that are null or hold a null or non-finite component take no
part, nor do rows with a null id; zero and empty vectors do.  Vectors meet only
vectors of their own dimension.  Repeated rows count once; of different vectors
under one id the smallest in array order stands for it.  A row is never its own
candidate.  Ties go to the smaller id; with fewer than k candidates all are given.
Scores beyond the range of a long are held at its ends.  An empty table has no
results.  Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import query, table
from .shared import quoted, stored

K = 5
PIVOTS = 64
BANDS = 32
SAMPLE_ROWS = 4096
ANNULUS_ROWS = 1024
FIRST_ROWS = 2048
GROWTH = 8
PIECE_ROWS = 32768
BLOCK_ROWS = 4096
#: Relative slack of the bounds, far above the rounding error of a distance.
SLACK = 1e-9
_CELL = 1 << 20
_CODE = 1 << 16
_LONG = np.iinfo(np.int64)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of all x to all p over differences, without the cancellation of dot products."""
    out = np.empty((len(x), len(p)))
    step = max(1, _CELL // max(1, p.size))
    for i in range(0, len(x), step):
        out[i : i + step] = np.sqrt(((x[i : i + step, None] - p[None]) ** 2).sum(-1))
    return out


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    """The vectors as doubles with the coordinate that brings them to the sphere."""
    x = v.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(most - (x**2).sum(1), 0))[:, None]], axis=1)


def choose_pivots(sample: np.ndarray, number: int, rounds: int = 6) -> np.ndarray:
    """Centres of a sample by k-means from far-apart starts."""
    rng = np.random.default_rng(13)
    centres = [sample[rng.integers(len(sample))]]
    near = ((sample - centres[0]) ** 2).sum(1)
    while len(centres) < number and near.max() > 0:
        centres.append(sample[rng.choice(len(sample), p=near / near.sum())])
        near = np.minimum(near, ((sample - centres[-1]) ** 2).sum(1))
    centres = np.array(centres)
    for _ in range(rounds):
        own = _distances(sample, centres).argmin(1)
        for c in np.unique(own):
            centres[c] = sample[own == c].mean(0)
    return centres


def _by_dim(batch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, matrix) of the vectors of a batch."""
    column = batch.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten())
    ends = np.cumsum(np.asarray(batch.column("dim")))
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, flat[((ends[rows] - dim)[:, None] + np.arange(dim)[None]).ravel()].reshape(len(rows), dim)


def _keyed(pivots: dict[int, np.ndarray], most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot = np.full(batch.num_rows, -1, np.int32)
            dist = np.zeros(batch.num_rows)
            for dim, rows, v in _by_dim(batch):
                if dim in pivots:
                    d = _distances(_lifted(v, most), pivots[dim])
                    pivot[rows], dist[rows] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("ids", "v", "dim")), pa.array(pivot), pa.array(dist)], names=["ids", "v", "dim", "pivot", "dist"])

    return run


def _plan(pivots: dict[int, np.ndarray], directory: dict[int, tuple], most: float, budget: int):
    """The annuli that each query takes this round: in the order of their bounds, while these reach its k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, least = np.asarray(batch.column("done")).copy(), batch.column("least")
            floor = np.where(np.asarray(least.is_null()), -np.inf, np.asarray(least.fill_null(0), np.float64))
            visits: list[np.ndarray] = [np.zeros(0, np.int32)] * batch.num_rows
            for dim, rows, v in _by_dim(batch):
                code, pivot, low, high, size = directory.get(dim, (np.zeros(0, np.int32),) * 5)
                if not len(code):
                    continue
                q = v.astype(np.float64)
                norm = (q**2).sum(1)
                bound = np.full((len(rows), len(code)), np.inf)
                if dim in pivots:
                    q = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
                    real = np.flatnonzero(pivot >= 0)
                    d = _distances(q, pivots[dim])[:, pivot[real]]
                    gap = np.maximum(np.maximum(low[real] - d, d - high[real]), 0)
                    bound[:, real] = (norm[:, None] + most - gap**2) / 2 + SLACK * (norm[:, None] + most + (d + high[real]) ** 2)
                order = np.argsort(-bound, axis=1, kind="stable")
                for i, row in enumerate(rows.tolist()):
                    ahead = order[i, done[row] :]
                    room = np.concatenate(([True], np.cumsum(size[ahead])[:-1] < budget))[: len(ahead)]
                    take = room & (bound[i, ahead] >= floor[row] - SLACK * abs(floor[row]) if np.isfinite(floor[row]) else room)
                    n = len(take) if take.all() else int(take.argmin())
                    visits[row] = code[ahead[:n]]
                    done[row] += n
            parts = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in visits]))).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *visits]), pa.int32()))
            kept = [batch.column(c) for c in ("query_id", "v", "dim", "least", "best")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(done, pa.int64()), parts], names=["query_id", "v", "dim", "least", "best", "done", "visits"])

    return run


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles where every sum stays below 2^53."""
    most = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (q, x)]
    if max(most) < 2**53 and most[0] * most[1] * max(q.shape[1], 1) < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    whole = np.zeros((len(q), len(x)), object) if not q.shape[1] else q.astype(object) @ x.astype(object).T
    return np.clip(whole, _LONG.min, _LONG.max).astype(np.int64)


_FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _cell(k: int):
    """The k best of one piece for each query of one block."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        (_, _, x), (_, _, q) = next(_by_dim(vectors)), next(_by_dim(queries))
        ids = vectors.column("ids").combine_chunks()
        names, firsts = np.asarray(ids.flatten()), np.asarray(ids.offsets) - ids.offsets[0].as_py()
        qids = np.asarray(queries.column("query_id"))
        least = np.asarray(queries.column("least").fill_null(_LONG.min))
        out, step = [], max(1, _CELL // len(x))
        for i in range(0, len(q), step):
            score = products(q[i : i + step], x)
            cut = least[i : i + step, None]
            if len(x) > k + 1:  # one row may hold nothing but the query itself
                cut = np.maximum(cut, np.partition(score, len(x) - k - 1, axis=1)[:, len(x) - k - 1, None])
            row, col = np.nonzero(score >= cut)
            many = (firsts[1:] - firsts[:-1])[col]
            name = names[np.repeat(firsts[col], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            score, row = np.repeat(score[row, col], many), np.repeat(row, many)
            other = name != qids[i : i + step][row]
            score, row, name = score[other], row[other], name[other]
            order = np.lexsort((name, ~score, row))  # ~ turns the order round without overflow
            score, row, name = score[order], row[order], name[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append(pa.table([pa.array(qids[i : i + step][row[best]]), pa.array(name[best]), pa.array(score[best])], schema=_FOUND))
        return pa.concat_tables(out)

    return run


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Equal vectors as one row with their k + 1 smallest ids."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.withColumn("place", rank).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v"))


def _annuli(keyed: DataFrame) -> DataFrame:
    """``keyed`` with the code of its annulus: pivot and band of about equal numbers of rows."""
    cuts = [i / BANDS for i in range(1, BANDS)]
    edges = keyed.where("pivot >= 0").groupBy(F.col("dim").alias("d"), F.col("pivot").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("dist", cuts, 1000).alias("cuts"))
    bands = f"least({BANDS}, CAST(ceil(n / {ANNULUS_ROWS}) AS INT))"
    edges = edges.select("d", "p", F.expr(f"filter(cuts, (c, i) -> (i + 1) * {bands} div {BANDS} > i * {bands} div {BANDS})").alias("edges"))
    banded = keyed.join(F.broadcast(stored(edges)), (F.col("dim") == F.col("d")) & (F.col("pivot") == F.col("p")), "left")  # at most PIVOTS rows for a sampled dimension
    return banded.withColumn("code", F.expr(f"CASE WHEN pivot < 0 THEN -1 ELSE pivot * {_CODE} + coalesce(size(filter(edges, e -> e < dist)), 0) END").cast("int"))


def top_products(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "vector", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every row that ``is_query`` (a column over ``id``) selects.

    ``vector_col`` holds arrays of integers.
    """
    v = quoted(vector_col).cast("array<bigint>")
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL)")
    rows = stored(rows.groupBy("id").agg(F.min("v").alias("v")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most")).first()
    most = size["most"] or 0.0
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v", F.size("v").alias("dim")).toArrow()
    number = min(PIVOTS, max(1, round(size["n"] ** 0.5 / 4)))
    pivots = {dim: choose_pivots(_lifted(x, most), number) for dim, _, x in _by_dim(sample)} if sample.num_rows else {}
    keyed = stored(_classes(rows, k).mapInArrow(_keyed(pivots, most), "ids array<bigint>, v array<bigint>, dim int, pivot int, dist double"))
    banded = _annuli(keyed)
    listed = banded.groupBy("dim", "code").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("dim", "code").toArrow().to_pandas()
    directory = {int(dim): (g["code"].to_numpy(np.int32), g["code"].to_numpy() // _CODE, g["low"].to_numpy(), g["high"].to_numpy(), g["n"].to_numpy()) for dim, g in listed.groupby("dim")}
    pieces = {(int(d), int(c)): -(-int(n) // PIECE_ROWS) for d, c, n in zip(listed["dim"], listed["code"], listed["n"])}
    spark = vectors.sparkSession

    columns = "query_id long, v array<bigint>, dim int, least long, best array<struct<less:bigint,id:bigint>>, done long"
    asked = rows.where(is_query).select(F.col("id").alias("query_id"), "v", F.size("v").alias("dim"), F.lit(None).cast("long").alias("least"), F.array().cast("array<struct<less:bigint,id:bigint>>").alias("best"), F.lit(0).cast("long").alias("done"))
    state, budget = asked, FIRST_ROWS
    while True:
        planned = stored(state.mapInArrow(_plan(pivots, directory, most, budget), columns + ", visits array<int>"))
        visits = planned.select(F.explode("visits").alias("code"), "query_id", "v", "dim", "least")
        wanted = [(r["dim"], r["code"], pieces[r["dim"], r["code"]], -(-r["n"] // BLOCK_ROWS)) for r in visits.groupBy("dim", "code").agg(F.count(F.lit(1)).alias("n")).collect()]  # one row an annulus
        if not wanted:
            break
        cells = F.broadcast(spark.createDataFrame(wanted, "dim int, code int, pieces int, blocks int"))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        store = banded.join(cells, ["dim", "code"]).select("dim", "code", "ids", "v", dealt("v", "pieces").alias("piece"), every("blocks").alias("block"))
        seek = visits.join(cells, ["dim", "code"]).select("dim", "code", "query_id", "v", "least", dealt("query_id", "blocks").alias("block"), every("pieces").alias("piece"))
        key = ["dim", "code", "piece", "block"]
        found = store.groupBy(*key).cogroup(seek.groupBy(*key)).applyInArrow(_cell(k), "query_id long, id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        new = found.withColumn("place", rank).where(F.col("place") <= k).groupBy("query_id").agg(F.collect_list(F.struct((F.bitwise_not("score")).alias("less"), "id")).alias("new"))
        merged = planned.join(new, "query_id", "left").withColumn("best", F.expr(f"slice(array_sort(concat(best, coalesce(new, array()))), 1, {k})"))
        state = stored(merged.select("query_id", "v", "dim", F.expr(f"CASE WHEN size(best) = {k} THEN ~best[{k - 1}].less END").alias("least"), "best", "done"))
        budget *= GROWTH
    out = planned.select("query_id", F.posexplode("best").alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.bitwise_not("hit.less").alias("score"))


@query("op13_exact_topk", """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pair)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
""")
def op13_exact_topk(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    whole = F.when(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.transform(e, lambda x: F.floor(256 * x)))
    return top_products(table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("vector")), F.col("id") % 50 == 0)
