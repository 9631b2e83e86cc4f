"""Nearest neighbours by vantage-point trees (operator 7).

1. A top tree over vantage points of a bounded sample (``SAMPLE_BYTES``) deals
   every vector to a shard: a shard is what lies in the same rings around the
   vantage points on its path.  The sample decides where shards end, no result.
   A shard with more rows than ``SHARD_BYTES`` hold is cut in pieces by a hash of
   the id, so a hot spot or a group of equal vectors is no single task.
2. Each piece builds a vantage-point tree over all its vectors, once; the trees
   are written as an index table of one row a vector or node, with the least and
   largest distance of the piece's rows to each vantage point on its path.
3. Each query searches its own shard first, which bounds its k-th distance, and
   then those others that the triangle inequality does not rule out.  Inside a
   shard a subtree is skipped by the same test, near side first.

The bound is relaxed by ``relax``: what satisfies ``relax * bound > k-th distance``
is skipped.  A factor of one is exact; a larger one prunes more.  A shard meets its
queries in blocks of a bounded size.

Distances are Euclidean in double precision on the given vectors; ties go to the
smaller id.

Edge rows: vectors that are null, empty, zero or hold a null or non-finite
component take no part, nor do rows with a null id.  Vectors meet only vectors of
their own dimension.  Repeated rows count once; of several vectors with one id the
first in array order takes part.  Rows with the query's id are no candidates.  Equal
vectors that no split can part stay in one leaf, which is searched in pieces.  Very
long vectors make smaller shards.  A table's other columns are not read.  An empty
table has no neighbours.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import query, table
from .shared import quoted, scratch, stored

K = 10
RELAX = 3.0
#: Bytes of the vectors of a piece, and of the sample that the top tree is fitted on.
SHARD_BYTES = 2 << 20
SAMPLE_BYTES = 16 << 20
#: Most shards of the top tree; beyond them shards have several pieces.
SHARDS = 4096
SAMPLE_A_SHARD = 16
BLOCK_ROWS = 8192
LEAF = 192
#: Slack of the squared distance by dot products, far above its rounding error.
SLACK = 1e-9
_CHUNK = 1 << 20


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed over differences so that equal vectors give equal results."""
    out = np.empty((len(q), len(x)))
    step = max(1, _CHUNK // max(1, x.size))
    for i in range(0, len(q), step):
        out[i : i + step] = np.sqrt(((q[i : i + step, None, :] - x[None]) ** 2).sum(-1))
    return out


class VantageTree:
    """Nodes in arrays: vantage point, children, and the range of distances below each child."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors = ids, vectors
        self.norms = (vectors**2).sum(-1)
        self.nodes: list[tuple] = []
        self.leaves: list[np.ndarray] = []
        rng = np.random.default_rng(7)
        self.root = -1
        stack = [(np.arange(len(ids)), -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            d = None
            if len(rows) > leaf:
                point = int(rows[rng.integers(len(rows))])
                d = distances(vectors[point][None], vectors[rows])[0]
                cut = np.median(d)
                inner = d <= cut
                if inner.all():
                    inner = d < cut
            if d is None or not inner.any():
                here = -1 - len(self.leaves)
                self.leaves.append(rows)
            else:
                here = len(self.nodes)
                self.nodes.append([vectors[point], None, None, d[inner].min(), d[inner].max(), d[~inner].min(), d[~inner].max()])
                stack += [(rows[inner], here, 1), (rows[~inner], here, 2)]
            if parent < 0 and side == 0:
                self.root = here
            else:
                self.nodes[parent][side] = here

    @classmethod
    def of_index(cls, part: pa.Table) -> VantageTree:
        """The tree that ``index_rows`` wrote."""
        kind, place = np.asarray(part.column("kind")), np.asarray(part.column("place"))
        tree = cls.__new__(cls)
        held = np.flatnonzero(kind == _VECTOR)
        held = held[np.argsort(place[held], kind="stable")]
        tree.ids = np.asarray(part.column("id").take(pa.array(held)))
        tree.vectors = _matrix(part.take(pa.array(held)))
        tree.norms = (tree.vectors**2).sum(-1)
        pages = np.flatnonzero(np.diff(place[held], prepend=-1))
        tree.leaves = np.split(np.arange(len(held)), pages[1:])
        nodes = np.flatnonzero(kind == _NODE)
        nodes = nodes[np.argsort(place[nodes])]
        tree.nodes = []
        if len(nodes):
            numbers = _matrix(part.take(pa.array(nodes)))
            tree.nodes = [[x[6:], int(x[0]), int(x[1]), *x[2:6]] for x in numbers]
        tree.root = 0 if tree.nodes else -1
        return tree

    def index_rows(self) -> tuple[np.ndarray, np.ndarray, list, list]:
        """(kind, place, id, numbers): a row for each vector with its leaf, and for each node with its children, ranges and point."""
        order = np.concatenate(self.leaves)
        page = np.repeat(np.arange(len(self.leaves)), [len(x) for x in self.leaves])
        nodes = [np.concatenate([np.array(x[1:], float), x[0]]) for x in self.nodes]
        kind = np.repeat(np.array([_VECTOR, _NODE], np.int8), [len(order), len(nodes)])
        return kind, np.concatenate([page, np.arange(len(nodes))]), [*self.ids[order].tolist(), *[None] * len(nodes)], [*self.vectors[order], *nodes]

    def _visit(self, members, rows, qids, q, best, names, limit) -> None:
        """Takes the members of a leaf into the best of some queries: dot products screen, exact distances decide."""
        x, own = self.vectors[members], self.norms[members]
        ask = q[rows]
        norm = (ask**2).sum(-1)
        rough = norm[:, None] + own[None] - 2 * (ask @ x.T)
        most = np.minimum(best[rows, -1], limit[rows]) ** 2
        r, c = np.nonzero(rough <= most[:, None] + SLACK * (norm[:, None] + own[None]))
        other = self.ids[members][c] != qids[rows][r]
        r, c = r[other], c[other]
        if not len(r):
            return
        d = np.empty(len(r))
        step = max(1, _CHUNK // x.shape[1])
        for i in range(0, len(r), step):
            d[i : i + step] = np.sqrt(((ask[r[i : i + step]] - x[c[i : i + step]]) ** 2).sum(-1))
        k = best.shape[1]
        hit = np.unique(r)
        who = np.concatenate([np.repeat(hit, k), r])
        d = np.concatenate([best[rows[hit]].ravel(), d])
        n = np.concatenate([names[rows[hit]].ravel(), self.ids[members][c]])
        order = np.lexsort((n, d, who))
        who, d, n = who[order], d[order], n[order]
        first = np.searchsorted(who, hit)
        at = first[:, None] + np.arange(k)[None]  # every query has at least its k former entries
        best[rows[hit]], names[rows[hit]] = d[at], n[at]

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, relax: float, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest of each query, none beyond ``limit``; missing ones have the distance inf."""
        if limit is None:
            limit = np.full(len(q), np.inf)
        best = np.full((len(q), k), np.inf)
        names = np.full((len(q), k), np.iinfo(np.int64).max)
        stack: list[tuple] = [(self.root, np.arange(len(q)), np.zeros(len(q)))]
        while stack:
            node, rows, bound = stack.pop()
            go = relax * bound <= np.minimum(best[rows, -1], limit[rows]) * (1 + SLACK) + 1e-12
            rows = rows[go]
            if not len(rows):
                continue
            if node < 0:
                for i in range(0, len(self.leaves[-1 - node]), 1024):
                    self._visit(self.leaves[-1 - node][i : i + 1024], rows, qids, q, best, names, limit)
                continue
            point, left, right, a, b, c, e = self.nodes[node]
            d = distances(q[rows], point[None])[:, 0]
            low = np.maximum(np.maximum(a - d, d - b), 0)
            high = np.maximum(np.maximum(c - d, d - e), 0)
            near = low <= high
            # popped in reverse: both near sides come before both far sides
            stack += [(left, rows[~near], low[~near]), (right, rows[near], high[near]), (right, rows[~near], high[~near]), (left, rows[near], low[near])]
        return names, best


class TopTree:
    """Rings around vantage points of a sample: the shard of a vector, and the shards that a query has to see.

    ``paths`` holds for each shard its nodes and sides from the root; ``ranges``
    the least and largest distances of its rows to those nodes' points.
    """

    def __init__(self, sample: np.ndarray, shards: int):
        rng = np.random.default_rng(7)
        self.points, self.cuts, self.children = [], [], []
        heap = [(-len(sample), 0, np.arange(len(sample)), ())]
        done, turn = [], 1
        while heap and len(heap) + len(done) < shards:
            _, _, rows, path = heapq.heappop(heap)
            point = sample[rows[rng.integers(len(rows))]] if len(rows) > 1 else None
            d = distances(point[None], sample[rows])[0] if point is not None else np.zeros(1)
            inner = d <= np.median(d)
            if inner.all():
                inner = d < d.max()
            if inner.all() or not inner.any():
                done.append(path)
                continue
            node = len(self.points)
            self.points.append(point)
            self.cuts.append(d[inner].max())
            self.children.append([0, 0])
            for side, part in ((0, rows[inner]), (1, rows[~inner])):
                heapq.heappush(heap, (-len(part), turn, part, (*path, (node, side))))
                turn += 1
        self.paths = sorted(done + [x[3] for x in heap])
        for shard, path in enumerate(self.paths):
            for at, (node, side) in enumerate(path):
                self.children[node][side] = path[at + 1][0] if at + 1 < len(path) else -1 - shard
        self.points, self.cuts, self.children = np.array(self.points), np.array(self.cuts), np.array(self.children)
        self.ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The shard of each vector."""
        at = np.full(len(x), 0 if len(self.points) else -1)
        step = max(1, _CHUNK // max(1, x.shape[1]))
        while (open_ := np.flatnonzero(at >= 0)).size:
            for i in range(0, len(open_), step):
                rows = open_[i : i + step]
                d = np.sqrt(((x[rows] - self.points[at[rows]]) ** 2).sum(-1))
                at[rows] = self.children[at[rows], (d > self.cuts[at[rows]]).astype(int)]
        return -1 - at

    def spread(self, shard: int, x: np.ndarray) -> np.ndarray:
        """Least and largest distance of some vectors of a shard to each vantage point on its path."""
        d = [distances(self.points[node][None], x)[0] for node, _ in self.paths[shard]]
        return np.array([[y.min(), y.max()] for y in d]).reshape(-1, 2)

    def visits(self, x: np.ndarray, own: np.ndarray, limit: np.ndarray, relax: float) -> list[np.ndarray]:
        """For each query the other shards whose relaxed bound lies within its limit."""
        d = distances(x, self.points) if len(self.points) else np.zeros((len(x), 0))
        wanted = np.zeros((len(x), len(self.paths)), bool)
        for shard, (low, high) in self.ranges.items():
            nodes = [node for node, _ in self.paths[shard]]
            bound = np.maximum(low - d[:, nodes], d[:, nodes] - high).max(axis=1, initial=0)
            wanted[:, shard] = relax * bound <= limit * (1 + SLACK) + 1e-12
        wanted[np.arange(len(x)), own] = False
        return [np.flatnonzero(row) for row in wanted]


_VECTOR, _NODE, _SPREAD = 0, 1, 2
_INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("piece", pa.int32()), ("kind", pa.int8()), ("place", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.float64()))])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(part: pa.Table) -> np.ndarray:
    v = part.column("v").combine_chunks()
    flat = np.asarray((v.flatten() if isinstance(v, pa.ListArray) else v.chunk(0).flatten()), np.float64)
    return flat.reshape(part.num_rows, -1)


def _by_dim(part: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places of its rows, their vectors)."""
    dims = np.asarray(part.column("dim"))
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield int(dim), rows, _matrix(part.take(pa.array(rows)))


def _assign(tops: dict[int, TopTree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.Table.from_batches([batch])
            shard = np.zeros(len(batch), np.int32)
            for dim, rows, x in _by_dim(part):
                if dim in tops:
                    shard[rows] = tops[dim].assign(x)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "v", "dim")] + [pa.array(shard)], names=["id", "v", "dim", "shard"])

    return run


def _build(tops: dict[int, TopTree]):
    """Index rows of one piece."""

    def run(part: pa.Table) -> pa.Table:
        dim, shard, piece = (part.column(c)[0].as_py() for c in ("dim", "shard", "piece"))
        x = _matrix(part)
        kind, place, ids, numbers = VantageTree(np.asarray(part.column("id")), x).index_rows()
        spread = tops[dim].spread(shard, x) if dim in tops else np.zeros((0, 2))
        kind = np.concatenate([kind, np.full(len(spread), _SPREAD, np.int8)])
        place = np.concatenate([place, np.arange(len(spread))]).astype(np.int32)
        same = [pa.array(np.full(len(kind), c, np.int32)) for c in (dim, shard, piece)]
        return pa.table([*same, pa.array(kind), pa.array(place), pa.array([*ids, *[None] * len(spread)], pa.int64()), pa.array([*numbers, *spread], pa.list_(pa.float64()))], schema=_INDEX)

    return run


def _route(tops: dict[int, TopTree], relax: float):
    """The queries with the further shards of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                part = pa.Table.from_batches([batch])
                own, limit = np.asarray(batch.column("shard")), np.asarray(batch.column("most"))
                more: list = [[]] * len(batch)
                for dim, rows, x in _by_dim(part):
                    if dim in tops:
                        for row, shards in zip(rows, tops[dim].visits(x, own[rows], limit[rows], relax)):
                            more[row] = shards.astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("query_id", "v", "dim", "most")] + [pa.array(more, pa.list_(pa.int32()))], names=["query_id", "v", "dim", "most", "shards"])

    return run


def _search_cell(k: int, relax: float):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        qids = np.asarray(queries.column("query_id"))
        names, best = VantageTree.of_index(vectors).search(qids, _matrix(queries), k, relax, np.asarray(queries.column("most")))
        ok = np.isfinite(best)
        return pa.table([pa.array(np.repeat(qids, k)[ok.ravel()]), pa.array(names[ok]), pa.array(best[ok])], schema=_FOUND)

    return run


def _top_trees(raw: DataFrame) -> tuple[dict[int, TopTree], int]:
    """A top tree for each sampled dimension, and the rows of a piece."""
    size = raw.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    n, dim = size["n"], size["dim"] or 1
    piece = max(64, SHARD_BYTES // (8 * dim))
    shards = min(SHARDS, -(-n // piece))
    rows = min(SAMPLE_A_SHARD * shards, SAMPLE_BYTES // (8 * dim) + 1)
    share = min(1.0, rows / max(1, n))
    sample = raw.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "v", "dim").toArrow()
    return {d: TopTree(x, max(1, round(shards * len(x) / sample.num_rows))) for d, _, x in _by_dim(sample)}, piece


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, relax: float = RELAX) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row that ``is_query`` (a column over ``id``) selects."""
    v = quoted(vector_col).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    raw = vectors.select(quoted(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(usable, F.lit(False))).withColumn("dim", F.size("v"))
    with scratch(vectors.sparkSession) as hand_on:
        tops, most = _top_trees(raw)
        rows = raw.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
        placed = stored(rows.mapInArrow(_assign(tops), "id long, v array<double>, dim int, shard int"))
        pieces = stored(placed.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("pieces")))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        cut = placed.join(pieces, ["dim", "shard"]).withColumn("piece", dealt("id", "pieces"))
        index = hand_on(cut.groupBy("dim", "shard", "piece").applyInArrow(_build(tops), "dim int, shard int, piece int, kind byte, place int, id long, v array<double>"))
        spread = index.where(F.col("kind") == _SPREAD).groupBy("dim", "shard", "place").agg(F.min(F.col("v")[0]).alias("low"), F.max(F.col("v")[1]).alias("high"))
        for (dim, shard), part in spread.orderBy("place").toPandas().groupby(["dim", "shard"]):  # at most SHARDS paths
            tops[int(dim)].ranges[int(shard)] = part["low"].to_numpy(), part["high"].to_numpy()
        key = ["dim", "shard", "piece", "block"]

        def searched(visits: DataFrame) -> DataFrame:
            """The k best of each piece for the queries (query_id, v, dim, shard, most) that visit its shard."""
            met = visits.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")).join(pieces, ["dim", "shard"])
            met = hand_on(met)
            seek = visits.join(met, ["dim", "shard"]).withColumn("block", dealt("query_id", "blocks")).withColumn("piece", every("pieces"))
            store = index.where(F.col("kind") != _SPREAD).join(met.select("dim", "shard", "blocks"), ["dim", "shard"]).withColumn("block", every("blocks"))
            seek, store = seek.select(*key, "query_id", "v", "most"), store.select(*key, "kind", "place", "id", "v")
            return store.groupBy(*key).cogroup(seek.groupBy(*key)).applyInArrow(_search_cell(k, relax), "query_id long, vec_id long, score double")

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        asked = placed.where(is_query).select(F.col("id").alias("query_id"), "v", "dim", "shard")
        first = hand_on(searched(asked.withColumn("most", F.lit(float("inf")))).withColumn("rank", rank).where(F.col("rank") <= k))
        bound = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("most"))
        known = asked.join(bound, "query_id", "left").fillna(float("inf"), ["most"])
        routed = hand_on(known.mapInArrow(_route(tops, relax), "query_id long, v array<double>, dim int, most double, shards array<int>"))
        more = searched(routed.select("query_id", "v", "dim", F.explode("shards").alias("shard"), "most"))
    found = first.drop("rank").union(more)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op7_neighbours")
def op7_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
