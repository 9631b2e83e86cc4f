"""Best-fit packing into sequences of several lengths (operator 5).

Documents are cut into pieces of at most the longest permitted length.  Pieces
are dealt into shards of a bounded number of pieces; each shard packs its own,
longest first, into the open bin with the least room that is enough.  When none
has room, the bin size with the least cost for the tokens it can still hold is
opened; at the end each bin is cut down to the cheapest permitted length that
holds its contents.  The sizes are optimised jointly: a shard packs under the
least-cost rule and under each fixed preference of a size, and keeps the packing
with the least total cost.

The cost of a sequence of length L is ``OVERHEAD + L + L * L / ATTENTION``.

Edge rows: a document without words has one row without a bin.  Repeated rows
are packed one by one (rows are dealt by their place in the input, so many equal
rows spread out).  Null ids are packed as well.  An empty table packs to nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query, table
from .shared import bound_batches, quoted
from .textkernel import Words, mix, slices, text_buffers

SIZES = (512, 1024, 2048, 4096)
SHARD_PIECES = 16384
OVERHEAD = 32
ATTENTION = 32768


def cost(length: int) -> float:
    return OVERHEAD + length + length * length / ATTENTION


def _opening(size: int, rest: int, sizes: tuple[int, ...], prefer: int | None) -> int:
    """Size of the bin to open for a piece when ``rest`` tokens, this piece's included, are left."""
    fits = [s for s in sizes if s >= size]
    if prefer is not None:
        return next((s for s in fits if s >= prefer), fits[-1])
    return min(fits, key=lambda s: (cost(s) / min(s, rest), s))


def pack_lengths(lengths: list[int], sizes: tuple[int, ...] = SIZES, prefer: int | None = None) -> tuple[list[int], list[int], list[int], float]:
    """Bin and start of each piece (given longest first), final size of each bin, total cost."""
    bins, starts, used, opened = [0] * len(lengths), [0] * len(lengths), [], []
    rooms: list[int] = []  # different rooms of open bins, in order
    by_room: dict[int, list[int]] = {}
    rest = sum(lengths)
    for i, n in enumerate(lengths):
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        else:
            b, room = len(used), _opening(n, rest, sizes, prefer)
            used.append(0)
            opened.append(room)
        bins[i], starts[i] = b, used[b]
        used[b] += n
        rest -= n
        if room > n:
            left = by_room.setdefault(room - n, [])
            if not left:
                insort(rooms, room - n)
            left.append(b)
    final = [min((s for s in sizes if s >= u), key=cost) for u in used]
    return bins, starts, final, sum(map(cost, final))


def pack_best(lengths: list[int], sizes: tuple[int, ...] = SIZES):
    """The cheapest packing of the least-cost rule and of each preferred size."""
    return min((pack_lengths(lengths, sizes, p) for p in (None, *sizes)), key=lambda x: x[3])


_PIECES = "id long, piece int, start long, n_tokens long, shard int"
_PACKED = "id long, piece int, start long, n_tokens long, bin_id long, capacity int, position int"
_PACKED_ARROW = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("bin_id", pa.int64()), ("capacity", pa.int32()), ("position", pa.int32())])


def _pieces(longest: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            ids = batch.column("id")
            for i, j in slices(offs):
                n = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]).counts()
                parts = np.maximum(1, -(-n // longest))
                row = np.repeat(np.arange(j - i), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * longest
                shard = mix(np.arange(place, place + len(row)).astype(np.uint64)) % np.uint64(shards)
                place += len(row)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(np.minimum(n[row] - start, longest).astype(np.int64)), pa.array(shard.astype(np.int32))],
                    names=["id", "piece", "start", "n_tokens", "shard"],
                )

    return run


def _pack_shard(sizes: tuple[int, ...]):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("n_tokens", "descending"), ("id", "ascending"), ("piece", "ascending")])
        lengths = part.column("n_tokens").to_pylist()
        full = len(lengths) - sum(not n for n in lengths)  # pieces without tokens are last
        bins, starts, final, _ = pack_best(lengths[:full], sizes)
        shard = part.column("shard")[0].as_py() << 32
        none = [None] * (len(lengths) - full)
        out = [part.column(c) for c in ("id", "piece", "start", "n_tokens")]
        out += [pa.array([shard + b for b in bins] + none, pa.int64()), pa.array([final[b] for b in bins] + none, pa.int32()), pa.array(starts + none, pa.int32())]
        return pa.table(out, schema=_PACKED_ARROW)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = SIZES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """id, piece, start (first token of the piece in its document), n_tokens, bin_id, capacity, position (in the bin)."""
    bound_batches(docs)
    sizes = tuple(sorted(sizes))
    src = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    # a text of b bytes has at most (b + 1) / 2 words
    most = src.agg(F.sum(F.greatest(F.lit(1), F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / F.lit(2 * sizes[-1])))).alias("n")).first()["n"]
    shards = max(1, -(-int(most or 0) // shard_pieces))
    return src.mapInArrow(_pieces(sizes[-1], shards), _PIECES).groupBy("shard").applyInArrow(_pack_shard(sizes), _PACKED)


@query("op5_packing")
def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
