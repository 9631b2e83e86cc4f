"""Substring dedup by runs of windows that an earlier document holds (operator 4).

This stands in for a relative Lempel-Ziv parse: nothing is matched greedily
against a reference text.  The index entries are the ``window``-word sequences of
the corpus, dealt into hash blocks; each block answers, for every window of every
document, which earliest document holds it.  A factor is a maximal run of
consecutive windows with the same earliest holder; it need not occur there as one
phrase, as no positions are kept.  Windows that straddle the border of two factors
have an answer of their own, so a factor border never hides a repeat.  Every factor is at least ``window`` words long and becomes a duplicate
span; the words under the spans are removed.

Plan (no text is shuffled before the last join):

1. A slice of rows is tokenised; equal windows within the slice keep only the
   occurrences in the slice's smallest document, the others are repeats already.
   So a window that a third of all rows share reaches a block once per slice.
2. The rest goes to its block as packed arrays (8 bytes of hash, about one byte
   of position), one row per slice and block.
3. Each block sorts its hashes and sends the repeats back to their slice.
4. Each slice turns them into factors per document, which are stored, so
   that Spark can delete the shuffle files of the index.
5. Factors join the texts on (id, text hash), and the kept words are written.

A slice is named by a hash of all its ids and text hashes.  Windows are compared by
a 64-bit hash.  Blocks have a fixed size in text bytes;
their number follows the corpus.

Edge rows: a null or empty text has no words.  A row with a null id is neither
cut nor a reference.  Rows with the same id are no references of each other;
repeated rows get the same result.  Texts shorter than a window stay whole.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import query, table
from .shared import bound_batches, quoted, scratch, text_bytes
from .textkernel import Words, slices, text_buffers

WINDOW = 13
BLOCK_BYTES = 8 << 20
MIN_BLOCKS = 24

_PARTS = "block int, slice long, kind int, a binary, b binary, c binary, d binary"
_FACTORS = "id long, fp long, starts binary, lengths binary, refs binary"


def _planes(x: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane, so that zero bytes lie together and compress."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()


def _gaps(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=0).astype(np.uint32))


def _ungaps(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, np.uint32), dtype=np.int64)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_PARTS_ARROW = pa.schema([("block", pa.int32()), ("slice", pa.int64()), ("kind", pa.int32())] + [(c, pa.binary()) for c in "abcd"])
_FACTORS_ARROW = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("starts", pa.binary()), ("lengths", pa.binary()), ("refs", pa.binary())])

_INDEX, _REPEATS, _DIRECTORY = 0, 1, 2


def _slice_rows(ids: np.ndarray, known: np.ndarray, fps: np.ndarray, words: Words, window: int, blocks: int) -> list[tuple]:
    """Rows of one slice: its directory, the repeats that it knows itself, and its part of each index block."""
    hashes, at = words.grams(words.hashes(), window)
    doc = words.doc_of()[at]
    if not known.all():
        use = known[doc]
        hashes, doc = hashes[use], doc[use]
    name = hashlib.blake2b(np.int64(len(ids)).tobytes() + ids.tobytes() + fps.tobytes() + known.tobytes(), digest_size=8)
    slice_id = int.from_bytes(name.digest(), "little", signed=True)
    n_windows = np.bincount(doc, minlength=len(ids)).astype(np.int64)
    rows = [(slice_id % blocks, slice_id, _DIRECTORY, _planes(ids), _planes(fps), _planes(n_windows), None)]
    if not len(hashes):
        return rows
    owner = ids[doc]
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    least = np.repeat(np.minimum.reduceat(owner[order], heads), np.diff(np.append(heads, len(order))))
    first = np.empty(len(order), np.int64)
    first[order] = least
    sent = owner == first
    if not sent.all():
        again = np.flatnonzero(~sent)
        rows.append((slice_id % blocks, slice_id, _REPEATS, _gaps(again), _planes(first[again]), None, None))
    at = np.flatnonzero(sent)
    keys = hashes[at]
    block = ((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(block.astype(np.uint16) if blocks <= 1 << 16 else block, kind="stable")
    at, keys, block, owner = at[order], keys[order], block[order], doc[at][order]
    cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
    for lo, hi in itertools.pairwise(cuts):
        heads = np.flatnonzero(np.concatenate(([True], np.diff(owner[lo:hi]) != 0)))
        rows.append((
            int(block[lo]), slice_id, _INDEX, keys[lo:hi].tobytes(), _gaps(at[lo:hi]),
            _planes(ids[owner[lo:hi][heads]]), _planes(np.diff(np.append(heads, hi - lo)).astype(np.uint32)),
        ))
    return rows


def _index_parts(window: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = ~np.asarray(batch.column("id").is_null())
            ids = np.asarray(batch.column("id").fill_null(0))
            fps = np.asarray(batch.column("fp").fill_null(0))
            data, offs = text_buffers(batch.column("text"))
            for i, j in slices(offs):
                words = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield _batch(_slice_rows(ids[i:j], known[i:j], fps[i:j], words, window, blocks), _PARTS_ARROW)

    return run


def _answer_block(part: pa.Table) -> pa.Table:
    """One index block: repeats of each slice, with the earliest document that holds them."""
    rows = part.to_pylist()
    out = [(r["block"], r["slice"], r["kind"], r["a"], r["b"], r["c"], r["d"]) for r in rows if r["kind"] != _INDEX]
    rows = [r for r in rows if r["kind"] == _INDEX]
    if rows:
        keys = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows])
        owner = np.concatenate([np.repeat(_unplanes(r["c"], np.int64), _unplanes(r["d"], np.uint32)) for r in rows])
        order = np.argsort(keys)
        ordered = keys[order]
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        least = np.repeat(np.minimum.reduceat(owner[order], heads), np.diff(np.append(heads, len(order))))
        first = np.empty(len(order), np.int64)
        first[order] = least
        repeat = owner > first
        lo = 0
        for r in rows:
            hi = lo + len(r["a"]) // 8
            if repeat[lo:hi].any():
                here = np.flatnonzero(repeat[lo:hi])
                names, code = np.unique(first[lo:hi][here], return_inverse=True)
                out.append((r["block"], r["slice"], _REPEATS, _gaps(_ungaps(r["b"])[here]), _planes(names), _planes(code.astype(np.uint32)), None))
            lo = hi
    return pa.Table.from_batches([_batch(out, _PARTS_ARROW)]) if out else _PARTS_ARROW.empty_table()


def _parse_slice(window: int):
    def run(part: pa.Table) -> pa.Table:
        """Greedy factors of each document of one slice."""
        rows = part.to_pylist()
        head = next(r for r in rows if r["kind"] == _DIRECTORY)
        found = [r for r in rows if r["kind"] == _REPEATS]
        if not found:
            return _FACTORS_ARROW.empty_table()
        at = np.concatenate([_ungaps(r["a"]) for r in found])
        ref = np.concatenate([_unplanes(r["b"], np.int64) if r["c"] is None else _unplanes(r["b"], np.int64)[_unplanes(r["c"], np.uint32)] for r in found])
        at, order = np.unique(at, return_index=True)  # slices of the same rows share a name and have the same answers
        ref = ref[order]
        ids, fps = _unplanes(head["a"], np.int64), _unplanes(head["b"], np.int64)
        ends = np.cumsum(_unplanes(head["c"], np.int64))
        doc = np.searchsorted(ends, at, "right")
        begins = at - np.concatenate(([0], ends))[doc]
        new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(doc) != 0) | (np.diff(ref) != 0)))
        heads = np.flatnonzero(new)
        lengths = (np.diff(np.append(heads, len(at))) + window - 1).astype(np.int32)
        starts, refs, doc = begins[heads].astype(np.int32), ref[heads], doc[heads]
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(doc) != 0, [True])))
        out = [(int(ids[doc[a]]), int(fps[doc[a]]), starts[a:b].tobytes(), lengths[a:b].tobytes(), refs[a:b].tobytes()) for a, b in itertools.pairwise(cuts)]
        return pa.Table.from_batches([_batch(out, _FACTORS_ARROW)])

    return run


def _kept(keep_whole: bool):
    """The words of each text that no factor covers, or the text itself where none does and ``keep_whole`` is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _kept_batch(batch, keep_whole)

    return run


def _kept_batch(batch: pa.RecordBatch, keep_whole: bool) -> pa.RecordBatch:
    texts, begins, sizes, refs = (batch.column(c).to_pylist() for c in ("text", "starts", "lengths", "refs"))
    n_words, n_removed, kept, spans = [], [], [], []
    for text, s, n, r in zip(texts, begins, sizes, refs):
        words = (text or "").encode().split()
        n_words.append(len(words))
        if s is None:
            n_removed.append(0)
            kept.append(text if keep_whole else b" ".join(words).decode())
            spans.append([])
            continue
        s, n, r = np.frombuffer(s, np.int32), np.frombuffer(n, np.int32), np.frombuffer(r, np.int64)
        edge = np.zeros(len(words) + 1, np.int32)
        np.add.at(edge, s, 1)
        np.add.at(edge, s + n, -1)
        free = np.cumsum(edge[:-1]) == 0
        n_removed.append(len(words) - int(free.sum()))
        kept.append(b" ".join(itertools.compress(words, free.tolist())).decode())
        spans.append([{"start": a, "length": b, "ref": c} for a, b, c in zip(s.tolist(), n.tolist(), r.tolist())])
    return pa.RecordBatch.from_arrays(
        [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, _SPANS_ARROW)],
        names=["row", "n_words", "n_removed", "kept", "spans"],
    )


_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref", pa.int64())]))
_SPANS = "array<struct<start:int,length:int,ref:bigint>>"


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Factors of every document that has any: id, text hash, packed starts, lengths and reference ids."""
    src = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    blocks = max(MIN_BLOCKS, -(-text_bytes(src) // block_bytes))
    src = src.withColumn("fp", F.xxhash64("text"))
    parts = src.mapInArrow(_index_parts(window, blocks), _PARTS)
    answered = parts.groupBy("block").applyInArrow(_answer_block, _PARTS)
    return answered.groupBy("slice").applyInArrow(_parse_slice(window), _FACTORS).dropDuplicates(["id", "fp"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_whole: bool = False) -> DataFrame:
    """``row`` (all other input columns and the id, as a struct), n_words, n_removed, kept (text) and spans.

    With ``keep_whole`` a text without a repeat is left as it is, white space and null included.
    The factors are found and stored at once.
    """
    bound_batches(docs)
    with scratch(docs.sparkSession) as hand_on:  # after it nothing needs the index's shuffle files, which are about twice the texts
        found = hand_on(factors(docs, id_col, text_col, window))
    others = [quoted(c) for c in docs.columns if c.lower() != text_col.lower()]
    src = docs.select(F.struct(*others).alias("row"), quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")).withColumn("fp", F.xxhash64("text"))
    joined = src.join(found.hint("shuffle_hash"), ["id", "fp"], "left")
    row = src.schema["row"].dataType
    schema = T.StructType([T.StructField("row", row), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("spans", T._parse_datatype_string(_SPANS))])
    return joined.select("row", "text", "starts", "lengths", "refs").mapInArrow(_kept(keep_whole), schema)


@query("op4_substring_dedup", """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS x
  FROM w, unnest(range(1, greatest(len(words) - 11, 1))) AS t(i)),
least_ AS (SELECT x, min(doc_id) AS m FROM win GROUP BY x),
cut AS (
  SELECT DISTINCT doc_id, i + k AS j
  FROM (SELECT win.doc_id, i FROM win JOIN least_ USING (x) WHERE m < win.doc_id) r, unnest(range(0, 13)) AS t(k)),
cuts AS (SELECT doc_id, list(j) AS js FROM cut GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(words, lambda v, p: NOT list_contains(coalesce(js, []), p)), ' ')) AS kept_sha256
FROM w LEFT JOIN cuts ON w.doc_id = cuts.doc_id
""")
def op4_substring_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
