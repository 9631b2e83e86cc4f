"""Periodic runs of words by recompression (operator 11).

A run is a stretch of consecutive words with the smallest period q, at least
``max(6, 4 * q)`` words long, that no neighbouring word extends.  A run with
period p holds 3p consecutive places whose word comes again p words later, so one
of them lies on the grid of multiples of 3p; over all p that are
n/3 * (1 + 1/2 + 1/3 + ...) places.  A place whose word and a neighbour's come
again is a candidate, and the grammar's longest common extensions to both sides
give its run exactly.  Multiples of a period give the same stretch and the
smallest period found names it.

Documents never meet, so there is no shuffle: each Arrow batch is one sequence of
exact word numbers with a separator around every document, and the grammar is
built over the documents that hold a candidate.

Edge rows: a null or empty text has no words and no runs; a null id is carried
like any other column.  A very long text is a batch of its own: work grows with
n log n, memory with n.  Repeated rows get the same result, ties have none to
break (runs are ordered by start, then period), an empty table gives no rows and
extra columns, whatever their names, are kept inside ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import query, table
from .recompression import Grammar
from .shared import bound_batches, quoted
from .textkernel import slices, text_buffers, words_of

LEAST = 6
POWER = 4
#: Texts that share a grammar, in bytes; a longer text has its own.
SLICE_BYTES = 1 << 20
_CHUNK = 1 << 18

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _joined(codes: np.ndarray, bounds: np.ndarray, docs: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The chosen documents as one sequence with a separator around each, and the first place of each."""
    sizes = np.diff(bounds)[docs]
    begins = np.concatenate(([1], 1 + np.cumsum(sizes + 1)))
    out = np.empty(begins[-1], np.int32)
    out[begins - 1] = n_words + np.arange(len(begins))
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(begins[:-1], sizes) + inside] = codes[np.repeat(bounds[docs], sizes) + inside]
    return out, begins


def _candidates(w: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) on the harmonic grid; documents come longest first, so those with room for a period are a prefix."""
    places, periods = [], []
    for p in range(1, int(sizes[0]) // POWER + 1):
        end = int(begins[np.searchsorted(-sizes, -POWER * p, "right")]) - 1
        at = np.flatnonzero(w[0 : end - p : 3 * p] == w[p : end : 3 * p]) * (3 * p)
        if len(at):
            at = at[(w[at - 1] == w[at + p - 1]) | (w[at + 1] == w[at + p + 1])]
            places.append(at)
            periods.append(np.full(len(at), p))
    return (np.concatenate(places), np.concatenate(periods)) if places else (np.zeros(0, np.int64),) * 2


def find_runs(codes: np.ndarray, bounds: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of every run of the documents ``codes[bounds[d]:bounds[d + 1]]``, by document, start and period."""
    none = (np.zeros(0, np.int64),) * 4
    sizes = np.diff(bounds)
    docs = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes >= LEAST)]
    if not len(docs):
        return none
    w, begins = _joined(codes, bounds, docs, n_words)
    at, p = _candidates(w, sizes[docs], begins)
    owner = np.searchsorted(begins, at, "right") - 1
    inside = at + p < begins[owner + 1] - 1
    at, p, owner = at[inside], p[inside], owner[inside]
    if not len(at):
        return none
    named = np.zeros(len(docs), bool)
    named[owner] = True
    shift = begins[owner]
    docs = docs[named]
    w, begins = _joined(codes, bounds, docs, n_words)
    owner = (np.cumsum(named) - 1)[owner]
    at = at - shift + begins[owner]
    grammar = Grammar(w, n_words + len(docs) + 1, len(docs) + 1)
    found = []
    for i in range(0, len(at), _CHUNK):
        a, q, d = (v[i : i + _CHUNK] for v in (at, p, owner))
        # the place itself is in both directions; both count it
        start = a - grammar.extend(a, a + q, False) + 1
        length = a + q + grammar.extend(a, a + q) - start
        ok = length >= np.maximum(LEAST, POWER * q)
        found.append(np.stack([d[ok], start[ok], length[ok], q[ok]]))
    d, start, length, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, length, start))
    d, start, length, q = d[order], start[order], length[order], q[order]
    new = np.ones(len(d), bool)
    new[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    d, start, length, q = d[new], start[new], length[new], q[new]
    start, d = start - begins[d], docs[d]
    order = np.lexsort((q, start, d))
    return d[order], start[order], length[order], q[order]


def _of_slice(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs, and the text without the repeats of its runs, of each text."""
    flat, bounds = words_of(texts)
    coded = flat.dictionary_encode()
    d, start, length, q = find_runs(np.asarray(coded.indices), bounds, max(len(coded.dictionary), 1))
    edge = np.zeros(len(flat) + 1, np.int32)
    np.add.at(edge, bounds[d] + start + q, 1)
    np.add.at(edge, bounds[d] + start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    left = np.concatenate(([0], np.cumsum(kept)))[bounds].astype(np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), flat.filter(pa.array(kept))), " ")
    runs = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, length, q)], fields=list(_RUN))
    return pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(len(bounds))).astype(np.int32)), runs), texts


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        _, offs = text_buffers(texts)
        for i, j in slices(offs, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), *_of_slice(texts.slice(i, j - i))], names=["row", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (all other input columns, as a struct), n_words, runs (start, length, period; by start, then period) and collapsed.

    ``collapsed`` holds the words that lie in no run behind its first period, with one space between them.
    """
    bound_batches(docs)
    others = [quoted(c) for c in docs.columns if c.lower() != text_col.lower()]
    src = docs.select(F.struct(*others).alias("row"), quoted(text_col).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("row", src.schema["row"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T._parse_datatype_string(_RUNS)), T.StructField("collapsed", T.StringType()),
    ])
    return src.mapInArrow(_find, schema)


#: The query's documents: in one of ten by the checksum of the id, all words from place a on repeat with period p.
_PLANTED = """
CASE WHEN h % 10 = 0 AND text IS NOT NULL THEN
  transform(array(filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')), words ->
    array_join(transform(
      transform(array(struct(size(words) AS n, CAST(floor(h / 10) AS BIGINT) AS g)), v -> struct(v.n AS n, v.g AS g, v.g % greatest(v.n, 1) AS a)),
      v -> array_join(transform(words, (w, i) ->
        CASE WHEN i < v.a THEN w ELSE words[CAST(v.a + (i - v.a) % (1 + floor((v.n - v.a) / (3 + v.g % 8))) AS INT)] END), ' ')), ''))[0]
ELSE text END
"""


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    found = periodic_runs(docs.select("doc_id", F.expr(_PLANTED).alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    found = found.select("row.doc_id", "runs", "collapsed", best.alias("best"), listed.alias("listed"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"), digest("listed").alias("runs_sha256"), digest("collapsed").alias("collapsed_sha256"),
    )
