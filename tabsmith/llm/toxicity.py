"""Toxicity by multiple-instance learning (operator 3).

A document is a bag of sentences.  A sentence has a logistic score over hashed
words and word beginnings; a document is toxic if any sentence is (noisy-or):
``1 - prod(1 - p_sentence)``.  The weights are fitted to document labels alone,
and the sentence scores then locate the offending sentences.

Fitting uses at most ``SAMPLE_ROWS`` labelled rows, the first in the order of a
hash of the id, each with a text of at most ``SAMPLE_TEXT_BYTES``; these two
parameters bound the one task that fits; the driver gets the weights.  Scoring reads every whole text in one
pass without a shuffle, with a model of at most ``FEATURES`` weights.

Edge rows: a null, empty or wordless text has no sentence and the score 0.
Without labelled rows, or without a toxic one, every score is 0.  A row with a
null id is scored and not held out.  Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import query, table
from .shared import bound_batches, quoted
from .textkernel import Words, slices, text_buffers

SAMPLE_ROWS = 5000
SAMPLE_TEXT_BYTES = 1 << 15
FEATURES = 20000
THRESHOLD = 0.3
OFFENDING = 0.5
PREFIXES = (3, 4, 5, 6)
ROUNDS = 200
PENALTY = 1e-3

_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOPS = np.zeros(256, bool)
_STOPS[[10, 13, 33, 46, 63]] = True  # line ends, ! . ?
_SKETCH_BITS = 22


@dataclass
class Model:
    bias: float
    features: np.ndarray  # sorted hashes
    weights: np.ndarray

    def sketch(self) -> np.ndarray:
        """A bit table that lets nearly all foreign features be skipped."""
        bits = np.zeros(1 << _SKETCH_BITS, bool)
        bits[(self.features & np.uint64((1 << _SKETCH_BITS) - 1)).astype(np.int64)] = True
        return bits


def sentences(data: np.ndarray, offs: np.ndarray):
    """Words, first word of each sentence, and text of each sentence."""
    words = Words(data, offs, lower=True, separators=_SEPARATORS)
    doc = words.doc_of()
    if not len(words):
        return words, np.zeros(0, np.int64), doc
    stop = np.cumsum(_STOPS[data], dtype=np.int32)[words.starts]
    heads = np.flatnonzero(np.concatenate(([True], (stop[1:] != stop[:-1]) | (doc[1:] != doc[:-1]))))
    return words, heads, doc[heads]


def _features(words: Words) -> list[np.ndarray]:
    return [words.hashes(), *words.prefixes(PREFIXES).values()]


def _tell_apart(code: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features that speak for label 1 beyond chance: by the likelihood ratio of their document counts."""
    n = len(y)
    seen = np.unique(code * np.int64(n) + doc)
    toxic = y[seen % n] > 0
    total = np.bincount(seen // n)
    pos = np.bincount((seen // n)[toxic], minlength=len(total))
    share = y.mean()
    rate = np.clip(pos / total, 1e-12, 1 - 1e-12)
    ratio = 2 * (pos * np.log(rate / share) + (total - pos) * np.log((1 - rate) / max(1 - share, 1e-12)))
    ratio[rate <= share] = 0
    best = np.argsort(-ratio, kind="stable")[: FEATURES // (len(PREFIXES) + 1)]
    # so much evidence that about one feature in all would show it by chance
    return np.sort(best[ratio[best] >= 1.5 * np.log(max((total >= 3).sum(), 2))])


def fit(texts: list[str], labels: list[int]) -> Model:
    """Noisy-or model by gradient descent on the document likelihood, with an L1 penalty."""
    y = np.asarray(labels, float)
    nothing = Model(-np.inf, np.zeros(0, np.uint64), np.zeros(0))
    if not len(y) or not y.any():
        return nothing
    data, offs = text_buffers(pa.array(texts, pa.large_string()))
    words, heads, doc = sentences(data, offs)
    if not len(words):
        return nothing
    word_doc = words.doc_of().astype(np.int64)
    sentence = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(words))))
    names, rows, cols = [], [], []
    for h in _features(words):  # one kind of feature at a time bounds the memory
        found, code = np.unique(h, return_inverse=True)
        best = _tell_apart(code, word_doc, y)
        place = np.full(len(found), -1, np.int64)
        place[best] = np.arange(len(best))
        use = np.flatnonzero(place[code] >= 0)
        pairs = np.unique(sentence[use] * np.int64(len(best) + 1) + place[code[use]])
        rows.append(pairs // (len(best) + 1))
        cols.append(pairs % (len(best) + 1) + sum(map(len, names)))
        names.append(found[best])
    names, rows, cols = np.concatenate(names), np.concatenate(rows), np.concatenate(cols)

    w, b = np.ones(len(names)), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = np.clip(b + np.bincount(rows, w[cols], len(heads)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        free = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        toxic = np.clip(1 - free, 1e-9, 1)
        g = (p * np.where(y > 0, -free / toxic, 1.0)[doc]) / len(y)
        gw, gb = np.bincount(cols, g[rows], len(names)), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.3 / (1 + t / 40)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
        w = np.maximum(w - step * PENALTY, 0)  # evidence only adds up, so long sentences don't dilute it
    kept = w > 1e-3
    order = np.argsort(names[kept])
    return Model(float(b), names[kept][order], w[kept][order])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Model from labelled rows whose crc32(id) mod 4 is not 2."""
    key = quoted(id_col)
    picked = (
        labels.select(key.cast("long").alias("id"), quoted(label_col).alias("y")).where("id IS NOT NULL AND y IS NOT NULL AND crc32(cast(id AS string)) % 4 <> 2")
        .orderBy(F.xxhash64("id"), "id", "y").limit(SAMPLE_ROWS)
    )
    texts = docs.select(key.cast("long").alias("id"), quoted(text_col).alias("text")).where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    sample = texts.join(F.broadcast(picked), "id").orderBy("id", "y", "text").limit(SAMPLE_ROWS).select("text", (F.col("y") > 0).cast("int").alias("y"))
    bound_batches(sample)
    found = sample.coalesce(1).mapInArrow(_fitted, "bias double, features binary, weights binary").first()  # the sample is one task; the texts don't pass the driver
    return Model(found["bias"], np.frombuffer(found["features"], np.uint64), np.frombuffer(found["weights"])) if found else fit([], [])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the sample as one row."""
    texts, labels = [], []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        labels += batch.column("y").to_pylist()
    model = fit(texts, labels)
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.bias]), pa.array([model.features.astype(np.uint64).tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary())],
        names=["bias", "features", "weights"],
    )


def _score(model: Model):
    bits = model.sketch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for i, j in slices(offs):
                words, heads, doc = sentences(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                sentence = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(words))))
                found = [np.zeros(0, np.int64)]
                if len(model.features) and len(words):
                    for h in _features(words):
                        at = np.flatnonzero(bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)])
                        place = np.minimum(np.searchsorted(model.features, h[at]), len(model.features) - 1)
                        hit = model.features[place] == h[at]
                        found.append(sentence[at[hit]] * len(model.features) + place[hit])
                found = np.unique(np.concatenate(found))  # a feature counts once a sentence, as in the fit
                z = np.bincount(found // max(len(model.features), 1), model.weights[found % max(len(model.features), 1)], len(heads)) + model.bias
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700))) if np.isfinite(model.bias) else np.zeros(len(z))
                free = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), j - i)
                score = np.clip(-np.expm1(free), 0, 1)
                bad = np.flatnonzero(p >= OFFENDING)
                ends = words.ends[np.append(heads[1:], len(words)) - 1] if len(heads) else heads
                spans = [[] for _ in range(j - i)]
                for s in bad.tolist():
                    begin = words.starts[heads[s]] - words.offs[doc[s]]
                    spans[doc[s]].append({"start": int(begin), "length": int(ends[s] - words.starts[heads[s]]), "score": float(p[s])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(i, j - i), pa.array(score), pa.array(spans, _SPANS)], names=["row", "score", "sentences"]
                )

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (the input row as a struct), ``score`` and the offending ``sentences`` (byte ranges of the UTF-8 text)."""
    src = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(text_col).alias("text"))
    return _apply(src, model)


def _apply(src: DataFrame, model: Model) -> DataFrame:
    bound_batches(src)
    schema = T.StructType([T.StructField("row", src.schema["row"].dataType), T.StructField("score", T.DoubleType())])
    schema = schema.add("sentences", T._parse_datatype_string("array<struct<start:bigint,length:bigint,score:double>>"))
    return src.mapInArrow(_score(model), schema)


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = _apply(docs.select(F.struct("doc_id").alias("row"), "text"), model).select("row.doc_id", "score", F.size("sentences").cast("long").alias("n_offending"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_offending")
