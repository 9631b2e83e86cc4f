"""BPE encoding and decoding with a frequent-word lexicon (operator 10).

The tokenizer is a JSON file of the public ``tokenizers`` format (word-level BPE
with byte symbols and an end-of-word suffix); its path is a parameter.  The
corpus' most frequent pieces (counted over all texts, at most
``LEXICON_WORDS``) are merged once and compiled with their ids into a minimal
acyclic automaton, which every worker maps into memory.  Pieces outside it are
merged exactly where they occur.  Texts are read once to count and once to
encode; nothing but the piece counts is shuffled.

Edge rows: a null or empty text has no ids and decodes to an empty text.  Texts
of any length are cut at white space, and long pieces are merged with a heap in
n log n.  Rows are independent, so repeated rows, ties and null ids need no
care; other columns pass through in ``row``.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Lexicon, compile_words
from .catalog import query, table
from .shared import bound_batches, most_frequent, quoted
from .textkernel import slices, text_buffers, words_of

LEXICON_WORDS = 1 << 16
#: Chunks that a worker remembers at a time, twice.
MEMO_CHUNKS = 1 << 16
#: Pieces of up to so many symbols are merged by a scan, longer ones with a heap.
SHORT = 48
_BITS = 24
_ID = (1 << _BITS) - 1
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """Printable symbol of each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Codec:
    """The parts of a tokenizer file that encoding and decoding need."""

    def __init__(self, spec: dict):
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, by_byte = spec["pre_tokenizer"]["pretokenizers"]
        plain = not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        plain = plain and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        if steps != ["NFC", "Replace", "Lowercase"] or (split["type"], by_byte["type"]) != ("Split", "ByteLevel") or model["type"] != "BPE" or spec["decoder"] or not plain:
            raise ValueError("this kind of tokenizer file is not supported")
        pattern = split["pattern"]["Regex"]
        self.whole_pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.ascii_pattern = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t\n\r\f\v"))
        #: pieces of many lower-case texts at once, with a line end behind each text
        self.line_pattern = re.compile(self.ascii_pattern.pattern + r"|\n")
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = model["vocab"]
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.outer = [vocab.get(s + self.suffix) for s in symbols]
        # left id and right id -> rank and id of both, each pair as one number
        self.whole = all(i is not None for i in self.inner + self.outer)
        self.inner_ids, self.outer_ids = (np.array([-1 if i is None else i for i in ids], np.int64) for ids in (self.inner, self.outer))
        self.merges = {vocab[a] << _BITS | vocab[b]: rank << _BITS | vocab[a + b] for rank, (a, b) in enumerate(model["merges"])}

        self.pair_keys = np.array(sorted(self.merges), np.int64)
        self.pair_values = np.array([self.merges[k] for k in self.pair_keys.tolist()], np.int64)

    @classmethod
    def read(cls, path: str) -> Codec:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def pieces(self, chunk: str) -> list[str]:
        """Pieces of a text without white space and special tokens."""
        if chunk.isascii():
            chunk = chunk.lower()
            return [chunk] if chunk.isalpha() else self.ascii_pattern.findall(chunk)
        if not unicodedata.is_normalized("NFC", chunk):
            chunk = unicodedata.normalize("NFC", chunk)
        # each character by itself: str.lower() has a rule for a final sigma
        chunk = "".join(map(str.lower, chunk)) if "\u03a3" in chunk else chunk.lower()
        return [chunk] if chunk.isalpha() else self.whole_pattern.findall(chunk)

    def sections(self, chunk: str) -> list[str]:
        """The chunk cut at special tokens."""
        if not any(s in chunk for s in self.special):
            return [chunk]
        return [s for s in regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", chunk) if s]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: the lowest-ranked pair is merged first, the leftmost of equals."""
        ids = [self.inner[b] for b in piece[:-1]] + [self.outer[piece[-1]]]
        ids = [i for i in ids if i is not None]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def merge_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` of many pieces: short ones of similar lengths side by side, in every step the best pair of each."""
        out: list = [None] * len(pieces)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) > SHORT or not self.whole:
                out[i] = self.merge(p)
            else:
                by.setdefault(-(-len(p) // 4) * 4, []).append(i)
        for width, rows in by.items():
            self._merge_block([pieces[i] for i in rows], rows, width, out)
        return out

    def _merge_block(self, pieces: list[bytes], names: list[int], width: int, out: list) -> None:
        size = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        col = np.arange(width)
        ids = np.where(col < size[:, None] - 1, self.inner_ids[raw], np.where(col == size[:, None] - 1, self.outer_ids[raw], -1))
        names = np.array(names)

        def rank(a, b):
            key = a << _BITS | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            return np.where((a >= 0) & (b >= 0) & (self.pair_keys[at] == key), self.pair_values[at], _NEVER)

        ranks = np.concatenate([rank(ids[:, :-1], ids[:, 1:]), np.full((len(ids), 1), _NEVER)], axis=1)
        while len(ids):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(ids)), at]
            done = best == _NEVER
            if done.any():
                for i, row in zip(names[done].tolist(), ids[done].tolist()):
                    out[i] = tuple(x for x in row if x >= 0)
                ids, ranks, at, best, names = ids[~done], ranks[~done], at[~done], best[~done], names[~done]
            row = np.arange(len(ids))
            if not len(ids):
                return
            source = np.minimum(col + (col > at[:, None]), width - 1)
            ids, ranks = ids[row[:, None], source], ranks[row[:, None], source]
            ids[:, -1], ranks[:, -1] = -1, _NEVER  # a merge leaves a place free
            ids[row, at] = best & _ID
            after = np.where(at + 1 < width, ids[row, np.minimum(at + 1, width - 1)], -1)
            ranks[row, at] = rank(ids[row, at], after)
            left = np.maximum(at - 1, 0)
            ranks[row, left] = np.where(at > 0, rank(ids[row, left], ids[row, at]), ranks[row, left])

    def _merge_short(self, ids: list[int]) -> tuple[int, ...]:
        get = self.merges.get
        found = [get(a << _BITS | b, _NEVER) for a, b in pairwise(ids)]
        while found:
            best = min(found)
            if best == _NEVER:
                break
            i = found.index(best)
            both = best & _ID
            ids[i : i + 2] = [both]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << _BITS | both, _NEVER)
            if i < len(found):
                found[i] = get(both << _BITS | ids[i + 1], _NEVER)
        return tuple(ids)

    def _merge_long(self, ids: list[int | None]) -> tuple[int, ...]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merges.get
        queue = [(m >> _BITS, i, ids[i], ids[i + 1], m & _ID) for i in range(n - 1) if (m := get(ids[i] << _BITS | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, both = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := get(both << _BITS | ids[k])) is not None:
                    heapq.heappush(queue, (m >> _BITS, i, both, ids[k], m & _ID))
            if (h := before[i]) >= 0 and (m := get(ids[h] << _BITS | both)) is not None:
                heapq.heappush(queue, (m >> _BITS, h, ids[h], both, m & _ID))
        return tuple(i for i in ids if i is not None)


class Recent(dict):
    """A memo of the last ``limit`` entries or more: when it is full it becomes the old half, and what is used again comes back."""

    def __init__(self, make, limit: int = MEMO_CHUNKS):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        return self.put(key, self.make(key) if value is None else value)

    def put(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids of white-space separated chunks; remembers a bounded number of them, as packed ids or as written out."""

    def __init__(self, codec: Codec, lexicon: bytes):
        self.codec, self.lexicon = codec, Lexicon(lexicon)
        self.seen = Recent(self._ids, MEMO_CHUNKS // 4)
        self.packed = Recent(lambda c: array("i", self._chunk(c)).tobytes())
        self.written = Recent(self._written)

    def _ids(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        ids = self.lexicon.find(raw)
        return self.codec.merge(raw) if ids is None else ids

    def _written(self, chunk: bytes) -> tuple[int, bytes, bytes]:
        """Number of ids, the decimal ids and their names, with one space between them."""
        return self._spelled(self._chunk(chunk))

    def _spelled(self, ids) -> tuple[int, bytes, bytes]:
        return len(ids), " ".join(map(str, ids)).encode(), b" ".join(map(self.codec.names.__getitem__, ids))

    def _known(self, chunks: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """``_written`` of different chunks; the new ones' pieces are looked up and merged together."""
        memo, old, seen = self.written, self.written.old, self.seen
        new = [c for c in chunks if c not in memo and c not in old and b"<|" not in c]
        plain = [c for c in new if c.isascii()]
        pieces = self.codec.line_pattern.findall(b"".join(c + b"\n" for c in plain).decode().lower())
        others = [self.codec.pieces(c.decode()) for c in new if not c.isascii()]
        fresh = [p for p in set(chain(pieces, *others)) if p != "\n" and p not in seen and p not in seen.old]
        ids_of = dict(zip(fresh, self.lexicon.find_all([p.encode() for p in fresh])))
        lacking = [p for p in fresh if ids_of[p] is None]
        ids_of |= zip(lacking, self.codec.merge_all([p.encode() for p in lacking]))
        found, ids, at = {}, [], iter(plain)
        for piece in pieces:
            if piece == "\n":
                found[next(at)] = self._spelled(ids)
                ids = []
            else:
                ids += ids_of[piece] if piece in ids_of else seen[piece]
        for c, parts in zip((c for c in new if not c.isascii()), others):
            found[c] = self._spelled([i for p in parts for i in (ids_of[p] if p in ids_of else seen[p])])
        out = [found[c] if c in found else memo[c] for c in chunks]
        for c, value in found.items():
            memo.put(c, value)
        for p, value in ids_of.items():
            seen.put(p, value)
        return out

    def _chunk(self, raw: bytes) -> tuple[int, ...]:
        codec = self.codec
        if b"<|" not in raw:
            pieces = codec.pieces(raw.decode())
            return self.seen[pieces[0]] if len(pieces) == 1 else tuple(chain.from_iterable(map(self.seen.__getitem__, pieces)))
        out: list[int] = []
        for part in codec.sections(raw.decode()):
            out.extend((codec.special[part],) if part in codec.special else chain.from_iterable(map(self.seen.__getitem__, codec.pieces(part))))
        return tuple(out)

    def encode(self, text: bytes) -> bytes:
        """Ids of a text as packed 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, text.split()))

    def write(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Number of ids, decimal ids and names of the tokens of each text; every different chunk is looked up once."""
        flat, bounds = words_of(texts)
        coded = flat.dictionary_encode()
        found = self._known(coded.dictionary.cast(pa.binary()).to_pylist())
        n, listed, decoded = zip(*found) if found else ((), (), ())
        n, at = np.array(n, np.int64), np.asarray(coded.indices)
        total = np.concatenate(([0], np.cumsum(n[at])))[bounds]
        if len(n) and not n.all():  # chunks without ids leave no space behind
            full = n[at] > 0
            at, bounds = at[full], np.concatenate(([0], np.cumsum(full)))[bounds]
        ends, at = pa.array(bounds.astype(np.int32)), pa.array(at)
        listed, decoded = (pc.binary_join(pa.ListArray.from_arrays(ends, pa.array(x, pa.binary()).cast(pa.string()).take(at)), " ") for x in (listed, decoded))
        return pa.array(np.diff(total)), listed, decoded


def _count(codec: Codec):
    def rows(counts: Counter) -> pa.RecordBatch:
        pieces: Counter = Counter()
        plain = [c for c in counts if c.isascii() and b"<|" not in c]
        at = iter(plain)
        n = counts[next(at)] if plain else 0
        for p in codec.line_pattern.findall(b"".join(c + b"\n" for c in plain).decode().lower()):
            if p == "\n":
                n = counts[next(at, None)]
            else:
                pieces[p] += n
        for chunk in counts.keys() - set(plain):
            n = counts[chunk]
            for part in codec.sections(chunk.decode()):
                if part not in codec.special:
                    for p in codec.pieces(part):
                        pieces[p] += n
        return pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.string()), pa.array(list(pieces.values()), pa.int64())], names=["piece", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            coded = words_of(batch.column("text"))[0].dictionary_encode()
            counts.update(dict(zip(coded.dictionary.cast(pa.binary()).to_pylist(), np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)).tolist())))
            if len(counts) > MEMO_CHUNKS:
                yield rows(counts)
                counts.clear()
        yield rows(counts)

    return run


def build_lexicon(docs: DataFrame, codec: Codec, text_col: str = "text", limit: int = LEXICON_WORDS) -> bytes:
    """Automaton of the most frequent pieces of all texts."""
    bound_batches(docs)
    counted = docs.select(quoted(text_col).alias("text")).mapInArrow(_count(codec), "piece string, n long")
    top = most_frequent(counted.groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1"), limit).collect()
    return compile_words({raw: codec.merge(raw) for r in top if 0 < len(raw := r["piece"].encode()) <= 64})


def _decoded(names: list[bytes], ids: pa.ListArray) -> pa.Array:
    flat, ends = np.asarray(ids.flatten()), np.cumsum(np.asarray(ids.value_lengths()))
    return pa.array([b" ".join(map(names.__getitem__, x.tolist())).decode() for x in np.split(flat, ends[:-1])], pa.string())


def _encode(codec: Codec, lexicon: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(codec, lexicon)
        gc.freeze()  # the merge table is no garbage: collections need not walk it
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lo in range(0, len(texts), 1000):
                part = [encoder.encode(t or b"") for t in texts[lo : lo + 1000].to_pylist()]
                offsets = np.cumsum([0] + [len(p) // 4 for p in part], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(part), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, len(part)), ids], names=["row", "ids"])

    return run


def _write(codec: Codec, lexicon: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(codec, lexicon)
        gc.disable()  # nothing here is cyclic
        try:
            for batch in batches:
                texts = batch.column("text")
                _, offs = text_buffers(texts)
                for i, j in slices(offs):
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), *encoder.write(texts.slice(i, j - i))], names=["row", "n", "listed", "decoded"])
        finally:
            gc.enable()

    return run


def _rows(docs: DataFrame, text_col: str, carry: list[str] | None) -> DataFrame:
    bound_batches(docs)
    return docs.select(F.struct(*[quoted(c) for c in carry or docs.columns]).alias("row"), quoted(text_col).alias("text"))


def encode(docs: DataFrame, codec: Codec, lexicon: bytes, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the carried columns, by default all, as a struct) and ``ids``."""
    src = _rows(docs, text_col, carry)
    schema = T.StructType([T.StructField("row", src.schema["row"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(_encode(codec, lexicon), schema)


def encode_written(docs: DataFrame, codec: Codec, lexicon: bytes, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """As ``encode``, with the number of ids, the ids written out (``listed``: decimal, one space between them) and ``decoded``."""
    src = _rows(docs, text_col, carry)
    schema = T.StructType([T.StructField("row", src.schema["row"].dataType), T.StructField("n", T.LongType()), T.StructField("listed", T.StringType()), T.StructField("decoded", T.StringType())])
    return src.mapInArrow(_write(codec, lexicon), schema)


def _decode(names: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            for lo in range(0, len(ids), 1000):
                part = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("ids"), _decoded(names, part.column("ids"))], names=["row", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """``row``, ``ids`` and ``decoded``: the tokens' names with one space between them, as the file has no decoder."""
    return encoded.select("row", "ids").mapInArrow(_decode(codec.names), T.StructType([*encoded.select("row", "ids").schema.fields, T.StructField("decoded", T.StringType())]))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_bpe")
def op10_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    codec = Codec.read(tokenizer_path())
    out = encode_written(docs, codec, build_lexicon(docs, codec), carry=["doc_id"])
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{'ids' if c == 'listed' else c}_sha256")
    return out.select("row.doc_id", F.col("n").alias("n_tokens"), digest("listed"), digest("decoded"))
