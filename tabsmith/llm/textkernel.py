"""Vectorised tokenising and hashing of Arrow text columns.

Words are maximal runs of bytes other than space and ``\\t\\n\\v\\f\\r``.
Everything works on the UTF-8 buffers of a slice of rows, so the cost is a few
NumPy passes over the bytes and memory is bounded by ``SLICE_BYTES`` or by the
longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
#: Bytes beyond which a word has a cryptographic hash: a polynomial modulo 2^64 maps some unequal words of 1,024 letters to one value.
LONG_WORD = 64

_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_S33 = np.uint64(33)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_CODES = np.where(IS_SPACE, np.uint64(0), _CODES)

_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    h = h ^ (h >> _S33)
    h *= _MIX1
    h ^= h >> _S33
    h *= _MIX2
    h ^= h >> _S33
    return h


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 256)
        p = np.full(size, _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row where a text is longer."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words one behind the other, and the bounds of each text among them."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    flat, offsets = lists.flatten(), np.asarray(lists.offsets)
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets - offsets[0]]
        flat = flat.filter(pa.array(full))
    return flat, offsets - offsets[0]


class Words:
    """Words of the texts ``data[offs[i]:offs[i+1]]``: byte ranges, and the word range of each text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False, separators: np.ndarray = IS_SPACE):
        self.data = LOWER[data] if lower else data
        self.offs = offs
        self.codes = _WORD_CODES if separators is IS_SPACE else np.where(separators, np.uint64(0), _CODES)
        n = len(data)
        word = ~separators[data]
        first = np.zeros(n + 1, bool)
        first[offs] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | first[:-1]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | first[1:])) + 1
        #: text i has the words bounds[i]:bounds[i+1]
        self.bounds = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: a polynomial, or a cryptographic one where unequal long words could share it."""
        n = len(self.starts)
        if not n:
            return np.zeros(0, np.uint64)
        out = np.empty(n, np.uint64)
        step = 1 << 18
        for a in range(0, n, step):
            b = min(a + step, n)
            s = self.starts[a:b]
            lo, hi = int(s[0]), int(self.ends[b - 1])
            rel = np.arange(hi - lo, dtype=np.int32)
            span = np.diff(np.append(s, hi)).astype(np.int64)
            rel -= np.repeat((s - lo).astype(np.int32), span)
            longest = int((self.ends[a:b] - s).max())
            p = powers(longest)
            np.minimum(rel, longest - 1, out=rel)
            vals = self.codes[self.data[lo:hi]] * p[rel]
            out[a:b] = np.add.reduceat(vals, s - lo)
        size = self.ends - self.starts
        out ^= size.astype(np.uint64) * _GRAM
        out = mix(out)
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            word = self.data[self.starts[i] : self.ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out

    def prefixes(self, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
        """64-bit hash of the first bytes of each word, for each of the lengths; shorter words give the whole word's."""
        h = np.zeros(len(self.starts), np.uint64)
        size = self.ends - self.starts
        last = max(len(self.data) - 1, 0)
        out = {}
        for j in range(max(lengths)):
            h *= _BASE
            h += np.where(size > j, self.codes[self.data[np.minimum(self.starts + j, last)]], np.uint64(0)) if len(h) else np.uint64(0)
            if j + 1 in lengths:
                out[j + 1] = mix(h + np.uint64(j + 1))
        return out

    def exact(self) -> pa.Array:
        """The words themselves."""
        texts = pa.Array.from_buffers(pa.large_string(), len(self.offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(self.offs, np.int64)), pa.py_buffer(np.ascontiguousarray(self.data))])
        return words_of(texts)[0]

    def doc_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.offs) - 1, dtype=np.int32), self.counts())

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of each run of k consecutive words of one text."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        ends = np.repeat(self.bounds[1:], self.counts())
        at = np.flatnonzero(np.arange(n) + k <= ends[:n])
        h = hashes[:n].copy()
        for j in range(1, k):
            h *= _GRAM
            h += hashes[j : j + n]
        return mix(h[at]), at
