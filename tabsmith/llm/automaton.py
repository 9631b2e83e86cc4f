"""Minimal acyclic automaton of a sorted word list, with a number for each word.

Words that share an ending share its states.  Every transition knows how many
words lie before it, so walking a word adds up its place in sorted order, and a
table gives that place's output (token ids).  The whole lexicon is one block of
bytes, which a worker maps into memory.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_ONE = [bytes([b]) for b in range(256)]
_ARRAYS = (("first", np.int32), ("final", np.uint8), ("byte", np.uint8), ("target", np.int32), ("skip", np.int32), ("out_first", np.int32), ("out", np.int32))


def compile_words(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The automaton of ``words`` and their outputs as bytes."""
    ordered = sorted(words)
    states: list[tuple] = []  # (final, ((byte, target), ...)), children before parents
    known: dict[tuple, int] = {}

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    path: list[list] = [[False, []]]  # open states along the last word
    last = b""
    for word in ordered:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for depth in range(len(last), same, -1):
            path[depth - 1][1].append((last[depth - 1], close(path.pop())))
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], close(path.pop())))
    root = close(path[0])

    below = []
    for final, moves in states:
        below.append(int(final) + sum(below[t] for _, t in moves))
    first, final, byte, target, skip = [0], [], [], [], []
    for is_final, moves in states:
        final.append(int(is_final))
        before = int(is_final)
        for b, t in moves:
            byte.append(b)
            target.append(t)
            skip.append(before)
            before += below[t]
        first.append(len(byte))
    out_first, out = [0], []
    for word in ordered:
        out.extend(words[word])
        out_first.append(len(out))
    arrays = [np.asarray(x, kind) for x, (_, kind) in zip((first, final, byte, target, skip, out_first, out), _ARRAYS)]
    head = np.array([root] + [a.nbytes for a in arrays], np.int64).tobytes()
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


class Lexicon:
    """A compiled automaton, mapped from an unnamed temporary file of the worker."""

    def __init__(self, raw: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            self._map = mmap.mmap(f.fileno(), len(raw), access=mmap.ACCESS_READ)
        n = len(_ARRAYS) + 1
        head = np.frombuffer(raw[: 8 * n], np.int64).tolist()
        self.root, at, view = head[0], 8 * n, memoryview(self._map)
        for (name, kind), size in zip(_ARRAYS, head[1:]):
            part = view[at : at + size]
            setattr(self, name, part if kind is np.uint8 else part.cast("i"))
            if name == "byte":
                self._moves = at  # where the bytes of the transitions begin
            at += size + (-size % 8)

        counts = np.diff(np.frombuffer(self.first, np.int32)).astype(np.int64)
        #: state and byte of every transition as one number, ascending
        self._keys = np.repeat(np.arange(len(counts)) << 8, counts) | np.frombuffer(self.byte, np.uint8)

    def __len__(self) -> int:
        return len(self.out_first) - 1

    def find(self, word: bytes) -> tuple[int, ...] | None:
        """Output of a word, or None if the lexicon lacks it."""
        state, place = self.root, 0
        first, target, skip, search, begin = self.first, self.target, self.skip, self._map.find, self._moves
        for b in word:
            at = search(_ONE[b], begin + first[state], begin + first[state + 1]) - begin
            if at < 0:
                return None
            place += skip[at]
            state = target[at]
        if not self.final[state]:
            return None
        return tuple(self.out[self.out_first[place] : self.out_first[place + 1]])

    def find_all(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """``find`` of many words: all walk the automaton together, a byte at a time."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(size) - size
        state, place, live = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        target, skip, final = np.frombuffer(self.target, np.int32), np.frombuffer(self.skip, np.int32), np.frombuffer(self.final, np.uint8)
        depth = 0
        while len(live) and len(self._keys):
            live = live[size[live] > depth]
            key = state[live] << 8 | raw[begin[live] + depth]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            ok = self._keys[at] == key
            state[live[~ok]] = -1
            live, at = live[ok], at[ok]
            place[live] += skip[at]
            state[live] = target[at]
            depth += 1
        found = (state >= 0) & (final[np.maximum(state, 0)] > 0) & ((size == 0) | bool(len(self._keys)))
        first, out = self.out_first, self.out
        return [tuple(out[first[k] : first[k + 1]]) if ok else None for ok, k in zip(found.tolist(), place.tolist())]
