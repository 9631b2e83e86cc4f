"""Recompression: a run-length grammar of an integer sequence, and longest common extensions on it.

Levels alternate.  A block level turns every maximal run of one symbol into one
symbol (a, k).  A pair level draws a side for every symbol and joins each left
symbol with a right one behind it.  Equal stretches are therefore parsed alike
but for their edges, and an extension climbs the levels while it can and steps
over one pair or one run where its two places do not start a symbol together.
Symbols get their numbers from the exact pairs and runs, never from a hash.

The sequence holds parts with a separator before, between and behind them; each
separator is a symbol of its own and is never joined, so no extension leaves its
part.  The number of levels is logarithmic in the longest part, and memory is
linear in the sequence.
"""

from __future__ import annotations

import numpy as np


class Level:
    """From one level to the next: the parent of each symbol, and the first symbol below each parent."""

    def __init__(self, heads: np.ndarray, size: int, block: bool):
        self.block = block
        self.first = np.append(heads, size).astype(np.int32)
        mark = np.zeros(size, np.int32)
        mark[heads] = 1
        self.parent = np.cumsum(mark, dtype=np.int32) - 1


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each pair, in the order of the pairs, so that separators keep the largest numbers."""
    names, out = np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)
    return out.astype(np.int32), len(names)


class Grammar:
    """Levels over ``symbols`` (0 to n_symbols - 1), whose ``separators`` largest ones are the separators."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, separators: int, seed: int = 11):
        self.symbols = [symbols.astype(np.int32)]
        self.levels: list[Level] = []
        rng = np.random.default_rng(seed)
        while True:
            s = self.symbols[-1]
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            if not new.all():
                heads = np.flatnonzero(new)
                n_symbols = self._add(heads, s[heads], np.diff(np.append(heads, len(s))), True)
                s = self.symbols[-1]
            inner = s < n_symbols - separators
            if not (inner[:-1] & inner[1:]).any():
                break
            left = (rng.integers(0, 2, n_symbols) == 1)[s]
            one, two = inner[:-1] & left[:-1] & inner[1:] & ~left[1:], inner[:-1] & ~left[:-1] & inner[1:] & left[1:]
            joins = one if np.count_nonzero(one) >= np.count_nonzero(two) else two
            if not joins.any():
                continue
            new = np.ones(len(s), bool)
            new[1:] = ~joins
            heads = np.flatnonzero(new)
            ahead = np.append(joins, False)[heads]
            n_symbols = self._add(heads, s[heads], np.where(ahead, s[np.minimum(heads + 1, len(s) - 1)], n_symbols), False)

    def _add(self, heads: np.ndarray, a: np.ndarray, b: np.ndarray, block: bool) -> int:
        self.levels.append(Level(heads, len(self.symbols[-1]), block))
        s, n = _numbered(a, b)
        self.symbols.append(s)
        return n

    def extend(self, x: np.ndarray, y: np.ndarray, forward: bool = True) -> np.ndarray:
        """Number of equal symbols from places x and y (x < y) on, or back from them, themselves included."""
        x0, x, y = x, x.astype(np.int64), y.astype(np.int64)
        sign = 1 if forward else -1
        differ = np.full(len(x), -1, np.int32)  # the level on which the two places are known to differ
        live = np.arange(len(x))
        for h, up in enumerate(self.levels):
            s, here, there = self.symbols[h], x[live], y[live]
            px, py = up.parent[here], up.parent[there]
            edge = up.first[1:] - 1 if not forward else up.first
            at = np.flatnonzero((edge[px] != here) | (edge[py] != there))
            if len(at):
                a, b = here[at], there[at]
                same = s[a] == s[b]
                if up.block:
                    ra = up.first[px[at] + 1] - a if forward else a - up.first[px[at]] + 1
                    rb = up.first[py[at] + 1] - b if forward else b - up.first[py[at]] + 1
                    step, bad = np.minimum(ra, rb), ~same | (ra != rb)
                else:
                    step, bad = 1, ~same
                step = sign * np.where(same, step, 0)
                here[at] += step
                there[at] += step
                x[live], y[live] = here, there
                differ[live[at[bad]]] = h
                live = np.delete(live, at[bad])
            x[live], y[live] = up.parent[x[live]], up.parent[y[live]]
        top, s = len(self.levels), self.symbols[-1]
        differ[live] = top
        while len(live):
            live = live[s[x[live]] == s[y[live]]]
            x[live] += sign
            y[live] += sign
        for h in range(top - 1, -1, -1):
            down, s = self.levels[h], self.symbols[h]
            at = np.flatnonzero(differ > h)
            a, b = x[at], y[at]
            size_a, size_b = down.first[a + 1] - down.first[a], down.first[b + 1] - down.first[b]
            a, b = (down.first[a], down.first[b]) if forward else (down.first[a + 1] - 1, down.first[b + 1] - 1)
            step = sign * np.where(s[a] == s[b], np.minimum(size_a, size_b) if down.block else 1, 0)
            x[at], y[at] = a + step, b + step
        return (x - x0) * sign
