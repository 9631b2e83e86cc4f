"""Tree scorer of the feature search (J1, J2): boosted trees of all candidates and folds side by side.

A generation of the search asks for the cross-validated R2 of up to 30 column
subsets.  A Spark ML fit for each subset and fold would be 150 job sequences, so
here one job serves one level of *all* the trees: every task adds up, for each
(candidate, fold, node, column, bin), the number of rows and the sum of residuals;
Spark sums these cells and picks the best split of each node on the executors.
What reaches the driver is one row for each node.  ``depth * rounds + 1`` jobs
score a generation, however many candidates it has.

The table is stored once with one byte for each column (its bin, 0 for a missing
value), the fold, and the target mapped to [-1, 1].  Residuals are added up as
integers, so splits, scores and the columns found are the same under every
partitioning and after a lost executor.  Rows without a finite target are left out;
an empty table gives fitness 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean
from .ordering import written

#: Residuals are counted in units of 2**-20, so 2**42 rows fit a 64-bit sum.
UNITS = 1 << 20
#: Equal-width parts of a range when bin edges are searched.
PARTS = 1024


@dataclass(frozen=True)
class TreeSpec:
    """Boosted trees: levels, trees, shrinkage, bins of a column (at most 254) and least rows on each side of a split."""

    depth: int = 2
    rounds: int = 4
    rate: float = 0.7
    bins: int = 32
    min_rows: int = 3

    def __post_init__(self) -> None:
        if not 1 <= self.bins <= 254:
            raise ValueError(f"{self.bins} bins: 1 to 254 are possible")


def bin_edges(df: DataFrame, cols: Sequence[str], bins: int) -> list[list[float]]:
    """Upper ends of the bins of each column, about equal in rows; a value that fills a bin alone keeps it.

    Ranges that hold more than a bin's share of rows are cut into ``PARTS`` parts of
    equal width until none does or it holds a single value.  A job counts the parts of
    all open ranges of all columns; there are fewer than ``bins`` open ranges a column.
    """
    names = [f"c{i}" for i in range(len(cols))]
    src = df.select(*[F.when(F.abs(clean(c)) < float("inf"), clean(c)).alias(n) for c, n in zip(cols, names)])
    long = src.unpivot([], names, "c", "v").where("v IS NOT NULL").select(F.substring("c", 2, 12).cast("int").alias("c"), "v")
    ends = long.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    total = {r["c"]: r["n"] for r in ends}
    done: dict[int, list[tuple]] = {c: [] for c in range(len(cols))}
    todo = [(r["c"], r["lo"], r["hi"], r["n"]) for r in ends]
    while todo:
        for c, lo, hi, n in todo:
            if lo == hi or n * bins <= total[c]:
                done[c].append((lo, hi, n))
        todo = [t for t in todo if t[1] != t[2] and t[3] * bins > total[t[0]]]
        if not todo:
            break
        ranges = df.sparkSession.createDataFrame([(c, lo, hi) for c, lo, hi, _ in todo], "c int, lo double, hi double")
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * PARTS), F.lit(PARTS - 1))
        inside = long.join(F.broadcast(ranges), "c").where("v BETWEEN lo AND hi")
        cut = inside.groupBy("c", "lo", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        todo = [(r["c"], r["a"], r["b"], r["n"]) for r in cut]
    out = []
    for c in range(len(cols)):
        edges, seen, prev = [], 0, None
        for lo, hi, n in sorted(done[c]):
            if edges and seen + n > (len(edges) + 1) * total[c] / bins and prev > edges[-1]:
                edges.append(prev)
            seen, prev = seen + n, hi
            if seen >= (len(edges) + 1) * total[c] / bins:
                edges.append(hi)
        out.append(edges[: bins - 1])
    return out


def _binned(df: DataFrame, cols: Sequence[str], target: str, fold: str, edges: list[list[float]]) -> DataFrame:
    """fold, _y in [-1, 1] and _bins: a byte for each column."""
    y = clean(target)
    rows = df.select(F.col(fold).cast("int").alias("fold"), F.when(F.abs(y) < float("inf"), y).alias("_y"),
                     *[F.when(F.abs(clean(c)) < float("inf"), clean(c)).alias(f"c{i}") for i, c in enumerate(cols)]).where("_y IS NOT NULL AND fold IS NOT NULL")
    ends = rows.agg(F.min("_y"), F.max("_y")).first()
    lo, hi = (ends[0], ends[1]) if ends[0] is not None else (0.0, 0.0)
    half = hi / 2 - lo / 2
    mapped = (F.col("_y") / 2 - F.lit(lo / 2 + hi / 2) / 2) / (half / 2) if half > 0 else F.lit(0.0)
    rows = rows.withColumn("_y", mapped)
    ups = [np.asarray(e) for e in edges]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            x = np.zeros((len(pdf), len(ups)), dtype=np.uint8)
            for i, e in enumerate(ups):
                v = pdf[f"c{i}"].to_numpy(dtype=np.float64)
                x[:, i] = np.where(np.isnan(v), 0, np.searchsorted(e, v, side="left") + 1)
            yield pd.DataFrame({"fold": pdf["fold"], "_y": pdf["_y"], "_bins": [r.tobytes() for r in x]})

    return rows.mapInPandas(run, "fold int, _y double, _bins binary")


@dataclass
class _Tree:
    """Splits of one tree in heap order; rows with a bin of at most ``bin`` go to the first child."""

    column: np.ndarray
    bin: np.ndarray
    value: np.ndarray  # of the nodes of the level below the last split

    def place(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row within the level ``levels``."""
        at = np.zeros(len(x), dtype=np.int64)
        row = np.arange(len(x))
        for level in range(levels):
            node = at + (1 << level) - 1
            at = 2 * at + (x[row, self.column[node]] > self.bin[node])
        return at


class TreeScorer:
    """Fitness of column subsets: mean fold R2 of boosted trees, floored at 0; 0 for an empty subset.

    Called with a boolean matrix (candidates x columns), as ``GeneticSelector.search``
    does.  ``block`` candidates are scored together, which bounds a task's cells.
    """

    def __init__(self, df: DataFrame, cols: Sequence[str], target: str, fold: str = "fold", spec: TreeSpec = TreeSpec(), block: int = 32):
        self.spec, self.width, self.block = spec, len(cols), block
        self.table = written(_binned(df, cols, target, fold, bin_edges(df, cols, spec.bins)))
        self.folds = sorted(r[0] for r in self.table.select("fold").distinct().collect())

    def __call__(self, members: np.ndarray) -> list[float]:
        return [max(0.0, float(np.mean(s))) if s and np.isfinite(s).all() else 0.0 for s in self.fold_scores(members)]

    def fold_scores(self, members: np.ndarray) -> list[list[float]]:
        """R2 of every fold for each candidate; an empty list for an empty subset or one fold."""
        subsets = [np.flatnonzero(m) for m in np.asarray(members, dtype=bool)]
        out: list[list[float]] = [[] for _ in subsets]
        wanted = [i for i, s in enumerate(subsets) if len(s)]
        if len(self.folds) < 2:
            return out
        for at in range(0, len(wanted), self.block):
            part = wanted[at: at + self.block]
            for i, scores in zip(part, self._score([subsets[i] for i in part])):
                out[i] = scores
        return out

    def _score(self, subsets: list[np.ndarray]) -> list[list[float]]:
        spec, folds = self.spec, self.folds
        grown: list[list[_Tree]] = [[] for _ in range(len(subsets) * len(folds))]
        for _ in range(spec.rounds):
            inner = (1 << spec.depth) - 1
            for trees in grown:
                trees.append(_Tree(np.zeros(inner, dtype=np.int64), np.full(inner, 255), np.zeros(1 << spec.depth)))
            for level in range(spec.depth):
                for r in self._splits(subsets, grown, level).collect():
                    tree, node = grown[r["t"]][-1], r["node"] + (1 << level) - 1
                    tree.column[node], tree.bin[node] = r["column"], r["bin"]
                    if level == spec.depth - 1:
                        tree.value[2 * r["node"]], tree.value[2 * r["node"] + 1] = r["first"], r["second"]
        scores = {r["t"]: r for r in self._errors(subsets, grown).collect()}
        return [[_r2(scores.get(c * len(folds) + f)) for f in range(len(folds))] for c in range(len(subsets))]

    def _splits(self, subsets, grown, level: int) -> DataFrame:
        """t, node, column, bin, first, second: the best split of each node of a level and the mean residuals on its sides."""
        spec, folds, width, bins = self.spec, self.folds, self.width, self.spec.bins + 1
        nodes = 1 << level

        def cells(batches):
            import pandas as pd

            n = [np.zeros(nodes * len(subsets[t // len(folds)]) * bins, dtype=np.int64) for t in range(len(grown))]
            s = [np.zeros_like(a) for a in n]
            for t, own, x, y in _rows(batches, subsets, folds, width, held_out=False):
                left = _units(y - _sum_of(grown[t][:-1], x, spec))
                node = grown[t][-1].place(x, level)
                k = len(own)
                cell = (((node * k)[:, None] + np.arange(k)) * bins + x).ravel()
                n[t] += np.bincount(cell, minlength=len(n[t]))
                s[t] += np.bincount(cell, weights=np.repeat(left, k), minlength=len(n[t])).astype(np.int64)
            held = [np.flatnonzero(a) for a in n]
            yield pd.DataFrame({"t": np.repeat(np.arange(len(n), dtype=np.int32), [len(h) for h in held]), "cell": np.concatenate(held),
                                "n": np.concatenate([a[h] for a, h in zip(n, held)]), "s": np.concatenate([a[h] for a, h in zip(s, held)])})

        def best(batches):
            import pandas as pd

            n: dict[int, np.ndarray] = {}
            s: dict[int, np.ndarray] = {}
            for pdf in batches:
                tree, cell = pdf["t"].to_numpy(), pdf["cell"].to_numpy()
                order = np.argsort(tree, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(tree[order])) + 1):
                    if len(part):
                        t = int(tree[part[0]])
                        if t not in n:
                            n[t], s[t] = (np.zeros(nodes * len(subsets[t // len(folds)]) * bins, dtype=np.int64) for _ in range(2))
                        np.add.at(n[t], cell[part], pdf["n"].to_numpy()[part])
                        np.add.at(s[t], cell[part], pdf["s"].to_numpy()[part])
            rows = [(t, *split) for t in sorted(n) for split in _best(n[t].reshape(nodes, -1, bins), s[t].reshape(nodes, -1, bins), spec.min_rows)]
            yield pd.DataFrame(rows, columns=["t", "node", "column", "bin", "first", "second"])

        # a task has combined its own cells; all cells of a tree then meet in one task, which holds their sums only
        partial = self.table.mapInPandas(cells, "t int, cell long, n long, s long").repartition("t")
        return partial.mapInPandas(best, "t int, node int, column int, bin int, first double, second double")

    def _errors(self, subsets, grown) -> DataFrame:
        """For each tree the held-out rows, their sum and sums of squares (two 32-bit parts) of target and residual."""
        spec, folds, width = self.spec, self.folds, self.width

        def run(batches):
            import pandas as pd

            got: dict[int, list[int]] = {}
            for t, _own, x, y in _rows(batches, subsets, folds, width, held_out=True):
                left, whole = _units(y - _sum_of(grown[t], x, spec)), _units(y)
                new = [len(y), int(whole.sum()), _squares(whole), _squares(left)]
                got[t] = [a + b for a, b in zip(got[t], new)] if t in got else new
            low = (1 << 32) - 1
            if got:
                yield pd.DataFrame([(t, n, s, yy >> 32, yy & low, ee >> 32, ee & low) for t, (n, s, yy, ee) in got.items()],
                                   columns=["t", "n", "s", "yy1", "yy0", "ee1", "ee0"])

        parts = self.table.mapInPandas(run, "t int, n long, s long, yy1 long, yy0 long, ee1 long, ee0 long")
        return parts.groupBy("t").agg(*[F.sum(c).alias(c) for c in ("n", "s", "yy1", "yy0", "ee1", "ee0")])


def _best(n: np.ndarray, s: np.ndarray, least: int):
    """node, column, bin and mean residuals on both sides of the best split of each node that has rows.

    ``n`` and ``s``: rows and residual units by node, column and bin.  Ties go to the
    first column and bin; without a split that helps, all rows go to the first side.
    """
    whole, total = n[:, :1, :].sum(axis=2, keepdims=True), s[:, :1, :].sum(axis=2, keepdims=True)
    n1, s1 = n.cumsum(axis=2), s.cumsum(axis=2)
    n2, s2 = whole - n1, total - s1
    f1, f2, ft = s1.astype(float), s2.astype(float), total.astype(float)
    gain = f1 * f1 / np.maximum(n1, 1) + f2 * f2 / np.maximum(n2, 1) - ft * ft / np.maximum(whole, 1)
    gain = np.where((n1 >= least) & (n2 >= least), gain, 0.0).reshape(len(n), -1)
    at = gain.argmax(axis=1)
    for node in np.flatnonzero(whole[:, 0, 0]):
        j, b = divmod(int(at[node]), n.shape[2])
        if gain[node, at[node]] > 0:
            yield int(node), j, b, s1[node, j, b] / n1[node, j, b] / UNITS, s2[node, j, b] / n2[node, j, b] / UNITS
        else:
            yield int(node), 0, 255, total[node, 0, 0] / whole[node, 0, 0] / UNITS, 0.0


def _rows(batches, subsets, folds, width: int, held_out: bool):
    """Tree number, columns, bins of these columns and target for every tree and batch: its training or its held-out rows."""
    for pdf in batches:
        if pdf.empty:
            continue
        x = np.frombuffer(b"".join(pdf["_bins"]), dtype=np.uint8).reshape(-1, width)
        y, fold = pdf["_y"].to_numpy(), pdf["fold"].to_numpy()
        keep = [np.flatnonzero((fold == f) == held_out) for f in folds]
        for c, own in enumerate(subsets):
            mine = x[:, own]
            for f, rows in enumerate(keep):
                if len(rows):
                    yield c * len(folds) + f, own, mine[rows], y[rows]


def _sum_of(trees: Sequence[_Tree], x: np.ndarray, spec: TreeSpec) -> np.ndarray:
    out = np.zeros(len(x))
    for tree in trees:
        out += spec.rate * tree.value[tree.place(x, spec.depth)]
    return out


def _units(v: np.ndarray) -> np.ndarray:
    return np.rint(v * UNITS).astype(np.int64)


def _squares(v: np.ndarray) -> int:
    """Exact sum of squares: parts of 2**16 values below 2**23 fit a 64-bit sum."""
    return sum(int(np.dot(part, part)) for part in np.array_split(v, len(v) // (1 << 16) + 1))


def _r2(r) -> float:
    """R2 from the whole-number sums of a held-out fold; a constant target gives 1 without errors, else 0."""
    if r is None:
        return float("nan")
    yy, ee = (r["yy1"] << 32) + r["yy0"], (r["ee1"] << 32) + r["ee0"]
    spread = yy * r["n"] - r["s"] ** 2  # n times the sum of squares around the mean
    if spread == 0:
        return 1.0 if ee == 0 else 0.0
    return 1.0 - ee * r["n"] / spread
