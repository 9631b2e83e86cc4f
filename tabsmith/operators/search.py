"""Genetic feature-subset search and its run statistics.

The data work is one grouped Gram pass (per-fold sufficient statistics of
every column); each candidate's fitness (mean k-fold R2 of a linear model on
its columns, floored at 0) is then k-by-k algebra, memoised per subset.  The
population bookkeeping (30 x p bits) is the only driver state.

``score_candidates`` scores a candidates DataFrame on the executors
(``mapInPandas`` with the Gram matrices shipped once as a broadcast), for
populations too large for the driver loop.

The statistics operators (J4-J8, plus M4-M7) accept any table with an
order column and optional group keys, so the run history is just one input.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear
from .ordering import chunked
from .sums import gram

# Fixed values from the reference configuration.
POPULATION = 30
GENERATIONS = 100
MUTATION_RATE = 0.15
CROSSOVER_RATE = 0.85
ELITE = 6
TOURNAMENT = 3
TARGET_FEATURES = 6
FOLDS = 5
STOP_WINDOW = 20
STOP_VARIANCE = 1e-6


def fold_grams(df: DataFrame, features: Sequence[str], target: str, fold: str = "fold") -> dict:
    g, _ = gram(df, list(features) + [target], group=fold)
    return g


def fitness(folds: dict, subset: Sequence[int], spec: linear.LinearSpec = linear.LINEAR_SUITE[0]) -> float:
    """Mean fold R2 of the subset (0-based feature positions), floored at 0."""
    if len(subset) == 0:
        return 0.0
    try:
        s = linear.cv_scores(folds, [i + 1 for i in subset], spec)
        v = float(np.mean(s))
        return max(0.0, v) if np.isfinite(v) else 0.0
    except np.linalg.LinAlgError:
        return 0.0


def score_candidates(candidates: DataFrame, folds: dict, spec: linear.LinearSpec = linear.LINEAR_SUITE[0],
                     bits: str = "bits", out: str = "fitness") -> DataFrame:
    """J2 on executors: ``candidates`` has an ``array<boolean>`` column of feature flags."""
    sc = candidates.sparkSession.sparkContext
    bc = sc.broadcast({k: v for k, v in folds.items()})

    def run(batches):
        g = bc.value
        for pdf in batches:
            pdf[out] = [fitness(g, [i for i, b in enumerate(row) if b], spec) for row in pdf[bits]]
            yield pdf

    schema = T.StructType([*candidates.schema.fields, T.StructField(out, T.DoubleType())])
    return candidates.mapInPandas(run, schema)


def exactly(k: int, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rows of ``bits`` with exactly k set bits: set bits come first, random keys decide among equals."""
    first = np.argsort(-(bits + keys), axis=1, kind="stable")[:, :k]
    out = np.zeros(bits.shape, dtype=bool)
    np.put_along_axis(out, first, True, axis=1)
    return out


class GeneticSelector:
    """Search for the best k columns with one boolean matrix (members x columns) per generation.

    Each step treats the whole matrix: tournament winners by an argmax over drawn
    member numbers, uniform crossover by a mask, a mutation that swaps one set and
    one unset bit, and ``exactly`` to restore the count.  The scorer gets the
    distinct new subsets of a generation and returns their fitness.
    """

    def __init__(self, k: int = TARGET_FEATURES, population: int = POPULATION, generations: int = GENERATIONS,
                 mutation_rate: float = MUTATION_RATE, crossover_rate: float = CROSSOVER_RATE, elite: int = ELITE,
                 tournament: int = TOURNAMENT, seed: int = 42, spec: linear.LinearSpec = linear.LINEAR_SUITE[0]):
        self.k, self.size, self.generations = k, population, generations
        self.mutation_rate, self.crossover_rate = mutation_rate, crossover_rate
        self.elite, self.tournament, self.spec = elite, tournament, spec
        self.rng = np.random.default_rng(seed)
        self.history: list[dict] = []
        self.population_log: list[tuple[int, int, list[bool], float]] = []

    def _children(self, members: np.ndarray, fit: np.ndarray) -> np.ndarray:
        """The next generation without its elite: selected, crossed, repaired and mutated."""
        rng, n, p = self.rng, self.size - self.elite, members.shape[1]
        pairs = (n + 1) // 2
        drawn = np.argsort(rng.random((2 * pairs, len(members))), axis=1)[:, : self.tournament]
        winners = members[drawn[np.arange(2 * pairs), fit[drawn].argmax(axis=1)]]
        one, two = winners[:pairs], winners[pairs:]
        mixed = (rng.random((pairs, p)) < 0.5) & (rng.random((pairs, 1)) < self.crossover_rate)
        out = np.concatenate([np.where(mixed, two, one), np.where(mixed, one, two)])[:n]
        out = exactly(self.k, out, rng.random(out.shape))
        keys = rng.random(out.shape)
        swapped = (rng.random(n) < self.mutation_rate) & (self.k < p)
        rows = np.flatnonzero(swapped)
        lost, gained = np.where(out, keys, -1).argmax(axis=1), np.where(out, -1, keys).argmax(axis=1)
        out[rows, lost[rows]] = False
        out[rows, gained[rows]] = True
        return out

    def search(self, score, n_features: int) -> GeneticSelector:
        """``score``: function from a boolean matrix of different subsets to their fitness."""
        if n_features < self.k:
            raise ValueError(f"{n_features} features < target {self.k}")
        known: dict[bytes, float] = {}
        members = exactly(self.k, np.zeros((self.size, n_features), dtype=bool), self.rng.random((self.size, n_features)))
        top: list[float] = []
        self.best_fitness_ = -np.inf
        for g in range(self.generations):
            names = [row.tobytes() for row in members]
            fresh = {name: i for i, name in enumerate(names) if name not in known}
            if fresh:
                known.update(zip(fresh, score(members[list(fresh.values())])))
            fit = np.array([known[name] for name in names])
            top.append(float(fit.max()))
            if top[-1] > self.best_fitness_:
                self.best_fitness_ = top[-1]
                self.selected_ = np.flatnonzero(members[fit.argmax()]).tolist()
            self.population_log += [(g, j, row.tolist(), float(f)) for j, (row, f) in enumerate(zip(members, fit))]
            self.history.append({"generation": g, "mean_fitness": float(fit.mean()), "best_fitness": top[-1],
                                 "worst_fitness": float(fit.min()), "std_fitness": float(fit.std()),
                                 "diversity": diversity_np(members), "selection_pressure": pressure_np(fit)})
            if len(top) >= STOP_WINDOW and np.var(top[-STOP_WINDOW:]) < STOP_VARIANCE:
                break
            kept = members[np.argsort(fit, kind="stable")[-self.elite:]]
            members = np.concatenate([kept, self._children(members, fit)])
        return self

    def fit(self, folds: dict, n_features: int, spark=None) -> GeneticSelector:
        """Search with the linear scorer on fold sums; with a session, a generation is scored on the executors."""
        if spark is None:
            return self.search(lambda m: [fitness(folds, np.flatnonzero(row).tolist(), self.spec) for row in m], n_features)

        def score(m):
            rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "i int, bits array<boolean>")
            return [r["fitness"] for r in score_candidates(rows, folds, self.spec).orderBy("i").collect()]

        return self.search(score, n_features)

    def history_df(self, spark) -> DataFrame:
        cols = ["generation", "mean_fitness", "best_fitness", "worst_fitness", "std_fitness", "diversity", "selection_pressure"]
        return spark.createDataFrame([tuple(h[c] for c in cols) for h in self.history],
                                     "generation int, mean_fitness double, best_fitness double, worst_fitness double, "
                                     "std_fitness double, diversity double, selection_pressure double")

    def population_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.population_log, "generation int, member int, bits array<boolean>, fitness double")


def diversity_np(popn: np.ndarray) -> float:
    n = len(popn)
    if n <= 1:
        return 0.0
    c = popn.sum(axis=0).astype(float)
    return float((c * (n - c)).sum() / (n * (n - 1) / 2))


def pressure_np(fit: np.ndarray) -> float:
    if len(fit) <= 1:
        return 0.0
    m = fit.mean()
    if m == 0:
        return float("inf") if fit.max() > 0 else 0.0
    return float(fit.max() / m)


# ------------------------------------------------------------ distributed statistics
def diversity(df: DataFrame, bits: str = "bits", by: Sequence[str] = ()) -> DataFrame:
    """Mean pairwise Hamming distance per group, closed form in one pass:
    sum_j c_j (n - c_j) / (n (n-1) / 2), with c_j the count of set bit j."""
    width = df.select(F.max(F.size(bits))).first()[0] or 0
    sums = [F.sum(F.col(bits)[j].cast("long")).alias(f"c{j}") for j in range(width)]
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)
    n = F.col("n").cast("double")
    total = sum((F.col(f"c{j}") * (n - F.col(f"c{j}")) for j in range(width)), F.lit(0.0))
    return g.select(*by, F.col("n"), F.when(n > 1, total / (n * (n - 1) / 2)).otherwise(F.lit(0.0)).alias("diversity"))


def selection_pressure(df: DataFrame, score: str = "fitness", by: Sequence[str] = ()) -> DataFrame:
    """Max / mean per group (inf if mean 0 and max > 0; 0 if n <= 1)."""
    g = df.groupBy(*by).agg(F.max(score).alias("mx"), F.avg(score).alias("mn"), F.count(F.lit(1)).alias("n"))
    sp = (F.when(F.col("n") <= 1, F.lit(0.0))
          .when(F.col("mn") == 0, F.when(F.col("mx") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
          .otherwise(F.col("mx") / F.col("mn")))
    return g.select(*by, sp.alias("selection_pressure"))


def generation_stats(df: DataFrame, score: str = "fitness", gen: str = "generation", bits: str = "bits") -> DataFrame:
    """Per generation mean, best, worst, std (ddof 0), diversity, pressure."""
    s = df.groupBy(gen).agg(F.avg(score).alias("mean_fitness"), F.max(score).alias("best_fitness"),
                           F.min(score).alias("worst_fitness"), F.stddev_pop(score).alias("std_fitness"))
    d = diversity(df, bits, by=[gen]).drop("n")
    p = selection_pressure(df, score, by=[gen])
    return s.join(d, gen).join(p, gen)


def step_changes(df: DataFrame, value: str, order: str, by: Sequence[str] = (), chunk_rows: int | None = None) -> DataFrame:
    """M5: value - previous value along ``order`` (NULL on the first row of a group)."""
    rows, w, own = chunked(df, order, by, 1, chunk_rows)
    return rows.withColumn("step", F.col(value) - F.lag(value).over(w)).where(own).select(*df.columns, "step")


def convergence_metrics(df: DataFrame, value: str, order: str, by: Sequence[str] = (), chunk_rows: int | None = None) -> DataFrame:
    """Mean of the steps between the last ``max(1, n // 10)`` values (0 when there is no step), std (ddof 0)
    of the last ``max(1, n // 5)`` values, share of positive steps; zeros for groups of fewer than two rows."""
    rows, w, own = chunked(df, order, by, 1, chunk_rows)
    x = rows.withColumn("_step", F.col(value) - F.lag(value).over(w)).where(own)
    rn, n = F.col("__n") + 1, F.col("__total")
    tenth = F.greatest(F.floor(n / 10), F.lit(1))
    fifth = F.greatest(F.floor(n / 5), F.lit(1))
    # a step needs both of its values among the last ones
    recent = F.avg(F.when(rn > n - tenth + 1, F.col("_step")))
    spread = F.stddev_pop(F.when(rn > n - fifth, F.col(value)))
    share = F.try_divide(F.sum((F.col("_step") > 0).cast("double")), F.count("_step").cast("double"))
    few = F.count(F.lit(1)) < 2
    return x.groupBy(*by).agg(
        F.when(few, 0.0).otherwise(F.coalesce(recent, F.lit(0.0))).alias("recent_improvement"),
        F.when(few, 0.0).otherwise(spread).alias("recent_std"),
        F.when(few, 0.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("improvement_ratio"),
    )


def trailing_variance(df: DataFrame, value: str, order: str, window: int = STOP_WINDOW, by: Sequence[str] = (),
                      threshold: float = STOP_VARIANCE, chunk_rows: int | None = None) -> DataFrame:
    """Population variance of the last ``window`` values (NULL until full) and the stop flag."""
    rows, w, own = chunked(df, order, by, window - 1, chunk_rows)
    frame = w.rowsBetween(-(window - 1), 0)
    var = F.when(F.count(F.col(value)).over(frame) >= window, F.var_pop(F.col(value)).over(frame))
    out = rows.withColumn("trailing_var", var).where(own).select(*df.columns, "trailing_var")
    return out.withColumn("converged", F.coalesce(F.col("trailing_var") < threshold, F.lit(False)))


def rolling_mean(df: DataFrame, value: str, order: str, window: int, by: Sequence[str] = (), chunk_rows: int | None = None) -> DataFrame:
    """M4: mean of the last ``window`` values, NULL until the window is full."""
    rows, w, own = chunked(df, order, by, window - 1, chunk_rows)
    w = w.rowsBetween(-(window - 1), 0)
    mean = F.when(F.count(F.col(value)).over(w) >= window, F.avg(value).over(w))
    return rows.withColumn("rolling_mean", mean).where(own).select(*df.columns, "rolling_mean")


#: Largest window of a moving average, and the part of a series that it may take: fixed values.
MOVING_MOST, MOVING_PART = 10, 4


def moving_average(df: DataFrame, value: str, order: str, by: Sequence[str] = (), chunk_rows: int | None = None) -> DataFrame:
    """M4 as charted: the window of a series of n rows is min(10, n // 4); a series whose window is 1 or less has no average.

    NULL until the window is full and where one of its values is missing.
    """
    rows, w, own = chunked(df, order, by, MOVING_MOST - 1, chunk_rows)
    size = F.least(F.lit(MOVING_MOST), F.floor(F.col("__total") / MOVING_PART)).cast("int")
    seen = F.collect_list(F.struct(F.col(value).cast("double").alias("v"))).over(w.rowsBetween(-(MOVING_MOST - 1), 0))
    rows = rows.withColumn("window", size).withColumn("__seen", seen).where(own)
    last = F.expr("slice(__seen, -`window`, `window`)")
    mean = F.aggregate(last, F.lit(0.0), lambda a, x: a + x["v"]) / F.col("window")
    full = (F.col("window") > 1) & (F.col("__n") + 1 >= F.col("window"))
    return rows.withColumn("moving_average", F.when(full, mean)).select(*df.columns, "window", "moving_average")
