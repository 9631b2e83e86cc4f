"""Row numbers of a sorted table without a window over all of its rows.

The rows are dealt to ranges of the sort key, sorted there and written to the
shared folder with their place; a small table of counts per range and group then
gives each range its offset.  A group of any size is spread over many ranges, and
rows with equal keys are too, because their input place is the last sort column.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import ensure_checkpoint_dir

#: Offset rows that are broadcast; beyond it the offsets are joined by a shuffle.
BROADCAST_ROWS = 50_000


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: a lost executor costs at most the reading of a file."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_numbers(df: DataFrame, order: list[Column | str], within: list[str] | None = None, name: str = "row_number", total: str | None = None) -> DataFrame:
    """``df`` with the 0-based number of each row in ``order`` (ascending, nulls first), counted within groups if any are named.

    ``total`` names a column for the number of rows of the group.  Rows that are
    equal in ``order`` are numbered by their place in the input.  Null group
    values are a group.  An empty table gives no rows.
    """
    within = list(within or [])
    keys = [f"__group_{i}" for i in range(len(within))]
    cols = df.columns
    marked = df.select("*", *[q(w).alias(k) for w, k in zip(within, keys)], *[_column(o).alias(f"__order_{i}") for i, o in enumerate(order)], F.monotonically_increasing_id().alias("__tie"))
    by = [*keys, *[f"__order_{i}" for i in range(len(order))], "__tie"]
    placed = written(marked.repartitionByRange(*by).sortWithinPartitions(*by).select(*[q(c) for c in cols], *keys, F.monotonically_increasing_id().alias("__place")))
    part = F.shiftright("__place", 33).alias("__part")
    counts = placed.groupBy(*keys, part).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of a group
    offsets = counts.select(
        *[F.col(k).alias(f"{k}_") for k in keys], F.col("__part").alias("__part_"), "__first",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
    )
    offsets = written(offsets)
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = placed.withColumn("__part", part)
    match = F.col("__part") == F.col("__part_")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}_"))
    number = (F.col("__place") - F.col("__first") + F.col("__offset")).cast("long").alias(name)
    return placed.join(offsets, match).select(*[q(c) for c in cols], number, *([F.col("__total").cast("long").alias(total)] if total else []))


def _column(c: Column | str) -> Column:
    return q(c) if isinstance(c, str) else c


#: Rows of a group that a window sees at a time.
CHUNK_ROWS = 1 << 16


def chunked(df: DataFrame, order: Column | str, by: list[str], halo: int, chunk_rows: int | None = None):
    """(rows, window, own): ``df`` cut into runs of ``chunk_rows`` consecutive rows of a group for window functions.

    Each run starts with the last ``halo`` rows of the run before, so a frame that
    reaches back that far is whole; ``own`` keeps a row's result in its own run.
    Rows carry ``__n`` (number in the group) and ``__total``.  Neither a large
    group nor the whole table (no groups) is one task.
    """
    by = list(by)
    size = max(chunk_rows or CHUNK_ROWS, halo, 1)
    rows = row_numbers(df, [order], within=by, name="__n", total="__total")
    at = F.floor(F.col("__n") / size).cast("long")
    runs = F.when(F.col("__n") % size >= size - halo, F.array(at, at + 1)).otherwise(F.array(at)) if halo else F.array(at)
    rows = rows.withColumn("__run", F.explode(runs))
    return rows, Window.partitionBy(*[q(c) for c in by], "__run").orderBy("__n"), F.col("__run") == at
