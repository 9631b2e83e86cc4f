"""Column helpers: quoting, numeric discovery, NaN/NULL normalisation.

Column names in the sample tables carry spaces, ``%``, ``(`` and full-width
characters, so every reference goes through :func:`q` (back-tick quoting)
and names are never trimmed.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)


def q(name: str) -> Column:
    """Column reference that survives any character in ``name``."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of numeric fields in schema order, minus ``exclude`` (B1)."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in skip
    ]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def clean(c: Column | str) -> Column:
    """Double with NaN turned into NULL: both count as missing."""
    col = q(c) if isinstance(c, str) else c
    d = col.cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def with_clean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace ``cols`` by their cleaned double versions, keep the rest."""
    wanted = set(cols)
    return df.select(
        *[clean(f.name).alias(f.name) if f.name in wanted else q(f.name) for f in df.schema.fields]
    )


def require_columns(df: DataFrame, cols: Iterable[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def explode_structs(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One-row ``agg`` of struct columns -> long table, one row per struct.

    Keeps the report inside Spark (no collect) and costs one job.
    """
    return df.agg(F.array(*structs).alias("_rows")).select(F.explode("_rows").alias("_r")).select("_r.*")


def melt(df: DataFrame, cols: Sequence[str], value=clean) -> DataFrame:
    """Long (k int, v) form of ``cols``: one Expand per row, no shuffle.

    Per-column statistics are then a ``groupBy("k")`` whose partial aggregate
    has one buffer per column, which keeps the generated code small however
    many columns there are (one aggregate per column and statistic does not).
    """
    cols = list(cols)
    wide = df.select(*[value(c).alias(f"_{i}") for i, c in enumerate(cols)])
    long = wide.unpivot([], [f"_{i}" for i in range(len(cols))], "k", "v")
    return long.select(F.substring("k", 2, 12).cast("int").alias("k"), "v")


def name_of(cols: Sequence[str], k: Column | str = "k") -> Column:
    """Column name for an index column produced by :func:`melt`."""
    idx = F.col(k) if isinstance(k, str) else k
    return F.element_at(F.array(*[F.lit(c) for c in cols]), idx + 1)
