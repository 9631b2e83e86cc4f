"""Reproducible keyed randomness.

Every random draw is a pure function of (seed, purpose, key): the first 32 bits
of ``md5`` of the joined parts, mapped to (0, 1).  Results therefore do not
depend on partitioning, executor loss or task retries (unlike ``rand``,
``randn`` and ``randomSplit``), and DuckDB can recompute them:

    Spark : conv(substr(md5(k), 1, 8), 16, 10)
    DuckDB: ('0x' || substr(md5(k), 1, 8))::BIGINT
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(*parts: Column | str | int | float) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hash32(*parts: Column | str | int | float) -> Column:
    """Unsigned 32-bit hash as bigint."""
    return F.conv(F.substring(F.md5(_key(*parts)), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int | float) -> Column:
    """U(0,1), never exactly 0 or 1."""
    return (hash32(*parts) + F.lit(0.5)) / F.lit(TWO_32)


def normal(*parts: Column | str | int | float) -> Column:
    """N(0,1) by Box-Muller from two keyed uniforms."""
    u1 = uniform(*parts, "n1")
    u2 = uniform(*parts, "n2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def sql_uniform(key_sql: str) -> str:
    """DuckDB text of :func:`uniform` for a key expression already joined by '|'."""
    return f"((('0x' || substr(md5({key_sql}), 1, 8))::BIGINT + 0.5) / {TWO_32})"
