"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


#: (table, folder) of what ``stored`` wrote, a list for each open ``scratch``.
_OPEN: ContextVar[tuple[list[tuple[DataFrame, str]], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``stored`` writes inside are deleted at the end.

    The value is a function that stores a table, if it is not yet, and hands it on to
    the surrounding ``scratch``; without one it stays.  Whatever is read after the end
    has to be handed on.  Around an operator and the writing of its result it leaves
    nothing behind.  The driver's garbage is collected too, so that Spark removes the
    shuffle files of plans that nothing refers to any more.
    """
    outer, own = _OPEN.get(), []
    token = _OPEN.set((*outer, own))

    def hand_on(df: DataFrame) -> DataFrame:
        if all(known is not df for known, _ in own):
            df = stored(df)
        at = next(i for i, (known, _) in enumerate(own) if known is df)
        entry = own.pop(at)
        if outer:
            outer[-1].append(entry)
        return df

    try:
        yield hand_on
    finally:
        _OPEN.reset(token)
        for _, folder in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        own.clear()
        spark._jvm.System.gc()


def stored(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` written to a Parquet table in the shared checkpoint folder and read again.

    Cuts the lineage: a lost executor costs at most the reading of a file.  The
    folder lasts until the innermost open ``scratch`` ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if _OPEN.get():
        _OPEN.get()[-1].append((table, path))
    return table


BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(df: DataFrame) -> None:
    """Bounds the Arrow batches that Python workers get by bytes, unless the session has its own bound.

    The default bounds rows only, and ten thousand long texts do not fit a worker.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not use (Spark compares names without case)."""
    used = {c.lower() for c in df.columns}
    name = wish
    while name.lower() in used:
        name += "_"
    return name


def most_frequent(counted: DataFrame, limit: int, count: str = "n") -> DataFrame:
    """Rows of ``counted`` with the largest counts, at most ``limit`` of them, without a sort.

    Counts are put in classes of about 6 % each; the classes that fit as a whole
    are taken, so the choice does not depend on the order of the rows.
    """
    counted = stored(counted)
    cls = F.floor(F.log2(F.col(count)) * 12).cast("int")
    left, cut = limit, None
    for r in counted.groupBy(cls.alias("c")).count().orderBy(F.desc("c")).collect():  # at most 12 * 63 classes
        left -= r["count"]
        if left < 0:
            break
        cut = r["c"]
    return counted.where(F.lit(False) if cut is None else cls >= cut)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of text in the table: one narrow aggregate over all rows."""
    return int(df.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n")).first()["n"] or 0)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")

