"""Shared plumbing: intermediate tables, Arrow slices, size-checked joins."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store

#: Text bytes handled at once by the vectorised kernels; bounds a worker's memory (Spark bounds Arrow batches by bytes).
SLICE_BYTES = 1 << 20
#: Ids that may be broadcast (8 bytes each on the wire, about 40 MB as a hash table).
BROADCAST_IDS = 400_000
#: Settings while a table is written: shuffle files go at the query's end.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Bytes of an Arrow batch, of which a task holds several copies in the JVM and the worker.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def bounded(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, the same for all operators, unless it has a bound of its own.

    The setting is read when a query runs, which may be long after an operator
    returned it, so it can't be put back.
    """
    key, size = BATCH_BYTES
    if spark.conf.get(key).removesuffix("b") == str(64 << 20):  # as Spark sets it
        spark.conf.set(key, str(size))


class Scratch:
    """The tables written within a ``with scratch()`` block."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def keep(self, *tables: DataFrame) -> None:
        """Spare these: what the block returns still reads them."""
        self.kept += tables


_open: list[Scratch] = []


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Delete the tables written in the block at its end, but those kept, which pass to an enclosing block."""
    own = Scratch()
    _open.append(own)
    try:
        yield own
    finally:
        _open.remove(own)
        kept = {id(t) for t in own.kept}
        for t in own.tables:
            if id(t) not in kept:
                drop_table(t)
            elif _open:
                _open[-1].tables.append(t)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the rereading of files.
    Shuffle files of the write go once it has ended, as nothing refers to them;
    the table itself goes with the :func:`scratch` block around, or when the
    driver ends.
    """
    spark = df.sparkSession
    bounded(spark)
    path = store.new_dir(spark, tag)
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.corvane_path = path
    if _open:
        _open[-1].tables.append(out)
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that nothing reads any more."""
    if getattr(df, "corvane_path", None):
        store.delete(df.sparkSession, df.corvane_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(docs: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join on ``key``; ids are broadcast only if their count is within bound.

    ``ids`` must be cheap to read twice (a written table).
    """
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, key, how)


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        at = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += size
        yield batch.slice(at, n - at)

