"""What the operators of this subpackage share: the shared folder, written steps and batch handling."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravan.session import importable, work_dir

#: Spark's usual batches of 64 MB take a Python worker and its task several times that; (setting, usual value, ours).
ARROW = [("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000")]
#: Shuffle files of a finished step are of no use once its table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def attach(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches small where the caller has not chosen a size."""
    importable(spark)
    for key, usual, value in ARROW:
        if spark.conf.get(key) == usual:
            spark.conf.set(key, value)


@contextmanager
def held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session, for what runs inside alone."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, label: str, path: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet, with the writer's options, to the shared folder, or to path, and read it again: later steps survive lost
    executors.

    The shuffle files of the step go when it is written; discard() removes the table itself.
    """
    spark = df.sparkSession
    path = path or work_dir(spark, label)
    with held(spark, CLEANUP, "true"):
        df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*steps: DataFrame) -> None:
    """Remove tables of materialize() that nothing reads any more: what was made of them is written, too."""
    for step in steps:
        fs, path = storage(step.written_to)
        fs.delete_dir(path)


def storage(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI or of a plain local path."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri):
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def commit_file(fs: pyarrow.fs.FileSystem, temporary: str, final: str) -> None:
    """Rename a finished temporary file; a repeated attempt replaces equal bytes by equal bytes."""
    fs.move(temporary, final)


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive rows whose sizes sum to at most limit, one row at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = 2_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of about limit bytes of text."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        for i, j in slices(sizes, limit):
            yield batch.slice(i, j - i)


#: Bytes up to which, measured, a side of a join is broadcast.
BROADCAST = 16_000_000


def small(df: DataFrame, size: int) -> DataFrame:
    """df with a broadcast hint where its measured size allows it; a join shuffles otherwise."""
    return F.broadcast(df) if size <= BROADCAST else df


#: Parts of a key's rows in a salted join.
WAYS = 2


def salted_join(rows: DataFrame, once: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with once(key, ...), which an aggregation by key made: one row a key at most.

    A plain join would reuse the aggregation's partitioning, and adaptive execution splits a hot key's rows only where both sides
    are shuffled for the join. Dealing the rows of each key to WAYS parts by a hash of by has that effect.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(WAYS)).cast("int"))
    copies = once.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1)))).hint("merge")
    return salted.join(copies, [key, "_salt"]).drop("_salt")
