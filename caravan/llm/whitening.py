"""Whitening of embeddings: covariance by merged partial moments, eigenvectors on the driver, a second pass that verifies.

Each partition reduces its vectors to a count, exact sums, a local mean and the scatter around that mean; pairs of such moments are
merged by Chan's formula in a tree. What reaches the driver is one moment of d x d numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravan.llm.shared import attach

#: Fixed-point entries are held within this bound.
LIMIT = 1 << 45
#: Vectors of a block whose moments are taken at once.
BLOCK = 4096


def fixed_point(df: DataFrame, column: str, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """df with column, an array of floats, as array<long>: floor(scale * entry) + offset.

    Rows whose vector is null or empty or holds a null or non-finite entry are dropped, and so are rows whose vector isn't of the
    most frequent length (the shortest of equally frequent ones). Products beyond 2^45 are taken as 2^45, with their sign.
    """
    entries = F.col(column).cast("array<double>")
    fine = df.where(F.size(entries) > 0).where(~F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    lengths = fine.groupBy(F.size(entries).alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = lengths["d"] if lengths else 0
    held = lambda c: F.least(F.greatest(F.lit(scale) * c, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))
    return fine.where(F.size(entries) == dims).withColumn(column, F.transform(entries, lambda c: F.floor(held(c)).cast("long") + F.lit(offset)))


@dataclass
class Moments:
    """Of a set of vectors: count, exact sums if they are integers, mean, and scatter around the mean."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        n = len(x)
        if x.dtype == np.int64:
            sums = [int(s) for s in x.sum(axis=0)]
            mean = np.array([s / n for s in sums])
            base = np.array([s // n for s in sums], np.int64)  # exact differences first, so that large offsets cost no digits
            centred = (x - base) - (mean - base)
        else:
            sums, mean = None, x.mean(axis=0)
            centred = x - mean
        return cls(n, sums, mean, centred.T @ centred)


def merged(a: Moments | None, b: Moments | None) -> Moments | None:
    """Chan's pairwise formula."""
    if a is None or b is None:
        return b if a is None else a
    n = a.n + b.n
    sums = [x + y for x, y in zip(a.sums, b.sums, strict=True)] if a.sums is not None else None
    delta = b.mean - a.mean
    mean = np.array([s / n for s in sums]) if sums else a.mean + delta * (b.n / n)
    return Moments(n, sums, mean, a.scatter + b.scatter + np.outer(delta, delta) * (a.n * (b.n / n)))


def _matrix(column: pa.ListArray, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), len(flat) // len(column))


def _partial(dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                total = merged(total, Moments.of(_matrix(batch.column(0).slice(i, BLOCK), dtype)))
        if total is not None:
            sums = [str(s) for s in total.sums] if total.sums else None
            row = {"n": total.n, "sums": sums, "mean": total.mean.tobytes(), "scatter": total.scatter.tobytes()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.binary()), ("scatter", pa.binary())]))

    return run


def _read(row) -> Moments:
    mean = np.frombuffer(row.mean)
    return Moments(row.n, [int(s) for s in row.sums] if row.sums is not None else None, mean, np.frombuffer(row.scatter).reshape(len(mean), len(mean)))


def moments(df: DataFrame, column: str) -> Moments | None:
    """Moments of all vectors of a column of array<long> or array<double>; None without rows."""
    attach(df.sparkSession)
    dtype = np.int64 if df.schema[column].dataType.elementType.simpleString() == "bigint" else np.float64
    parts = df.select(column).mapInArrow(_partial(dtype), "n long, sums array<string>, mean binary, scatter binary")
    return parts.rdd.map(_read).treeAggregate(None, merged, merged)


@dataclass
class Whitening:
    """n and sums of the fit list; components by falling eigenvalue: eigenvalues, unit vectors as columns, shares of the variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def fit_whitening(df: DataFrame, column: str, components: int | None = None) -> Whitening:
    """Principal components of all vectors of df, at most so many. column: array<long> as fixed_point() gives it.

    A component whose eigenvalue can't be told from 0 in double precision has no whitened form and is left out, so fewer vectors
    than dimensions, equal vectors or a single one give fewer components or none. The largest entry of each vector is positive.
    """
    total = moments(df, column)
    if total is None:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    values, vectors = np.linalg.eigh(total.scatter / total.n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(total.scatter)) / total.n
    kept = np.flatnonzero(values > len(values) * np.finfo(float).eps * max(values[0], 0.0))[:components]
    vectors = vectors[:, kept]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))]) if len(kept) else vectors
    return Whitening(total.n, total.sums, values[kept], vectors, values[kept] / trace if len(kept) else values[kept])


def _deviations(model: Whitening, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """n * x - S in doubles, and the sums of their squares exactly; None where a sum doesn't fit in a long."""
    sums = np.array(model.sums, object)
    low, high = int(x.min()), int(x.max())
    reach = max(abs(model.n * v - s) for v in (low, high) for s in (min(model.sums), max(model.sums)))
    if reach * reach * len(sums) < 1 << 63 and model.n * max(abs(low), abs(high)) < 1 << 62 and max(map(abs, model.sums)) < 1 << 62:
        d = model.n * x - sums.astype(np.int64)
        return d.astype(np.float64), (d * d).sum(axis=1).tolist()
    d = model.n * x.astype(object) - sums
    exact = (d * d).sum(axis=1).tolist()
    return d.astype(np.float64), [v if v < 1 << 63 else None for v in exact]


def _project(broadcast, width: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        scaled = model.vectors / np.sqrt(model.values)
        k = scaled.shape[1]
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                d, deviation = _deviations(model, _matrix(part.column(at), np.int64))
                white = (d / model.n) @ scaled
                listed = pa.ListArray.from_arrays(np.arange(0, len(white) * k + 1, k, dtype=np.int32) if k else np.zeros(len(white) + 1, np.int32), white.ravel())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(width)), pa.array(deviation, pa.int64()), listed], [*part.schema.names[:width], "deviation", "whitened"])

    return run


def whiten(df: DataFrame, column: str, model: Whitening) -> DataFrame:
    """df with (deviation long: sum over dimensions of (n * x - S)^2, null beyond a long; whitened array<double>: a number for each
    component of the model). Keeps every row and all columns but former ones of these names. column: vectors as the model's."""
    attach(df.sparkSession)
    df = df.drop("deviation", "whitened")
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(_project(shared, len(df.columns), df.columns.index(column)), f"{fields}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, column: str = "whitened") -> float:
    """The largest absolute entry of the covariance of all whitened vectors minus the identity; 0 without rows or components."""
    total = moments(whitened, column)
    if total is None or not len(total.mean):
        return 0.0
    return float(np.abs(total.scatter / total.n - np.eye(len(total.mean))).max())


def whiten_embeddings(vectors: DataFrame, column: str = "embedding", components: int = 32) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> a row for each vector and component: (vec_id, component from 1, n, deviation, whitened,
    explained: the component's share of the variance, identity_error: of all whitened vectors).

    Null, empty, ragged and non-finite vectors are dropped, see fixed_point(). Rows that repeat a vec_id, or have none, count and
    return as they are; an empty table, or vectors that are all equal, give an empty result. Other columns are left aside, so their
    names can't clash.
    """
    spark = vectors.sparkSession
    rows = fixed_point(vectors.select("vec_id", F.col(column).alias("x")), "x")
    model = fit_whitening(rows, "x", components)
    white = whiten(rows, "x", model) if model.n else rows.withColumns({"deviation": F.lit(None).cast("long"), "whitened": F.array().cast("array<double>")})
    error = identity_error(white.select("whitened"))
    shares = spark.createDataFrame([(i + 1, float(e)) for i, e in enumerate(model.explained)], "component int, explained double")
    long = white.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("component", "whitened")).withColumn("component", F.col("component") + 1)
    return long.join(F.broadcast(shares), "component").select("vec_id", "component", "n", "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
