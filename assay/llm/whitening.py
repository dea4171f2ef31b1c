"""Whitening of embeddings by the eigenvectors of their covariance.

Sums of the scaled integers are exact, so rows are centred exactly: ``n * x - S`` is an
integer, divided by ``n`` once.  MLlib's RowMatrix sums the products of the centred rows
over the cluster; divided by ``n`` this is the covariance, whose size is the dimension's
alone.  It is decomposed locally, and rows are projected with the broadcast vectors.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .topk import scaled

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Sums are taken of the parts above and below this bit, so no table is long enough to overflow them.
HALF = 26


def _flat(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def sums(vectors: DataFrame, dims: int) -> list[int]:
    """Exact sum of each component of the ``dims`` long integers in ``x``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _flat(batch.column("x"), dims)
            high += (x >> HALF).sum(axis=0)
            low += (x & ((1 << HALF) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dims), pa.int32()), "high": high, "low": low})

    parts = vectors.select("x").mapInArrow(add, "i int, high long, low long")
    found = parts.groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # a row per dimension
    return [(r["high"] << HALF) + r["low"] for r in sorted(found, key=lambda r: r["i"])]


def gram(rows: DataFrame, column: Column) -> np.ndarray:
    """Sum of the outer products of the vectors in ``column`` (arrays of doubles)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def centred(total: list[int], n: int) -> Column:
    """(n * x - S) / n of each component: with S = q * n + r this is ((x - q) * n - r) / n,
    whose numerator is exact as long as the spread of x times n fits a long."""
    q, r = F.array(*[F.lit(s // n).cast("long") for s in total]), F.array(*[F.lit(s % n).cast("long") for s in total])
    exact = F.lit(2**62 // n)  # beyond it the remainder is less than the last bit of the quotient

    def quotient(y: Column, b: Column) -> Column:
        return F.when(F.abs(y) < exact, (y * F.lit(n) - b).cast("double") / F.lit(float(n))).otherwise(y.cast("double"))

    return F.zip_with(F.zip_with("x", q, lambda x, a: x - a), r, quotient)


def directions(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors as columns, eigenvalues, share of the trace) of the ``k`` largest eigenvalues.

    The sign of a vector is that of its largest entry.  Eigenvalues that rounding can't tell
    from zero are zero.
    """
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    trace = float(np.trace(covariance))
    values = np.where(values > len(covariance) * np.finfo(float).eps * max(trace, 0.0), values, 0.0)
    largest = np.abs(vectors).argmax(axis=0)
    return vectors * np.sign(vectors[largest, range(vectors.shape[1])]), values, values / trace if trace > 0 else np.zeros(len(values))


def project(vectors: DataFrame, total: list[int], n: int, axes: np.ndarray) -> DataFrame:
    """vec_id, deviation (decimal) and w: each centred row times the broadcast ``axes``."""
    dims, k = axes.shape
    sent = vectors.sparkSession.sparkContext.broadcast((np.array([s // n for s in total]), np.array([s % n for s in total]), axes))
    cast = pa.decimal128(38, 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, r, axes = sent.value
        for batch in batches:
            x = _flat(batch.column("x"), dims) - q
            if len(x) == 0:
                continue
            largest = max(int(np.abs(x).max()), 1) * n + n
            wide = largest**2 * dims >= 2**63  # beyond a long: Python's integers
            y = (x.astype(object) if wide else x) * n - r
            squares = (y * y).sum(axis=1)
            if wide:
                with decimal.localcontext(prec=200):
                    deviation = pa.array([decimal.Decimal(int(s)) if s < 10**38 else None for s in squares], cast)
            else:
                deviation = pa.array(squares, pa.int64()).cast(cast)
            w = (y.astype(np.float64) / n) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, lists], ["vec_id", "deviation", "w"])

    return vectors.select("vec_id", "x").mapInArrow(work, "vec_id long, deviation decimal(38,0), w array<double>")


def identity_error(rows: DataFrame, n: int, live: int) -> float:
    """Largest entry of |covariance of the first ``live`` components of w - identity|."""
    w = F.slice("w", 1, live)
    means = rows.agg(*[F.avg(F.get("w", F.lit(i))) for i in range(live)]).first()
    inside = F.zip_with(w, F.array(*map(F.lit, means)), lambda a, b: a - b)
    return float(np.abs(gram(rows, inside) / n - np.eye(live)).max())


RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Each vector on the first ``components`` principal axes, with unit variance on each.

    ``vectors``: vec_id, embedding.  Integers x = floor(scale * c) + shift are whitened.
    Result: a row per vector and component (from 1, by falling eigenvalue e; all of them if
    there are fewer): vec_id, component, n (vectors fitted), deviation (exact sum over
    dimensions of (n * x - S)^2, null from 10^38 on), whitened, explained (e / trace) and
    identity_error, one value.

    Vectors that are null or hold null or non-finite components take no part, nor do those
    with components of 2^52 / scale or more, which have no exact integer.  Repeated rows each
    count; a null vec_id stays null.  Vectors of each length are fitted by themselves; empty
    ones have no component.  On an axis without variance whitened is null and explained 0;
    identity_error covers the other axes and is null if there are none.  Equal eigenvalues
    come in the order the decomposition gives them.  An empty table gives an empty result.
    Extra columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    x = F.transform(scaled("embedding", scale), lambda v: v + shift)
    kept = table(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("x is not null"), "scaled")
    lengths = [(r["d"], r["n"]) for r in kept.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect() if r["d"]]
    out = spark.createDataFrame([], RESULT)
    for dims, n in sorted(lengths):  # most tables have one length
        own = kept.filter(F.size("x") == dims)
        total = sums(own, dims)
        covariance = gram(own, centred(total, n)) / n
        axes, values, share = directions(covariance, min(components, dims))
        live = int((values > 0).sum())
        scaled_axes = np.where(values > 0, axes / np.sqrt(np.where(values > 0, values, 1.0)), 0.0)
        rows = table(project(own, total, n, scaled_axes), "whitened")
        error = identity_error(rows, n, live) if live else None
        listed = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "value"))
        number = (F.col("at") + 1).cast("int")
        out = out.unionByName(listed.select(
            "vec_id", number.alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
            F.when(number <= live, F.col("value")).alias("whitened"),
            F.element_at(F.array(*map(F.lit, map(float, share))), number).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
        ))
    return out


def digest(vectors: DataFrame) -> DataFrame:
    """``whiten`` with its deviation as long (null beyond a long)."""
    return whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
