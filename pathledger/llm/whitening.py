"""Embedding whitening: MLlib's SVD of the centred rows, eigenvalues by divisor n, total variance from exact deviations."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathledger.llm.common import checkpoint_dir

SCALE = 256
COMPONENTS = 4
#: Eigenvalues at most so many times the largest are zero: nothing but rounding lies along their vectors.
RANK = 1e-13


def scaled(column: str) -> Column:
    """floor(256 * c) of each entry as a long; null where the vector is null or holds an entry that is null, not finite or beyond a long."""
    wide = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE))
    fine = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < float(1 << 63), F.lit(False)) & ~F.isnan(c.cast("double")))
    return F.when(fine, wide)


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def spread(x: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, list[int]]:
    """(n * x - S, the sum of its squares for each row), exact: in int64 while that holds them, else in Python's integers."""
    most = max((abs(int(x.min())), abs(int(x.max()))), default=0) if x.size else 0
    reach = n * most + max(map(abs, total), default=0)
    if reach * reach * max(1, x.shape[1]) < 1 << 63:
        t = x * n - np.array(total, np.int64)
        return t, np.einsum("ij,ij->i", t, t).tolist()
    t = x.astype(object) * n - np.array(total, object)
    return t, [sum(v * v for v in row) for row in t]


def centred(t: np.ndarray, n: int) -> np.ndarray:
    """x - S/n with one rounding: the quotient of exact integers."""
    if t.dtype == object:
        return np.array([[float(Fraction(v, n)) for v in row] for row in t], np.float64).reshape(t.shape)
    return t.astype(np.float64) / n if not t.size or np.abs(t).max() < 1 << 53 else np.array([[v / n for v in row] for row in t.tolist()])


def whole_sums(df: DataFrame, of: Callable[[pa.RecordBatch], list[int]]) -> list[int]:
    """Element-wise sums of a list of integers that each batch gives: one row an entry and task, added as decimals."""

    def partial(batches: Iterator[pa.RecordBatch]):
        total: list[int] = []
        for b in batches:
            if b.num_rows:
                now = of(b)
                total = [x + y for x, y in zip(total, now)] if total else now
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(v) for v in total], pa.string())], ["at", "v"])

    rows = df.mapInArrow(partial, "at int, v string").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("at")
    return [int(r.v) for r in rows.collect()]  # as many as a vector has entries


def real_sums(df: DataFrame, size: int, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    def partial(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of(b)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["at", "v"])

    rows = df.mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at")
    return np.array([r.v for r in rows.collect()])


def components_of(fit: DataFrame, dims: int, n: int, total: list[int], wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors as columns), at most `wanted`, from MLlib's SVD of the centred rows. Zero ones are left out.

    All singular values are asked for: MLlib then solves the Gram matrix whole, by LAPACK and not by iteration.
    """

    def rows(batches):
        for b in batches:
            c = centred(spread(matrix(b, dims), n, total)[0], n)
            offsets = np.arange(0, c.size + 1, dims, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, c.ravel())], ["c"])

    vectors = fit.select("x").mapInArrow(rows, "c array<double>").select(array_to_vector("c").alias("v"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), n, dims).computeSVD(dims)
    e = np.array(svd.s.toArray()) ** 2 / n
    v = svd.V.toArray()
    kept = [k for k in range(min(wanted, len(e))) if e[k] > e[0] * RANK * dims]
    return e[kept], v[:, kept]


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each row's first principal coordinates at unit variance.

    Rows whose vector is null or holds an entry that is null, not finite or, times 256, beyond a long are left out, and so are
    vectors of another length than the commonest (of equally common ones the longest). x = floor(256 * entry). Each
    distinct x counts once in sums, covariance and components; every row comes out, repeated ones as often as they stand,
    null keys as null. Vectors of fewer entries than `components` have as many components. A component without variance has
    explained 0 (null if nothing varies at all) and whitened null. `deviation` is null where a long can't hold it. Empty
    vectors and an empty table give no rows. Other columns, whatever their names, are ignored.

    The sums are exact integers; a task adds its rows and sends one number an entry. Only the d sums, the d x d Gram matrix inside
    MLlib and the 4 components reach the driver or a closure; d up to some thousands.
    """
    spark = vectors.sparkSession
    folder = f"{checkpoint_dir(spark)}/whitening-{uuid.uuid4().hex}"
    vectors.select(F.col(key).alias("vec_id"), scaled(column).alias("x")).filter("x is not null").write.parquet(f"{folder}/x")
    rows = spark.read.parquet(f"{folder}/x")
    id_type = rows.schema["vec_id"].dataType
    out_schema = f"vec_id {id_type.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = lengths.d if lengths else 0
    if not dims:
        return spark.createDataFrame([], out_schema)
    rows = rows.filter(F.size("x") == dims)
    rows.select("x").distinct().write.parquet(f"{folder}/fit")
    fit = spark.read.parquet(f"{folder}/fit")
    n = fit.count()

    def columns(b: pa.RecordBatch) -> list[int]:
        x = matrix(b, dims)
        safe = int(np.abs(x.astype(np.float64)).max()) * len(x) < 1 << 62
        return [int(v) for v in (x if safe else x.astype(object)).sum(axis=0)]

    total = whole_sums(fit, columns)
    varies = whole_sums(fit, lambda b: [sum(spread(matrix(b, dims), n, total)[1])])[0]
    wanted = min(components, dims)
    e, v = components_of(fit, dims, n, total, wanted) if varies else (np.zeros(0), np.zeros((dims, 0)))
    project = v / np.sqrt(e)
    found = len(e)

    def coordinates(b: pa.RecordBatch) -> np.ndarray:
        return centred(spread(matrix(b, dims), n, total)[0], n) @ project

    error = None
    if found:
        mean = real_sums(fit, found, lambda b: coordinates(b).sum(axis=0)) / n

        def gram(b: pa.RecordBatch) -> np.ndarray:
            w = coordinates(b) - mean
            return (w.T @ w).ravel()

        error = float(np.abs(real_sums(fit, found * found, gram).reshape(found, found) / n - np.eye(found)).max())
    trace = Fraction(varies, n**3)
    explained = [float(Fraction(float(x)) / trace) for x in e] + [0.0 if varies else None] * (wanted - found)

    def result(batches):
        for b in batches:
            if not b.num_rows:
                continue
            t, deviation = spread(matrix(b, dims), n, total)
            w = centred(t, n) @ project
            m = b.num_rows
            ids = b.column(b.schema.get_field_index("vec_id")).take(pa.array(np.repeat(np.arange(m), wanted)))
            white = np.full((m, wanted), np.nan)
            white[:, :found] = w
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), m)), pa.array(np.full(m * wanted, n, np.int64)),
                    pa.array([d if d < 1 << 63 else None for d in deviation for _ in range(wanted)], pa.int64()), pa.array(white.ravel(), mask=np.isnan(white.ravel())),
                    pa.array(explained * m, pa.float64()), pa.array([error] * (m * wanted), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    assert all(x is None or math.isfinite(x) for x in explained)
    return rows.mapInArrow(result, out_schema)
