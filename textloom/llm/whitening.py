"""PCA whitening of integer-valued vectors: MLlib's SVD on centred distributed rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.ragged import released
from textloom.session import cut

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
LARGEST = float(1 << 46)  # entries from here on have no exact integer form
NULL_SHARE = 1e-24  # a direction with less of the largest eigenvalue has no variance but rounding
WHOLE = "decimal(38,0)"
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _matrix(arrays: DataFrame, column: str) -> RowMatrix:
    """A distributed matrix of an array column; the rows stay in the JVM."""
    rows = arrays.select(array_to_vector(F.col(column)).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"))


def _covariance(arrays: DataFrame, column: str, n: int) -> np.ndarray:
    """The covariance with divisor n; MLlib centres each row before it multiplies."""
    return _matrix(arrays, column).computeCovariance().toArray() * ((n - 1) / n)


def _projected(weights: np.ndarray):
    """mapInArrow function that replaces the column `centred` by its product with `weights`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("centred")
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(weights))
            y = x @ weights
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * weights.shape[1])
            columns = [c for i, c in enumerate(batch.columns) if i != at] + [pa.ListArray.from_arrays(ends, pa.array(y.reshape(-1)))]
            yield pa.RecordBatch.from_arrays(columns, [c for c in batch.schema.names if c != "centred"] + ["y"])

    return released(run)


def rotations(b: np.ndarray, sweeps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of a covariance by Jacobi's rotations.

    Unlike a solver whose error is a share of the largest eigenvalue, it finds the small ones of a graded matrix to
    about their own precision, as a rotation is judged against its own two diagonal entries.
    """
    b, v = b.copy(), np.eye(len(b))
    for _ in range(sweeps):
        turned = False
        for p in range(len(b) - 1):
            for q in range(p + 1, len(b)):
                if b[p, p] <= 0 or b[q, q] <= 0 or abs(b[p, q]) <= 1e-15 * math.sqrt(b[p, p]) * math.sqrt(b[q, q]):
                    continue
                turned = True
                zeta = (b[q, q] - b[p, p]) / (2 * b[p, q])
                t = math.copysign(1, zeta) / (abs(zeta) + math.hypot(1, zeta))
                c = 1 / math.hypot(1, t)
                turn = np.array([[c, c * t], [-c * t, c]])
                b[:, [p, q]] = b[:, [p, q]] @ turn
                b[[p, q], :] = turn.T @ b[[p, q], :]
                v[:, [p, q]] = v[:, [p, q]] @ turn
        if not turned:
            break
    return np.diag(b).copy(), v


def _axes(centred: DataFrame, n: int, dims: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the covariance, by falling eigenvalue, without those of no variance.

    computeSVD's singular values of the centred rows are rescaled by the divisor: e = s^2 / n. As it takes them from
    the matrix of products, whose rounding is a share of the largest, the rows are then projected on the vectors found,
    and what is left of the projections' covariance beside its diagonal is turned away.
    """
    found = _matrix(centred, "centred").computeSVD(dims if dims < 100 else min(dims, components), computeU=False, rCond=0.0)
    e, v = np.array(found.s.toArray()) ** 2 / n, found.V.toArray()
    b = _covariance(centred.select("centred").mapInArrow(_projected(v), "y array<double>"), "y", n)
    size = np.sqrt(np.maximum(np.diag(b), 0))
    off = np.divide(b, np.outer(size, size), out=np.zeros_like(b), where=np.outer(size, size) > 0)
    np.fill_diagonal(off, 0)
    if np.abs(off).max(initial=0) > 1e-12 or np.abs(np.diag(b) - e).max() > 1e-12 * e.max():
        e, turn = rotations(b)
        v = v @ turn
    order = np.argsort(-e, kind="stable")
    order = order[e[order] > NULL_SHARE * e[order[0]]][:components]
    return e[order], v[:, order] / np.linalg.norm(v[:, order], axis=0)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries c become integers x = floor(scale * c) + offset. S are their sums per dimension over the n vectors; centred
    rows are (n * x - S) / n, one rounding after exact arithmetic, so no offset costs precision. Components are the unit
    eigenvectors of the covariance (divisor n), numbered from 1 by falling eigenvalue e. deviation is the exact sum of
    (n * x - S)^2 over a vector's dimensions (null where it exceeds 64 bits), whitened the projection over sqrt(e),
    explained e over the total variance, which comes from the deviations and not from the eigenvalues, identity_error
    the largest entry by which the covariance of all whitened rows misses the identity.

    Only sums per dimension and matrices of dimensions x dimensions reach the driver. Centred rows are written to the
    shared folder, as four passes read them.

    Cases: vectors that are null, empty, or hold null or non-finite entries are dropped, like entries of 2^46 and more
    over the scale, which have no exact integer; so are vectors of another length than most have (of equally many, the
    longer); null ids stay; repeated rows are rows of their own; directions without variance are no components, so one
    vector, or equal vectors only, give no rows; an empty table gives none; other columns are ignored, whatever their
    names.
    """
    spark = vectors.sparkSession
    e = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("e"))
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / scale)
    whole = F.transform("e", lambda c: F.when(sound(c), F.floor(c * scale).cast("long") + F.lit(offset).cast("long")))
    x = rows.select("vec_id", whole.alias("x")).where("x is not null and size(x) > 0 and forall(x, c -> c is not null)")
    sizes = x.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], OUT)
    dims, n = sizes["size"], sizes["count"]
    x = x.where(F.size("x") == dims)
    sums = x.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(28,0)")).alias("s")).orderBy("pos")
    total = F.array(*[F.lit(str(r["s"])).cast(WHOLE) for r in sums.collect()])

    def apart(v: Column, s: Column) -> Column:
        return (v.cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)") - s).cast(WHOLE)

    apart_of = x.select("vec_id", F.zip_with("x", total, apart).alias("a"))
    square = F.aggregate("a", F.lit(0).cast(WHOLE), lambda acc, d: F.try_add(acc, F.try_multiply(d, d).cast(WHOLE)).cast(WHOLE))
    near = F.transform("a", lambda d: d.cast("double") / float(n))
    centred = cut(apart_of.select("vec_id", square.alias("exact"), near.alias("centred")))
    variance = F.coalesce(F.col("exact").cast("double") / float(n) / float(n), F.aggregate("centred", F.lit(0.0), lambda acc, d: acc + d * d))
    trace = centred.agg(F.sum(variance)).first()[0] / n
    if n < 2 or not trace:
        return spark.createDataFrame([], OUT)
    values, axes = _axes(centred, n, dims, components)
    whitened = centred.withColumn("deviation", F.col("exact").try_cast("long")).select("vec_id", "deviation", "centred")
    whitened = whitened.mapInArrow(_projected(axes / np.sqrt(values)), "vec_id long, deviation long, y array<double>")
    error = float(np.abs(_covariance(whitened, "y", n) - np.eye(len(values))).max())
    shares = F.array(*[F.lit(float(v)) for v in values / trace])
    out = whitened.select("vec_id", "deviation", F.posexplode("y").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
