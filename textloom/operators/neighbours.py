"""Nearest rows by a grid join: blocks of queries meet stripes of the pool on the executors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096  # queries that a task holds
TILE = 1 << 20  # distances that a task holds
FOUND = "seed long, pool long, far double"


def grid(queries: DataFrame, pool: DataFrame, block: int = BLOCK, stripes: int | None = None) -> DataFrame:
    """(id, v, qb, stripe, side): queries (side 0) in blocks of about `block`, each beside every stripe of the pool (side 1).

    Both tables have (id long, v array<double>). Rows of a block and a stripe stand together, queries first, so that a task
    holds one block and reads the stripe by batches. A query is sent once per stripe, a pool row once per block of
    queries; stripes are as many as give every core a task.
    """
    n = queries.count()
    blocks = max(1, math.ceil(n / block))
    stripes = stripes or max(1, math.ceil(2 * queries.sparkSession.sparkContext.defaultParallelism / blocks))
    of = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = queries.select("id", "v", of(blocks).alias("qb"), every(stripes).alias("stripe"), F.lit(0).alias("side"))
    held = pool.select("id", "v", every(blocks).alias("qb"), of(stripes).alias("stripe"), F.lit(1).alias("side"))
    keys = ["qb", "stripe"]
    return asked.union(held).repartition(*keys).sortWithinPartitions(*keys, "side", "id")


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, np.ndarray, np.ndarray]]:
    """The parts of grid()'s batches that share block, stripe and side: (block and stripe, side, ids, vectors)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, vectors, *keys = batch.columns
        ids = ids.to_numpy()
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        marks = np.stack([k.to_numpy() for k in keys])
        starts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), len(ids)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield tuple(marks[:2, a].tolist()), int(marks[2, a]), ids[a:b], x[a:b]


class Best:
    """The k nearest pool rows of each query of one block, as the pool goes by; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, far: Callable, refine: Callable | None, others: bool):
        self.ids, self.x, self.k, self.far, self.refine, self.others = ids, x, k, far, refine, others
        self.row = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.int64)
        self.dist = np.zeros(0)
        self.limit = np.full(len(ids), np.inf)
        self.order = np.argsort(ids, kind="stable")

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(1, TILE // max(1, len(self.ids)))
        for i in range(0, len(ids), step):
            self._add(ids[i : i + step], x[i : i + step])

    def _add(self, ids: np.ndarray, x: np.ndarray) -> None:
        d, slack = self.far(self.x, x)
        if self.others:
            first, last = (np.searchsorted(self.ids, ids, side, self.order) for side in ("left", "right"))
            col = np.repeat(np.arange(len(ids)), last - first)
            d[self.order[np.arange(len(col)) - np.repeat(np.cumsum(last - first) - last, last - first)], col] = np.inf
        limit = self.limit
        if len(ids) > self.k and np.isinf(limit).any():  # once every query has k rows, few pool rows are nearer
            limit = np.minimum(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        near = d <= (limit + 2 * slack)[:, None]
        if np.isinf(limit).any():
            near &= d < np.inf
        row, col = np.divmod(np.flatnonzero(near), len(ids))  # much faster than by rows and columns
        near = d[row, col]
        if self.refine is not None:
            near = np.concatenate([np.zeros(0), *[self.refine(self.x[row[i : i + 50_000]], x[col[i : i + 50_000]]) for i in range(0, len(row), 50_000)]])
        row, pool, near = np.concatenate([self.row, row]), np.concatenate([self.pool, ids[col]]), np.concatenate([self.dist, near])
        order = np.lexsort((pool, near, row))
        row, pool, near = row[order], pool[order], near[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < self.k
        self.row, self.pool, self.dist = row[keep], pool[keep], near[keep]
        full = np.bincount(self.row, minlength=len(self.ids)) == self.k
        last = np.searchsorted(self.row, np.arange(len(self.ids)), side="right") - 1
        self.limit[full] = self.dist[last[full]]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.pool), pa.array(self.dist)], ["seed", "pool", "far"])


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def cosine_distance(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Negative cosines of six digits, so that ties are ties in every task."""
    return -np.round(units(a) @ units(b).T, 6), 0.0


def euclidean_distance(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances by one matrix product, and by row how far they may be off."""
    squares = (a * a).sum(axis=1), (b * b).sum(axis=1)
    d = a @ b.T
    d *= -2
    d += squares[0][:, None]
    d += squares[1]
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    return d, np.sqrt(1e-13 * (squares[0] + squares[1].max(initial=0)))


def exact_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs of rows, to nine decimals, so that they are the same in every task."""
    d = a - b
    return np.round(np.sqrt(np.einsum("ij,ij->i", d, d)), 9)


METRICS = {"cosine": (cosine_distance, None), "euclidean": (euclidean_distance, exact_distance)}


def vectors_of(df: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    """(id, v) of the rows with an id and a vector of that length without holes."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.where("id is not null and v is not null").where((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def nearest(queries: DataFrame, pool: DataFrame, k: int, metric: str = "cosine", others: bool = False, block: int = BLOCK, stripes: int | None = None) -> DataFrame:
    """(seed, pool, far, place): the k nearest pool rows of each query, ties by id; `others` leaves out rows of the same id.

    queries and pool: (id, v), see vectors_of(). far is the negative cosine or the Euclidean distance. Every query meets
    every pool row in the block products of grid(), no row passes the driver, and a task sends k rows per query on.
    """
    far, refine = METRICS[metric]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        ids: list[np.ndarray] = []
        x: list[np.ndarray] = []
        best: Best | None = None
        for own, side, some, rows in streamed(batches):
            if own != key:
                if best is not None:
                    yield best.batch()
                key, best, ids, x = own, None, [], []
            if side == 0:
                ids.append(some)
                x.append(rows)
            elif ids:
                if best is None:
                    best = Best(np.concatenate(ids), np.concatenate(x), k, far, refine, others)
                best.add(some, rows)
        if best is not None:
            yield best.batch()

    found = grid(queries, pool, block, stripes).mapInArrow(run, FOUND)
    place = F.row_number().over(Window.partitionBy("seed").orderBy("far", "pool"))
    return found.withColumn("place", place).where(F.col("place") <= k)
