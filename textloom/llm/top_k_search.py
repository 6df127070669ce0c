"""Exact top-k search by inner product: an impact-ordered index that is read score-at-a-time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.ragged import released, runs
from textloom.session import cut

K = 10
SCALE = 1024
SHARD = 8192  # rows of an index
BLOCK = 4096  # queries that meet an index at a time
LEVELS = 32  # into which impacts are quantised
PLANES = 32  # whose signs put like vectors into one shard
FOUND = "query long, query_id long, vec_id long, row long, score long"


class Index:
    """Postings of one shard: for each dimension its rows by value, so that a segment of one impact is a slice.

    Equal vectors are one row of the index, with their members by id; only the first `keep` of them can be in a result.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, keep: int):
        order = np.lexsort((rows, ids))
        self.x, group = np.unique(x[order], axis=0, return_inverse=True)
        by_group = np.argsort(group.reshape(-1), kind="stable")
        sizes = np.bincount(group.reshape(-1), minlength=len(self.x))
        place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = by_group[place < keep]
        self.starts = np.concatenate([[0], np.cumsum(np.minimum(sizes, keep))])
        self.ids, self.rows = ids[order][kept], rows[order][kept]
        self.x = self.x.astype(np.int64)
        self.low, self.high = self.x.min(axis=0), self.x.max(axis=0)
        self.postings = np.argsort(self.x, axis=0, kind="stable").T.reshape(-1)  # dimension by dimension
        values = np.sort(self.x, axis=0) - self.low
        self.stride = int((self.high - self.low).max()) + 2
        self.values = (values + np.arange(self.x.shape[1]) * self.stride).T.reshape(-1)

    def segments(self, q: np.ndarray, width: int) -> np.ndarray:
        """(levels + 1, dimensions): where the postings of at least that impact begin or, for negative weights, end."""
        gain, span = np.abs(q), self.high - self.low
        least = -(-(np.arange(LEVELS + 1)[:, None] * width) // np.maximum(gain, 1))  # the distance from the worst value
        least = np.minimum(least, span + 1)
        at = np.where(q > 0, least, span - least + 1) + np.arange(len(q)) * self.stride
        return np.searchsorted(self.values, at)

    def search(self, q: np.ndarray, k: int, least: int | None, own: int) -> list[tuple[int, int, int]]:
        """The best k (vec_id, row, score) but for the row `own`, all that tie with the k-th by score cut by id; only scores from `least` on.

        A posting's impact is what it adds to the worst score in the shard. Segments are processed from the highest
        quantised impact of all dimensions down. After a level the accumulator bounds the score of every row: what it has
        met counts as the top of its level, what it hasn't as the level itself. Rows whose bound is below a score that k
        others reach are out; when few are left, and only then, processing stops, and these are scored exactly.
        """
        base = int((np.where(q > 0, self.low, self.high) * q).sum())
        reach = np.abs(q) * (self.high - self.low)
        n = len(self.x)
        if least is not None and base + int(reach.sum()) < least:
            return []
        possible = np.arange(n)
        if n > 4 * k and reach.max() > 0:
            width = int(reach.max()) // LEVELS + 1
            ends = self.segments(q, width)
            met, bound = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for level in range(LEVELS - 1, -1, -1):
                active = np.flatnonzero(reach >= level * width)
                a, b = ends[level, active], ends[level + 1, active]
                parts = [self.postings[i:j] for i, j in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True) if i < j]
                if parts:
                    met += np.bincount(np.concatenate(parts), minlength=n)
                bound += met
                if level % 4 == 0 and level < LEVELS - 4:
                    likely = np.argpartition(bound, n - 2 * (k + 1))[n - 2 * (k + 1) :]
                    score = int(np.partition(self.x[likely] @ q, k + 1)[k + 1])  # k + 1 vectors reach it, at most one of them is the query's own
                    least = score if least is None else max(least, score)
                if least is not None:
                    rest = base + int(np.minimum(reach, level * width).sum())
                    possible = np.flatnonzero(width * bound + rest >= least)
                    if len(possible) <= max(4 * k, n // 32):
                        break
        score = self.x[possible] @ q
        if len(score) > k + 1:
            nth = int(np.partition(score, len(score) - k - 1)[len(score) - k - 1])
            least = nth if least is None else max(least, nth)
        if least is not None:
            possible, score = possible[score >= least], score[score >= least]
        sizes = self.starts[possible + 1] - self.starts[possible]
        members = np.repeat(self.starts[possible] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        score, ids, rows = np.repeat(score, sizes), self.ids[members], self.rows[members]
        best = np.lexsort((rows, ids, -score))
        best = best[rows[best] != own][:k]
        return list(zip(ids[best].tolist(), rows[best].tolist(), score[best].tolist(), strict=True))


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, vec_id, asks, x) to the same with the vector as 32-bit integers, its length and the signs of its products with random planes."""
    planes: dict[int, np.ndarray] = {}
    powers = np.int64(1) << np.arange(PLANES - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        column = batch.column(3)
        flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        codes = np.zeros(len(sizes), dtype=np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size not in planes:
                planes[size] = np.random.default_rng(int(size)).standard_normal((size, PLANES))
            x = flat[(ends[at] - size)[:, None] + np.arange(size)]
            codes[at] = (x @ planes[size] >= 0) @ powers
        packed = [part.tobytes() for part in np.split(flat.astype(np.int32), ends[:-1])] if len(sizes) else []
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(codes), pa.array(packed, pa.binary())], ["row", "vec_id", "asks", "size", "code", "x"])


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "query_id", "vec_id", "row", "score"])


def _index(rows: list[tuple], keep: int) -> Index:
    x = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.int32).reshape(len(rows), -1)
    return Index(x, np.array([r[1] for r in rows]), np.array([r[0] for r in rows]), keep)


def _answers(keys: list[str], k: int, first: bool):
    """mapInArrow function over groups of `keys`: rows of one shard are indexed, then the group's queries are asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(columns: dict, i: int) -> tuple:
            return tuple(columns[c][i].as_py() for c in ("row", "vec_id", "x", "asks", "home", "least"))

        out: list[tuple] = []
        for key, rows in runs(batches, keys, row):
            held = rows if first else [r for r in rows if not r[3]]
            asked = [r for r in rows if r[3] and (first or r[4] != key[0])]
            if held and asked:
                index = _index(held, k + 1)
                for own, query_id, x, _, _, least in asked:
                    found = index.search(np.frombuffer(x, dtype=np.int32).astype(np.int64), k, least, own)
                    out += [(own, query_id, *f) for f in found]
            if len(out) > 50_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return released(run)


def exact_top_k(vectors: DataFrame, queries: Column | str, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` (a condition) selects, the k rows of highest inner product.

    Components become floor(scale * x); scores are exact inner products of these integers. Every row but the query's own
    is a candidate; ties go to the smaller vec_id.

    1. Rows are dealt by ranges of the signs of their products with random planes, so that like vectors share a shard;
       equal signs are dealt by a hash of the row, so that no vector, however common, makes a large shard.
    2. A shard becomes an impact-ordered index, which answers its own queries first. The k-th score is a bound for 3.
    3. Blocks of queries meet every other shard. Tasks emit at most k rows per query and shard, and only those that
       reach the query's bound; the best k of all are the answer.

    Each of these steps is written to the shared folder. Nothing but row counts reaches the driver.

    Cases: vectors that are null, empty, or hold null or non-finite components, and rows without an id, take no part; so
    do vectors so large that a score might leave 64 bits (components past sqrt(2^59 / length)); vectors of
    different lengths don't meet; repeated rows are rows of their own: each is a candidate of the other and asks for
    itself; fewer than k candidates: all of them; an empty table or no query gives no rows; other columns are ignored,
    whatever their names.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(F.expr(queries) if isinstance(queries, str) else queries, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("e"))
    most = F.least(F.sqrt(F.lit(float(1 << 59)) / F.size("e")), F.lit(float((1 << 31) - 1)))
    sound = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < most / scale))
    sound = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & sound
    rows = rows.where(F.coalesce(sound, F.lit(False))).withColumn("x", F.transform("e", lambda v: F.floor(v * scale).cast("double")))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "asks", "x")
    placed = cut(rows.mapInArrow(released(_place), "row long, vec_id long, asks boolean, size int, code long, x binary"))
    n, asking = placed.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil(asking / block))
    dealt = placed.repartitionByRange(shards, "size", "code", F.xxhash64("row"))
    dealt = cut(dealt.withColumn("shard", F.spark_partition_id()).drop("code").sortWithinPartitions("size"))
    shards = (dealt.agg(F.max("shard")).first()[0] or 0) + 1

    none = F.lit(None).cast("long")
    ready = dealt.withColumns({"home": F.col("shard"), "least": none})
    own = cut(ready.mapInArrow(_answers(["shard", "size"], k, True), FOUND))
    least = own.groupBy(F.col("query").alias("row")).agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    asked = dealt.where("asks").join(least, "row", "left").withColumn("home", F.col("shard"))
    asked = asked.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "block": F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")})
    held = dealt.withColumns({"home": F.col("shard"), "least": none, "asks": F.lit(False), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    keys = ["shard", "size", "block"]
    met = held.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "row")
    others = met.mapInArrow(_answers(keys, k, False), FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    best = own.union(others).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH r AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row AS query, q.vec_id AS query_id, r.row, r.vec_id, CAST(list_dot_product(q.x, r.x) AS BIGINT) AS score
  FROM r AS q JOIN r ON len(q.x) = len(r.x) AND q.row <> r.row WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, row) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 10
"""
