"""Near-duplicate vectors: sign hashing by random hyperplanes in several tables, exact cosine, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.blocks import classed, linked, numbered, star_edges
from textloom.llm.components import deal
from textloom.llm.ragged import lists, mix, released
from textloom.operators.graph import components
from textloom.session import cut

THRESHOLD = 0.98
MISS = 1e-6
BLOCK = 4096  # vectors of a block
NUMBERS = 4_000_000  # and their components: 32 MB


def plan_tables(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): bits grow with log2 of the largest label's rows, so that unlike vectors rarely meet; the tables
    make a pair at the threshold share no bucket with probability `miss` at most."""
    bits = min(60, math.ceil(math.log2(max(rows, 2))) + 11)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def cosine_links(left: list, right: list, threshold: float = THRESHOLD) -> np.ndarray:
    """compare() of linked(): cosine >= threshold, in double precision."""
    sides = []
    for side in (left, right):
        x = np.stack(side)
        x = x / np.abs(x).max(axis=1)[:, None]  # the squares of large or small components leave the range of doubles
        sides.append(x / np.sqrt((x * x).sum(axis=1))[:, None])
    near = np.zeros((len(left), len(right)), dtype=bool)
    for i in range(0, len(left), 512):
        near[i : i + 512] = sides[0][i : i + 512] @ sides[1].T >= threshold
    return near


def _load(columns: dict, i: int) -> np.ndarray:
    return np.array(columns["embedding"][i].values if hasattr(columns["embedding"][i], "values") else columns["embedding"][i].as_py(), dtype=np.float64)


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 7) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors of one label (and one length) link when their cosine is at least `threshold`. n_links counts the other rows
    linked directly, component_id is the smallest id reachable by links, kept = (vec_id = component_id).

    Equal vectors collapse first, and each set of them gets a number of its own. Each vector gets a bucket per table
    from the signs of its products with random hyperplanes; vectors of a bucket hang below its smallest number, and the
    connected components of these edges are the candidates. Inside a component every pair is compared in double
    precision, in blocks; tasks emit counts, not pairs.

    Cases: a null label, or a vector that is null, empty, zero or has a null or non-finite component: no links, its own
    component; a null id: likewise, with component_id null; repeated rows are separate rows; an id that stands for
    different vectors has the links of each in its row; ties need no order; numbers may be of any magnitude; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    good = rows.where("sound")
    sets = numbered(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("set_id"), F.count("*").alias("mult")))
    most = good.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan_tables(most, threshold)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for batch in batches:
            keys = np.zeros((batch.num_rows, tables), dtype=np.uint64)
            column = batch.column(2)
            sizes = np.array(column.value_lengths().to_pylist(), dtype=np.int64)
            vectors_ = column.to_pylist()
            salts = np.array(batch.column(1).to_pylist(), dtype=np.int64).view(np.uint64)
            for dim in np.unique(sizes):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((tables * bits, int(dim)))
                at = np.flatnonzero(sizes == dim)
                for part in np.array_split(at, max(1, len(at) // 2000)):
                    x = np.array([vectors_[i] for i in part], dtype=np.float64)
                    x /= np.abs(x).max(axis=1)[:, None]
                    signs = (x @ planes[dim].T >= 0).reshape(len(part), tables, bits)
                    packed = (signs * powers).sum(axis=2, dtype=np.uint64)
                    keys[part] = mix(packed ^ mix(np.arange(tables, dtype=np.uint64) + np.uint64(dim) * np.uint64(65536))[None, :] ^ mix(salts[part])[:, None])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(keys.reshape(-1).view(np.int64), np.full(batch.num_rows, tables), pa.int64())], ["node", "keys"])

    keyed = sets.select("node", F.xxhash64("label").alias("salt"), "embedding").mapInArrow(released(place), "node long, keys array<long>")
    members = sets.select("node", "mult", "label", F.size("embedding").alias("size")).join(components(star_edges(keyed)), "node")
    # a bucket holds one label and one length but for collisions of 64-bit hashes; the split by both makes it certain
    members = cut(members.select("node", "mult", "size", F.xxhash64("component", "label", "size").alias("component")))
    vectors_of = deal(members, block, "size", NUMBERS).join(sets.select("node", "embedding"), "node")
    found = linked(vectors_of, _load, lambda a, b: cosine_links(a, b, threshold))
    classes = classed(sets, found, "set_id").select("label", "embedding", F.col("links").alias("n_links"), F.col("class_id").alias("component_id"))
    done = good.join(classes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS low FROM v UNION SELECT p.y, r.low FROM reach r JOIN pairs p ON p.x = r.node),
parts AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN parts ON node = vec_id
"""
