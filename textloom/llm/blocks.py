"""All-pairs comparison inside candidate components: links are counted per row, pairs are never emitted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import block_pairs
from textloom.llm.ragged import released, runs
from textloom.operators.graph import components, meet
from textloom.session import cut

SCHEMA = "node long, links long, root long, n_blocks int"


def numbered(sets: DataFrame) -> DataFrame:
    """Adds node, a number of its own for every row, and cuts the lineage, so that the numbers stay as they are."""
    return cut(sets.withColumn("node", F.monotonically_increasing_id()))


def linked(dealt: DataFrame, load: Callable, compare: Callable, clear: Callable | None = None) -> DataFrame:
    """(node, links, component) of every member that may have links.

    dealt: the columns of deal(), mult (rows that the node stands for) and payload columns. In each task of
    block_pairs(), `load(columns, i)` turns a row's payload into what compare() needs and `compare(left, right)` gives
    the boolean matrix of links between two lists of loaded rows (right is left for the pairs within a block). A node's
    links are the summed mult of its partners. A task emits one row per node with the smallest node that it reaches in
    the task; components dealt over several tasks are joined by connected components over those rows.
    """
    keys = ["component", "bi", "bj"]
    ordered = block_pairs(dealt).repartition(*keys).sortWithinPartitions(*keys, "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(columns: dict, i: int) -> tuple:
            return columns["node"][i].as_py(), columns["mult"][i].as_py(), columns["side"][i].as_py(), columns["n_blocks"][i].as_py(), load(columns, i)

        out: list[tuple] = []
        for key, rows in runs(batches, keys, row):
            out += _task(key, rows, compare)
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        yield _rows(out)

    found = cut(ordered.mapInArrow(released(run, clear), SCHEMA))
    split = found.where("n_blocks > 1")
    joined = components(split.where("node <> root"), "node", "root")
    counted = split.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    large = counted.join(joined, "node", "left").select("node", "links", F.coalesce("component", "root").alias("component"))
    return found.where("n_blocks = 1").select("node", "links", F.col("root").alias("component")).union(large)


def classed(sets: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """`sets` (numbered, with mult) with links, component (a node) and class_id, the smallest id of the class.

    Sets that found no partner are a class of their own. A hot class meets its smallest id by meet().
    """
    members = cut(found.join(sets.select("node", F.col(id_col).alias("_id")), "node"))
    tops = cut(members.groupBy("component").agg(F.min("_id").alias("class_id"), F.count("*").alias("_n")))
    total = tops.agg(F.sum("_n")).first()[0] or 0
    named = meet(members.select("node", "links", "component"), tops, "component", "_n", total)
    out = sets.join(named, "node", "left")
    return out.withColumns({"links": F.coalesce("links", F.lit(0)) + F.col("mult") - 1, "component": F.coalesce("component", "node"), "class_id": F.coalesce("class_id", id_col)})


def _rows(out: list[tuple]) -> pa.RecordBatch:
    node, links, root, blocks = zip(*out, strict=True) if out else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64()), pa.array(blocks, pa.int32())], ["node", "links", "root", "n_blocks"])


def _task(key: tuple, rows: list[tuple], compare: Callable) -> list[tuple]:
    """One task: the rows of one block, or of two, whose pairs across are compared."""
    seen: set[int] = set()
    rows = [r for r in rows if r[4] is not None and not (r[0] in seen or seen.add(r[0]))]
    if not rows:
        return []
    across = key[1] != key[2]
    left = [r for r in rows if r[2] == 0] if across else rows
    right = [r for r in rows if r[2] == 1] if across else rows
    nodes = [np.array([r[0] for r in side], dtype=np.int64) for side in (left, right)]
    mults = [np.array([r[1] for r in side], dtype=np.int64) for side in (left, right)]
    if not left or not right or (not across and len(left) == 1):
        return [(r[0], 0, r[0], r[3]) for r in rows]
    near = compare([r[4] for r in left], [r[4] for r in right])
    roots = [n.copy() for n in nodes]
    if not across:
        np.fill_diagonal(near, False)
    while True:
        low = [_lowest(near, roots[0], roots[1]), _lowest(near.T, roots[1], roots[0])]
        if all(np.array_equal(a, b) for a, b in zip(low, roots, strict=True)):
            break
        roots = low
    blocks = rows[0][3]
    sides = (0, 1) if across else (0,)
    counts = [_summed(near, mults[1]), _summed(near.T, mults[0])]
    return [(int(n), int(c), int(r), blocks) for s in sides for n, c, r in zip(nodes[s], counts[s], roots[s], strict=True)]


def _summed(near: np.ndarray, mults: np.ndarray) -> np.ndarray:
    """near @ mults, some rows at a time: the product makes whole numbers of the matrix first."""
    return np.concatenate([near[i : i + 256] @ mults for i in range(0, len(near), 256)])


def _lowest(near: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each row of `near`, the least of its own root and those of its partners."""
    out = own.copy()
    top = np.iinfo(np.int64).max
    for i in range(0, len(own), 512):
        part = near[i : i + 512]
        some = part.any(axis=1)
        if some.any():
            out[i : i + 512][some] = np.minimum(out[i : i + 512][some], np.where(part[some], other, top).min(axis=1))
    return out


def star_edges(keys: DataFrame) -> DataFrame:
    """(u, v) from every node to the smallest node that shares a bucket with it.

    keys: node, keys (array of bucket hashes). Buckets are counted with a combining aggregate; those of one node are
    dropped, and the rest hangs its nodes below the smallest one: as many edges as places, however large a bucket is.
    The places of a hot bucket meet its smallest node by meet(). Cases: null or empty arrays, or a key twice in one:
    no edge; repeated rows: one edge; an empty table: no rows; other columns are ignored, whatever their names.
    """
    placed = keys.select("node", F.explode("keys").alias("key"))
    least = placed.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("top"), F.count("*").alias("n"))
    least = cut(least.where("top > v").select("key", "v", "n"))
    total = least.agg(F.sum("n")).first()[0] or 0
    return meet(placed, least, "key", "n", total).where("node <> v").select(F.col("node").alias("u"), "v").distinct()
