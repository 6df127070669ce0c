"""Hierarchical density clustering: mutual reachability, a minimum spanning tree, the condensed tree and its stable clusters."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.graph import anew as cut
from textloom.operators.graph import components
from textloom.operators.neighbours import exact_distance, nearest, vectors_of
from textloom.operators.similarity import dim_of

PAIR_BLOCK = 8192  # rows of a block at most; a task spans two
LEAST_BLOCK = 2048  # and at least, if the table is not smaller
TILE = 2048  # rows of a block whose distances to as many others a task holds
LOCAL = 200_000  # edges (or nodes, or clusters) that one task takes in a loop
FOREST = 10  # times as many are sorted arrays of edges
LEAST_WEIGHT = 1e-9  # the distance of equal rows, whose density has no bound

EDGE = "w double, u long, v long"


def reachability(x: np.ndarray, y: np.ndarray, core_x: np.ndarray, core_y: np.ndarray) -> np.ndarray:
    """The mutual reachability distances of rows x and rows y, the same as exact_distance() gives.

    Distances come from one product; only where its error can change the ninth decimal, and no core distance is larger, is
    the exact distance taken.
    """
    squares, others = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    error = 2e-15 * (x.shape[1] + 8) * (squares.max(initial=0) + others.max(initial=0))  # of a square of a distance
    out = np.empty((len(x), len(y)))
    for i in range(0, len(x), 256):
        d = x[i : i + 256] @ y.T
        d *= -2
        d += squares[i : i + 256, None]
        d += others
        np.maximum(d, 0, out=d)
        np.sqrt(d, out=d)
        core = np.maximum(core_x[i : i + 256, None], core_y)
        with np.errstate(divide="ignore"):
            off = (error * 1e9) / d
        scaled = d * 1e9
        off += np.abs(scaled - np.rint(scaled))  # from the nearest number of nine decimals
        row, col = np.nonzero((off >= 0.5) & ((d + 1e-6 >= core) | (d <= 1e7 * error)))
        np.round(d, 9, out=d)
        for k in range(0, len(row), 50_000):
            r, c = row[k : k + 50_000], col[k : k + 50_000]
            d[r, c] = exact_distance(x[i + r], y[c])
        np.maximum(d, core, out=out[i : i + 256])
    return out


def prim(ids: np.ndarray, weights: np.ndarray, split: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimum spanning tree (w, u, v), u < v, of all pairs of rows, or of the pairs of the first `split` with the others.

    Edges are ordered by (w, u, v), so that there is one tree, and edges of a larger table's tree are in it. Of the edges of
    one row that are as long, that to the smallest id is the least.
    """
    n = len(ids)
    w, near, left = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max), np.ones(n, dtype=bool)
    found, far, place = np.empty((2, n - 1), dtype=np.int64), np.empty(n - 1), 0
    across = None if split is None else np.ascontiguousarray(weights.T)
    parts = {k: (w[k], near[k], left[k]) for k in (slice(None), slice(split, n), slice(0, split))}
    for step in range(n - 1):
        left[place], w[place], own = False, np.inf, ids[place]
        if split is None:
            row, some = weights[place], slice(None)
        elif place < split:
            row, some = weights[place], slice(split, n)
        else:
            row, some = across[place - split], slice(0, split)
        best, partner, open_ = parts[some]
        better = row == best
        better &= partner > own
        better |= row < best
        better &= open_
        np.copyto(best, row, where=better)
        np.copyto(partner, own, where=better)
        place = int(w.argmin())
        ties = np.flatnonzero(w == w[place])
        if len(ties) > 1:
            low, high = np.minimum(ids[ties], near[ties]), np.maximum(ids[ties], near[ties])
            some = np.flatnonzero(low == low.min())
            place = int(ties[some[high[some].argmin()]])
        far[step], found[0, step], found[1, step] = w[place], ids[place], near[place]
    return far, found.min(axis=0), found.max(axis=0)


def forest(w: np.ndarray, u: np.ndarray, v: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> np.ndarray:
    """The places of the edges of the least spanning forest, by (w, u, v), of the nodes u and v (or of the parts a and b that they are in)."""
    order = np.lexsort((v, u, w))
    a, b = (u, v) if a is None else (a, b)
    nodes, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    at, many, taken = np.arange(len(order)), len(nodes), []
    a, b = ends[: len(at)], ends[len(at) :]
    while True:
        out = np.flatnonzero(a != b)
        if not len(out):
            return order[np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *taken]))]
        a, b, at = a[out], b[out], at[out]
        first = np.full((2, many), len(at))  # each part's first edge outward: of equal places the last written stays
        first[0, a[::-1]] = first[1, b[::-1]] = np.arange(len(at))[::-1]
        first = first.min(axis=0)
        part = np.flatnonzero(first < len(at))
        first = first[part]
        taken.append(at[np.unique(first)])
        top = np.arange(many)
        top[part] = a[first] + b[first] - part
        turn = np.flatnonzero((top[top] == np.arange(many)) & (np.arange(many) < top))  # two parts with the same edge
        top[turn] = turn
        while not np.array_equal(top, top[top]):
            top = top[top]
        names, top = np.unique(top, return_inverse=True)
        a, b, many = top[a], top[b], len(names)


def spanning(ids: np.ndarray, x: np.ndarray, core: np.ndarray, split: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimum spanning tree (w, u, v) of some rows, or of the pairs of the first `split` with the others: the trees of pairs of tiles hold it."""
    tiles = lambda a, b: [slice(i, min(i + TILE, b)) for i in range(a, b, TILE)]
    own = tiles(0, len(ids) if split is None else split)
    pairs = [(p, q) for k, p in enumerate(own) for q in own[k:]] if split is None else [(p, q) for p in own for q in tiles(split, len(ids))]
    w, u, v = np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for p, q in pairs:
        names = ids[p] if p is q else np.concatenate([ids[p], ids[q]])
        found = prim(names, reachability(x[p], x[q], core[p], core[q]), None if p is q else p.stop - p.start)
        w, u, v = (np.concatenate(c) for c in zip((w, u, v), found, strict=True))
        if len(pairs) > 1:
            keep = forest(w, u, v)
            w, u, v = w[keep], u[keep], v[keep]
    return w, u, v


def candidate_edges(rows: DataFrame, block: int = PAIR_BLOCK) -> tuple[DataFrame, int]:
    """(edges, blocks): the spanning trees of (id, v, core) within every block and between every two, which hold the whole table's tree.

    An edge of the tree lies in the part of the blocks of its ends, and is in the tree of any part that holds it. Blocks are
    as large as leave a few pairs for every core; a row is sent once for each block.
    """
    n = rows.count()
    size = min(block, max(LEAST_BLOCK, int(n / (8 * rows.sparkSession.sparkContext.defaultParallelism) ** 0.5)))
    blocks = max(1, -(-n // size))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    sent = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select("id", "v", "core", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        ids, core, side = (table[c].to_numpy() for c in ("id", "core", "own"))
        order = np.lexsort((ids, side))
        split = None if key[0].as_py() == key[1].as_py() else int(np.count_nonzero(side == side.min()))
        if split == len(ids):  # the other block is empty
            w, u, v = np.zeros(0), ids[:0], ids[:0]
        else:
            w, u, v = spanning(ids[order], x[order], core[order], split)
        return pa.table({"w": pa.array(w, pa.float64()), "u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return sent.repartition(blocks * (blocks + 1), "a", "b").groupBy("a", "b").applyInArrow(run, EDGE), blocks


def _forest(table: pd.DataFrame) -> pd.DataFrame:
    """One task: the edges (w, u, v) that join two nodes, or two parts (pu, pv), by their order."""
    columns = [table[c].to_numpy() for c in ("w", "u", "v", "pu", "pv") if c in table]
    return table.iloc[forest(*columns)][["w", "u", "v"]]


def spanning_tree(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """The minimum spanning forest of (w, u, v).

    Tasks take at most `local` edges each and keep the forest of these, as long as that leaves out a fifth of the edges; a
    forest of all holds only edges of theirs. If more than one task's are left then, Boruvka's rounds follow: every
    component takes its least edge outward. Parts are at least halved in a round; a round is one aggregate, connected components over the
    edges taken, and two joins. Once `local` edges between parts are left, one task takes what remains.
    """
    edges = cut(edges)
    many = edges.count()
    while True:
        groups = -(-many // local)
        group = F.lit(0) if groups <= 1 else F.pmod(F.xxhash64("u", "v"), F.lit(groups))
        kept = edges.withColumn("group", group).groupBy("group").applyInPandas(lambda t: _forest(t), EDGE)
        if groups <= 1:
            return kept
        edges, before = cut(kept), many
        many = edges.count()
        if many > local and many > 0.8 * before:
            break
    names = cut(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("part", F.col("node")))
    tree = None
    while True:
        named = edges.join(names.select(F.col("node").alias("u"), F.col("part").alias("pu")), "u").join(names.select(F.col("node").alias("v"), F.col("part").alias("pv")), "v")
        out = cut(named.where("pu <> pv").select("w", "u", "v", "pu", "pv"))
        if out.count() <= local:
            last = out.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda t: _forest(t), EDGE)
            return last if tree is None else tree.union(last)
        least = out.select(F.explode(F.array("pu", "pv")).alias("part"), F.struct("w", "u", "v", "pu", "pv").alias("e")).groupBy("part").agg(F.min("e").alias("e"))
        taken = cut(least.select("e.*").distinct())
        tree = taken.select("w", "u", "v") if tree is None else tree.union(taken.select("w", "u", "v"))
        joined = components(taken, "pu", "pv")
        names = cut(names.join(joined.select(F.col("node").alias("part"), "component"), "part", "left").select("node", F.coalesce("component", "part").alias("part")))
        edges = out.select("w", "u", "v")


def _merges(table: pd.DataFrame) -> pd.DataFrame:
    """One task: (node, left, right, w, size) of the merges of a forest's edges by their order. The ends are nodes with sizes."""
    table = table.sort_values("eid")
    top: dict[int, int] = {}
    size: dict[int, int] = {}

    def find(a: int) -> int:
        while top.get(a, a) != a:
            top[a] = top.get(top[a], top[a])
            a = top[a]
        return a

    out = []
    for eid, w, u, v, su, sv in table[["eid", "w", "u", "v", "su", "sv"]].itertuples(index=False):
        a, b = find(int(u)), find(int(v))
        eid = int(eid)
        size[eid] = size.get(a, int(su)) + size.get(b, int(sv))
        top[a] = top[b] = top[eid] = eid
        out.append((eid, a, b, float(w), size[eid]))
    return pd.DataFrame(out, columns=["node", "left", "right", "w", "size"])


def dendrogram(tree: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, left, right, w, size): the single-linkage merges of a tree (w, u, v) over rows u, v >= 0.

    Edges get numbers in the order (w, u, v); a merge's node is its edge's number, a row's is -1 - row. A tree of more than
    `local` edges is split at its median edge: the lower half falls into parts that merge by themselves, the upper half
    merges these parts, each of which has its last edge as its node. So every problem fits a task, after as many rounds
    as the number of edges halves.
    """
    ordered = cut(tree.orderBy("w", "u", "v").withColumn("eid", F.monotonically_increasing_id()))
    one = F.lit(1).cast("long")
    open_ = ordered.select(F.lit(-1).cast("long").alias("problem"), "eid", "w", (-1 - F.col("u")).alias("u"), (-1 - F.col("v")).alias("v"), one.alias("su"), one.alias("sv"))
    done = None
    while True:
        sizes = cut(open_.groupBy("problem").agg(F.count("*").alias("n"), F.percentile_approx("eid", 0.5).alias("middle")))
        met = open_.join(sizes, "problem")
        fits = met.where(F.col("n") <= local).drop("n", "middle")
        done = fits if done is None else done.unionByName(fits)
        large = cut(met.where(F.col("n") > local))
        if large.isEmpty():
            break
        low = large.where("eid <= middle")
        ends = low.select("problem", "eid", F.col("u").alias("node"), F.col("su").alias("size")).union(low.select("problem", "eid", "v", "sv"))
        parts = components(low, "u", "v")
        found = ends.join(parts, "node").withColumnRenamed("component", "part")
        roots = found.groupBy("problem", "part").agg(F.max("eid").alias("root"))
        sums = found.select("problem", "part", "node", "size").distinct().groupBy("problem", "part").agg(F.sum("size").alias("size"))
        known = cut(found.select("problem", "part", "node").distinct().join(roots, ["problem", "part"]).join(sums, ["problem", "part"]).select("problem", "node", "root", "size"))
        lower = low.join(known.select("problem", F.col("node").alias("u"), F.col("root").alias("own")), ["problem", "u"]).drop("problem").withColumnRenamed("own", "problem")
        upper = large.where("eid > middle")
        for end, size in (("u", "su"), ("v", "sv")):
            upper = upper.join(known.select("problem", F.col("node").alias(end), F.col("root").alias("_r"), F.col("size").alias("_s")), ["problem", end], "left")
            upper = upper.withColumns({end: F.coalesce("_r", end), size: F.coalesce("_s", size)}).drop("_r", "_s")
        columns = ["problem", "eid", "w", "u", "v", "su", "sv"]
        open_ = cut(lower.select(*columns).union(upper.select(*columns)))
    return done.groupBy("problem").applyInPandas(lambda t: _merges(t), "node long, left long, right long, w double, size long")


def _lifted(table: pd.DataFrame) -> pd.DataFrame:
    """One task: lifted()."""
    table = table.sort_values("node")
    node, up = table["node"].to_numpy(), table["up"].to_numpy()
    place = np.minimum(np.searchsorted(node, up), len(node) - 1)
    last = np.where(node[place] == up, place, np.arange(len(node)))
    while not np.array_equal(last, last[last]):
        last = last[last]
    return pd.DataFrame({"node": node, "top": up[last]})


def lifted(parents: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, top): follows (node, up) until an `up` that is no node; each round doubles the steps. One task takes up to `local` nodes."""
    ends = cut(parents.select("node", F.col("up").alias("top")))
    if ends.count() <= local:
        return ends.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda t: _lifted(t.rename(columns={"top": "up"})), "node long, top long")
    while True:
        further = ends.select(F.col("node").alias("top"), F.col("top").alias("_t"))
        met = cut(ends.join(further, "top", "left").select("node", F.coalesce("_t", "top").alias("top"), F.col("_t").isNotNull().alias("moved")))
        ends = met.select("node", "top")
        if met.where("moved").isEmpty():
            return ends


def condensed(merges: DataFrame, least: int, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """(clusters, nodes) of a dendrogram, in which groups of fewer than `least` rows are no clusters but rows that fall out.

    clusters: cluster (its first node), parent (null at the root), stability. nodes: node (of at least `least` rows) and
    its cluster. A node both of whose sides have `least` rows splits its cluster in two. Stability sums, over a
    cluster's rows, the density 1 / w at which a row leaves or the cluster splits, less that at which it was born.
    """
    big = cut(merges.where(F.col("size") >= least).withColumn("density", 1 / F.greatest("w", F.lit(LEAST_WEIGHT))))
    sides = big.select(F.col("node").alias("up"), F.explode(F.array("left", "right")).alias("node"))
    up = big.join(sides, "node", "left").select("node", "up", "size", "density")
    below = up.groupBy(F.col("up").alias("node")).agg(F.count("*").alias("sides"), F.sum("size").alias("held")).where("node is not null")
    tree = cut(up.join(below, "node", "left").select("node", "up", "size", "density", F.coalesce("sides", F.lit(0)).alias("sides"), F.coalesce("held", F.lit(0)).alias("held")))
    splits = tree.where("sides = 2").select(F.col("node").alias("up"), F.col("density").alias("birth"))
    met = tree.join(splits, "up", "left")
    first = met.where("up is null or birth is not null").select(F.col("node").alias("cluster"), "up", F.coalesce("birth", F.lit(0.0)).alias("birth"))
    chained = lifted(met.where("up is not null and birth is null").select("node", "up"), local)
    nodes = cut(first.select(F.col("cluster").alias("node"), "cluster").union(chained.select("node", F.col("top").alias("cluster"))))
    born = tree.join(nodes, "node").join(first.select("cluster", "birth"), "cluster")
    leaving = F.when(F.col("sides") == 2, F.col("size")).otherwise(F.col("size") - F.col("held"))
    stable = born.groupBy("cluster").agg(F.sum(leaving * (F.col("density") - F.col("birth"))).alias("stability"))
    parents = first.join(nodes.select(F.col("node").alias("up"), F.col("cluster").alias("parent")), "up", "left")
    return cut(parents.join(stable, "cluster").select("cluster", "parent", "stability")), nodes


def _chosen(table: pd.DataFrame) -> pd.DataFrame:
    """One task: chosen(). A cluster is a node of the dendrogram, so its number is larger than those of the clusters inside it."""
    table = table.sort_values("cluster")
    rows = [(int(c), None if pd.isna(p) else int(p), float(s)) for c, p, s in table[["cluster", "parent", "stability"]].itertuples(index=False)]
    inner: dict[int, float] = {}
    taken = set()
    for cluster, parent, stability in rows:
        within = inner.pop(cluster, 0.0)
        if parent is not None:
            if stability >= within:
                taken.add(cluster)
            inner[parent] = inner.get(parent, 0.0) + max(stability, within)
    topic: dict[int, int] = {}
    for cluster, parent, _ in reversed(rows):  # the outermost chosen cluster counts
        if parent in topic:
            topic[cluster] = topic[parent]
        elif cluster in taken:
            topic[cluster] = cluster
    return pd.DataFrame({"cluster": list(topic), "topic": list(topic.values())}, dtype="int64")


def chosen(clusters: DataFrame, local: int = LOCAL) -> DataFrame:
    """(cluster, topic): for each cluster the chosen one that holds it, if any. A cluster is chosen over those inside it if
    its stability is at least the sum of theirs; the root never is.

    One task takes up to `local` clusters, as a tree of them may be as deep as it is large. More of them go in rounds from
    the leaves up: a cluster is settled when all its children are.
    """
    if clusters.count() <= local:
        return clusters.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda t: _chosen(t), "cluster long, topic long")
    children = clusters.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("waits"))
    open_ = cut(clusters.join(children, "cluster", "left").select("cluster", "parent", "stability", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(0.0).alias("inner")))
    settled = None
    while True:
        ready = open_.where("waits = 0")
        best = ready.select("cluster", "parent", F.greatest("stability", "inner").alias("best"), (F.col("parent").isNotNull() & (F.col("stability") >= F.col("inner"))).alias("taken"))
        best = cut(best)
        if best.isEmpty():
            break
        settled = best if settled is None else settled.union(best)
        told = best.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("_k"), F.sum("best").alias("_s"))
        rest = open_.where("waits > 0").join(told, "cluster", "left")
        open_ = cut(rest.select("cluster", "parent", "stability", (F.col("waits") - F.coalesce("_k", F.lit(0))).alias("waits"), (F.col("inner") + F.coalesce("_s", F.lit(0.0))).alias("inner")))
    if settled is None:
        return clusters.select("cluster", F.col("cluster").alias("topic")).limit(0)
    # the outermost chosen cluster counts: walk up to the root, and keep the last chosen on the way
    paths = cut(settled.select("cluster", F.col("parent").alias("at"), F.when(F.col("taken"), F.col("cluster")).alias("topic")))
    while True:
        step = paths.select(F.col("cluster").alias("at"), F.col("at").alias("_at"), F.col("topic").alias("_topic"))
        met = cut(paths.join(step, "at", "left").select("cluster", F.col("_at").alias("at"), F.coalesce("_topic", "topic").alias("topic")))
        paths = met
        if met.where("at is not null").isEmpty():
            return paths.where("topic is not null").select("cluster", "topic")


def density_topics(df: DataFrame, least: int = 10, samples: int | None = None, id_col: str = "doc_id", vector: str = "embedding", block: int = PAIR_BLOCK, local: int = LOCAL) -> DataFrame:
    """(id, topic): clusters of at least `least` rows by density, numbered from 0 by falling size (ties by smallest id); noise is -1.

    1. The core distance of a row is that to its `samples`-th nearest other row (default: `least`), by nearest().
    2. The mutual reachability distance of two rows is the largest of their distance and their core distances. Its minimum
       spanning tree comes from the trees of all pairs of blocks, of which spanning_tree() keeps the least edges.
    3. The tree's merges in order of their distance are the hierarchy, found by halves (dendrogram()).
    4. The condensed tree keeps splits into groups of `least` rows; clusters are chosen by stability, never the root.

    Exact: all pairs of rows are compared, in blocks; no matrix and no list of rows passes the driver. Work grows with the
    square of the rows, so a corpus is deduplicated or sampled to what topics need first.

    Distances are rounded to nine decimals, and equal ones ordered by the smaller ids, so that the result is the same for
    any partitioning. Rows without an id or a usable vector are not in the result; rows that share an id and a vector are
    one row; a table of fewer than two rows is noise.
    """
    samples = samples or least
    # ids may be negative or far apart; the hierarchy needs rows from 0 on
    rows = vectors_of(df, id_col, vector, dim_of(df, vector)).dropDuplicates(["id"])
    rows = cut(rows.orderBy("id").withColumn("row", F.monotonically_increasing_id()))
    points = rows.select(F.col("row").alias("id"), "v")
    core = nearest(points, points, samples, "euclidean", others=True).groupBy(F.col("seed").alias("id")).agg(F.max("far").alias("core"))
    edges, blocks = candidate_edges(cut(points.join(core, "id")), block)
    tree = edges if blocks == 1 else spanning_tree(edges, FOREST * local)
    merges = cut(dendrogram(tree, local))
    clusters, nodes = condensed(merges, least, local)
    topics = nodes.join(chosen(clusters, local), "cluster").select("node", "topic")

    # a row falls out of the first node above it that has `least` rows
    sides = merges.select(F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("up"), "size")
    small = sides.join(merges.select("node", F.col("size").alias("own")), "node", "left").where((F.col("node") < 0) | (F.col("own") < least))
    tops = lifted(small.select("node", "up"), local).where("node < 0")
    placed = rows.join(tops.select((-1 - F.col("node")).alias("row"), F.col("top").alias("node")), "row", "left").join(topics, "node", "left")
    placed = cut(placed.select("id", "topic"))
    order = placed.where("topic is not null").groupBy("topic").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    order = order.select("topic", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("number"))
    return placed.join(order, "topic", "left").select(F.col("id").alias(id_col), F.coalesce("number", F.lit(-1)).cast("int").alias("topic"))
