import numpy as np
import pytest

from textloom.operators import density
from textloom.operators.neighbours import nearest, vectors_of


def textbook(ids, x, least, samples):
    """Hierarchical density clustering of a small table, by the definitions: labels by id."""
    n = len(ids)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    core = np.array([np.sort(np.delete(d[i], i))[min(samples, n - 1) - 1] for i in range(n)])
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    edges = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    part = {i: {i} for i in range(n)}  # root -> rows
    where = list(range(n))
    nodes, node_of = {}, {i: None for i in range(n)}
    for w, i, j in edges:
        a, b = where[i], where[j]
        if a != b:
            k = len(nodes)
            nodes[k] = (w, node_of[a], node_of[b], frozenset(part[a]), frozenset(part[b]))
            part[a] |= part.pop(b)
            for r in part[a]:
                where[r] = a
            node_of[a] = k
    out = {}

    def stable(node, birth, rows):
        """(stability, chosen row sets) of the cluster that begins at a node."""
        total = 0.0
        while True:
            w, left, right, a, b = nodes[node]
            rho = 1 / max(w, density.LEAST_WEIGHT)
            if len(a) >= least and len(b) >= least:
                total += (len(a) + len(b)) * (rho - birth)
                inner = [stable(left, rho, a), stable(right, rho, b)]
                best = sum(s for s, _ in inner)
                return (total, [rows]) if total >= best else (best, inner[0][1] + inner[1][1])
            if len(a) < least and len(b) < least:
                return total + (len(a) + len(b)) * (rho - birth), [rows]
            total += min(len(a), len(b)) * (rho - birth)
            node = left if len(a) >= least else right

    if n >= least and n > 1:
        node = len(nodes) - 1
        found = []
        while True:
            w, left, right, a, b = nodes[node]
            if len(a) >= least and len(b) >= least:
                rho = 1 / max(w, density.LEAST_WEIGHT)
                found = stable(left, rho, a)[1] + stable(right, rho, b)[1]
                break
            if len(a) < least and len(b) < least:
                break
            node = left if len(a) >= least else right
        found.sort(key=lambda rows: (-len(rows), min(ids[r] for r in rows)))
        out = {ids[r]: k for k, rows in enumerate(found) for r in rows}
    return {i: out.get(i, -1) for i in ids}


def clouds(seed, n=160, dims=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 6
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dims)) * rng.choice([0.3, 1.0, 2.0], n)[:, None]
    x[: n // 8] = rng.normal(size=(n // 8, dims)) * 12  # noise
    x[-12:] = x[-1]  # a heap of equal rows
    return x


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r], "t") for i, r in zip(ids, x, strict=True)], "doc_id long, embedding array<double>, topic string")


@pytest.mark.parametrize(("seed", "least", "samples", "block", "local"), [(1, 8, None, 2048, 200_000), (2, 5, 3, 90, 100)])
def test_equals_the_textbook(spark, seed, least, samples, block, local):
    x = clouds(seed)
    ids = np.random.default_rng(seed).permutation(len(x)) * 7 - 300
    order = np.argsort(ids)
    found = {r.doc_id: r.topic for r in density.density_topics(frame(spark, ids, x), least, samples, block=block, local=local).collect()}
    want = textbook([int(i) for i in ids[order]], x[order], least, samples or least)
    assert found == want
    assert len(set(want.values())) > 3


def test_small_tables(spark):
    empty = frame(spark, [], np.zeros((0, 2)))
    assert density.density_topics(empty, 3).collect() == []
    df = frame(spark, [1, 2], np.array([[0.0, 1.0], [1.0, 0.0]])).union(spark.createDataFrame([(3, None, "t"), (None, [1.0, 2.0], "t"), (4, [float("nan"), 1.0], "t")], empty.schema))
    assert sorted(map(tuple, density.density_topics(df, 3).collect())) == [(1, -1), (2, -1)]


@pytest.mark.parametrize(("metric", "others"), [("euclidean", True), ("cosine", False)])
def test_nearest_by_blocks(spark, metric, others):
    x = np.concatenate([clouds(5, 90), np.zeros((2, 3)), clouds(5, 90)[:20] + 1e-7])
    points = vectors_of(frame(spark, range(len(x)), x), "doc_id", "embedding", 3)
    if metric == "euclidean":
        far = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    else:
        u = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
        far = -np.round(u @ u.T, 6)
    if others:
        np.fill_diagonal(far, np.inf)
    for block, stripes in ((4096, None), (7, 5)):
        found = nearest(points, points, 4, metric, others, block, stripes).orderBy("seed", "place").collect()
        for i in range(len(x)):
            want = sorted((far[i, j], j) for j in range(len(x)) if far[i, j] < np.inf)[:4]
            assert [(round(r.far, 6), r.pool) for r in found if r.seed == i] == [(round(float(d), 6), j) for d, j in want]


def test_forest_of_sparse_edges(spark):
    """Boruvka's rounds against Kruskal's method on a graph of several parts."""
    rng = np.random.default_rng(3)
    edges = {(round(float(rng.integers(0, 30)), 1), *sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(150)}
    tops = list(range(60))
    find = lambda a: a if tops[a] == a else find(tops[a])
    want = []
    for w, u, v in sorted(edges):
        if find(u) != find(v):
            tops[find(u)] = find(v)
            want.append((w, u, v))
    found = density.spanning_tree(spark.createDataFrame(sorted(edges), density.EDGE), local=100).collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_whole_query(spark):
    """The registered query on sf0.01: every vector, against the definitions."""
    from textloom.plans.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    want = textbook([i for i, _ in rows], np.array([v for _, v in rows], dtype=np.float64), 10, 2)
    assert {r.vec_id: r.topic for r in QUERIES["density_topics"](spark, sf).collect()} == want
