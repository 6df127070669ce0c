import numpy as np
import pytest

from textloom.llm.top_k_search import Index, exact_top_k

SCHEMA = "vec_id long, embedding array<double>, label int, row long, x string, score int"
QUERIES = "vec_id % 10 = 0"


def vectors():
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((6, 12))
    rows = [(i, [float(v) for v in centres[i % 6] * (i % 3) + rng.standard_normal(12) * 0.2]) for i in range(400)]
    same = rows[10][1]
    rows += [(400 + i, same) for i in range(130)]  # ties, a third of all rows
    rows += [(10, same), (10, same), (20, rows[33][1])]  # repeated rows, and an id of two vectors
    rows += [(600, None), (610, []), (620, [float("nan")] * 12), (630, [float("inf")] + [0.0] * 11), (640, [None] + [0.0] * 11), (None, same), (650, [1e300] * 12)]
    rows += [(700, [0.0] * 12), (710, [-0.0001] * 12), (720, [1e5] * 12), (800, [1.0, 2.0]), (810, [2.0, -1.0]), (811, [3.0, 3.0])]
    return rows


def brute(rows, k):
    usable = [(d, np.floor(np.array(v, dtype=np.float64) * 1024).astype(object)) for d, v in rows if d is not None and v and all(c is not None and np.isfinite(c) and abs(c) < 1e5 + 1 for c in v)]
    out = []
    for i, (d, q) in enumerate(usable):
        if d % 10 == 0:
            found = sorted((-int(q @ x), e, j) for j, (e, x) in enumerate(usable) if j != i and len(x) == len(q))[:k]
            out += [(d, n + 1, e, -s) for n, (s, e, _) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("k", "shard", "block"), [(10, 8192, 4096), (10, 60, 7), (1, 100, 4096), (600, 100, 4096)])
def test_against_brute_force(spark, k, shard, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA)
    assert sorted(map(tuple, exact_top_k(df, QUERIES, k, shard=shard, block=block).collect())) == brute(rows, k)


def test_stops_on_proof_only():
    """Whatever the weights, bounds, magnitudes and ties: the rows of a full scan."""
    rng = np.random.default_rng(2)
    for case in range(60):
        n, dims = int(rng.integers(1, 900)), int(rng.integers(1, 20))
        x = rng.integers(-(10 ** int(rng.integers(0, 6))), 10 ** int(rng.integers(0, 6)) + 1, (n, dims))
        x[rng.random(n) < 0.3] = x[0]
        q = x[0] * int(rng.integers(-1, 2)) if case % 5 == 0 else rng.integers(-2000, 2000, dims)
        score = x.astype(object) @ q.astype(object)
        want = sorted((-s, i) for i, s in enumerate(score) if i != 3)[:5]
        for least in (None, -want[-1][0] if len(want) == 5 else None):
            found = Index(x.astype(np.int32), np.arange(n), np.arange(n), 6).search(q.astype(np.int64), 5, least, 3)
            assert [(-s, i) for i, _, s in found] == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_top_k(empty, QUERIES).collect() == []
    assert exact_top_k(spark.createDataFrame([(1, [1.0], 1, 2, "x", 3), (2, [1.0], 1, 2, "x", 3)], SCHEMA), QUERIES).collect() == []
