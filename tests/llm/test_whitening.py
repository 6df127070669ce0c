from collections import defaultdict

import numpy as np
import pytest

from textloom.llm.whitening import rotations, whiten

SCHEMA = "vec_id long, embedding array<double>, label int, n string, deviation int"


def integers(rows, dims):
    return [(d, [int(np.floor(64.0 * c)) + 1_000_000 for c in v]) for d, v in rows if v and len(v) == dims and all(c is not None and np.isfinite(c) and abs(c) < 2.0**40 for c in v)]


def check(found, rows, dims, components=32, rank=None):
    """Rows against exact integers and numpy's eigenvectors."""
    fit = integers(rows, dims)
    n = len(fit)
    sums = [sum(x[i] for _, x in fit) for i in range(dims)]
    centred = np.array([[(n * x[i] - sums[i]) / n for i in range(dims)] for _, x in fit])
    deviations = sorted((d is None, d or 0, sum((n * x[i] - sums[i]) ** 2 for i in range(dims))) for d, x in fit)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    e = s**2 / n
    expected = rank if rank is not None else min(components, dims)
    by = defaultdict(list)
    for r in found:
        by[r.component].append(r)
    assert sorted(by) == list(range(1, expected + 1))
    for rs in by.values():
        assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in rs) == deviations
    trace = (centred**2).sum() / n
    for k, rs in by.items():
        assert {r.n for r in rs} == {n}
        assert rs[0].explained == pytest.approx(e[k - 1] / trace, rel=1e-9)
        assert rs[0].identity_error < 1e-9
        mine = np.sort([r.whitened for r in rs])
        theirs = centred @ vt[k - 1] / np.sqrt(e[k - 1])
        assert min(np.abs(mine - np.sort(theirs)).max(), np.abs(mine - np.sort(-theirs)).max()) < 1e-6
    return by


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    mixed = rng.standard_normal((10, 10)) * np.arange(1, 11)
    rows = [(i, [float(c) for c in rng.standard_normal(10) @ mixed]) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (301, None), (302, []), (303, [float("nan")] * 10), (304, [float("-inf")] + [0.0] * 9), (305, [None] + [0.0] * 9), (306, [1.0] * 4), (307, [1e300] + [0.0] * 9)]
    df = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], SCHEMA)
    check(whiten(df).collect(), rows, 10)
    assert {r.component for r in whiten(df, components=3).collect()} == {1, 2, 3}


def test_graded_and_flat_directions(spark):
    """Variances that differ by 10^16 beside a constant and a repeated dimension."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((400, 5)) * np.array([1e8, 1e6, 1e4, 100, 1])
    base[:, 4] += base[:, 0] * 1e-8
    values = np.concatenate([base, np.full((400, 1), 3.5), np.floor(base[:, 3:4])], axis=1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(values)]
    found = whiten(spark.createDataFrame([(*r, 1, "n", 2) for r in rows], SCHEMA)).collect()
    n = len(rows)
    assert {r.n for r in found} == {n}
    assert max(r.component for r in found) == 6
    assert found[0].identity_error < 1e-6
    by = defaultdict(list)
    for r in found:
        by[r.component].append((r.vec_id, r.whitened))
    matrix = np.array([[w for _, w in sorted(by[k])] for k in sorted(by)])
    assert np.abs(matrix @ matrix.T / n - np.eye(len(matrix))).max() < 1e-6


def test_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        df = whiten(spark.createDataFrame([(*r, 1, "n", 2) for r in rows], SCHEMA))
        assert df.collect() == []
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_rotations_of_a_graded_matrix():
    d = np.diag([1e12, 1.0, 1e-12])
    mixed = np.array([[1, 0.3, 0.2], [0.3, 1, 0.1], [0.2, 0.1, 1]])
    e, v = rotations(d @ mixed @ d)
    assert np.allclose(v @ v.T, np.eye(3), atol=1e-12)
    assert np.isclose(np.prod(e / np.diag(d) ** 2), np.linalg.det(mixed), rtol=1e-9)


def test_whole_table(spark):
    """The registered query on sf0.001: every vector, against numpy."""
    from textloom.llm.queries import op12_whitening

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op12_whitening(spark, sf).collect(), rows, 64)
