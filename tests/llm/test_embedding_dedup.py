from collections import Counter

import numpy as np
import pytest

from textloom.llm.embedding_dedup import embedding_dedup, plan_tables

SCHEMA = "vec_id long, embedding array<float>, label int, node long, mult int, component string"


def vectors():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            base = rng.standard_normal(16)
            for k in range(rng.integers(1, 5)):
                v = base + rng.standard_normal(16) * 0.07 * k
                rows.append((n, [float(x) for x in np.float32(v)], label))
                n += 1
    same = rows[3][1]
    rows += [(n + i, same, rows[3][2]) for i in range(20)]
    rows += [(5000, same, None), (5001, None, 1), (5002, [0.0] * 16, 1), (5003, [float("nan")] * 16, 1), (5004, [float("inf")] + [1.0] * 15, 1), (5005, [None] + [1.0] * 15, 1), (5006, [], 1), (None, same, rows[3][2]), (5007, [1.0] * 8, 1), (5008, [2.0] * 8, 1), (5009, same, 2 if rows[3][2] != 2 else 0)]
    return rows


def brute(rows):
    ok = {i: np.array(v, dtype=np.float64) for i, (d, v, label) in enumerate(rows) if d is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links, root = Counter(), {r[0]: r[0] for r in rows}
    for _ in range(6):
        for i in ok:
            for j in ok:
                if i < j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    root[rows[i][0]] = root[rows[j][0]] = min(root[rows[i][0]], root[rows[j][0]])
    return sorted([(r[0], links[i] // 6, root[r[0]], r[0] is None or r[0] == root[r[0]]) for i, r in enumerate(rows)], key=str)


@pytest.mark.parametrize("block", [4096, 7])
def test_against_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], SCHEMA)
    assert sorted(map(tuple, embedding_dedup(df, block=block).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert embedding_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tables_grow_slowly():
    assert plan_tables(5000)[1] < plan_tables(10**9)[1] < 1000


def test_magnitudes_and_repeated_ids(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i, scale in enumerate([1e200, 1e200, 1e-200, 1e300, 1.0, 5e-320]):
        v = np.ones(8) + rng.standard_normal(8) * 0.001
        rows.append((i, [float(x) for x in v * scale], 1))
    rows += [(0, [float(x) for x in rng.standard_normal(8)], 1), (0, [1.0] * 8, 2), (9, [2.0] * 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted(map(tuple, embedding_dedup(df).collect()))
    assert found == sorted([(i, 5, 0, i == 0) for i in range(6)] + [(0, 0, 0, True), (0, 1, 0, True), (9, 1, 0, False)])
