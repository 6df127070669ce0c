"""Findings of round 4."""

import numpy as np
import pyarrow as pa
import pytest

from textloom.operators import cooccurrence, density
from textloom.operators.neighbours import exact_distance


def test_deep_cluster_trees_take_few_jobs(spark):
    """Clusters may lie in each other as deep as there are many: no job for every level; the rounds give the same."""
    n = 12
    rows = [(2 * k + 1, 2 * k + 3 if k + 1 < n else None, 5.0 - k % 3) for k in range(n)] + [(2 * k, 2 * k + 1, 1.0 + k % 2) for k in range(n)]
    clusters = spark.createDataFrame(rows, "cluster long, parent long, stability double")
    context = spark.sparkContext
    context.setJobGroup("deep", "")
    found = sorted(map(tuple, density.chosen(clusters).collect()))
    context.setJobGroup("", "")
    assert len(context.statusTracker().getJobIdsForGroup("deep")) < 10
    assert found == sorted(map(tuple, density.chosen(clusters, local=0).collect())) and found
    chain = spark.createDataFrame([(k, k + 1) for k in range(50)], "node long, up long")
    assert sorted(map(tuple, density.lifted(chain).collect())) == [(k, 50) for k in range(50)] == sorted(map(tuple, density.lifted(chain, local=0).collect()))


@pytest.mark.parametrize(("scale", "digits"), [(1.0, 1), (1e-7, 9), (1e4, 0)])
def test_trees_of_tiles(monkeypatch, scale, digits):
    """Distances by a product equal exact ones, near copies and ties included; trees of tiles hold the tree of all pairs."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(150, 5)), 1) * scale
    x[100:] = x[:50] + rng.choice([0, 1e-9, 1e-5], (50, 1))
    core, ids = np.round(rng.random(150) * scale, digits), rng.permutation(150) * 3
    want = np.maximum(np.maximum(np.stack([exact_distance(x, np.broadcast_to(r, x.shape)) for r in x]), core[:, None]), core)
    assert np.array_equal(density.reachability(x, x, core, core), want)
    monkeypatch.setattr(density, "TILE", 20)
    low, high = np.minimum(ids[:, None], ids), np.maximum(ids[:, None], ids)
    for split in (None, 60):
        some = low < high if split is None else np.outer(np.arange(150) < split, np.arange(150) >= split)
        edges = sorted(set(zip(want[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True)))
        top = {int(i): int(i) for i in ids}
        find = lambda a: a if top[a] == a else find(top[a])  # noqa: B023, E731
        tree = []
        for w, u, v in edges:
            if find(u) != find(v):
                top[find(u)] = find(v)
                tree.append((w, u, v))
        assert sorted(zip(*map(np.ndarray.tolist, density.spanning(ids, x, core, split)), strict=True)) == tree


def test_forest_by_rounds(spark):
    """A table whose forest no task holds goes by Boruvka's rounds."""
    rng = np.random.default_rng(5)
    edges = sorted({(float(rng.integers(0, 9)), *sorted(map(int, rng.choice(40, 2, replace=False)))) for _ in range(120)})
    w, u, v = (np.array(c) for c in zip(*edges, strict=True))
    found = density.spanning_tree(spark.createDataFrame(edges, density.EDGE), local=15).collect()
    assert sorted(map(tuple, found)) == [edges[k] for k in density.forest(w, u, v)]


def test_pairs_are_sent_packed_and_come_in_runs(spark):
    """Codes go as packed differences, and a task's pairs stand by their rarer term, its side, and the documents of the other."""
    rng = np.random.default_rng(6)
    lists = [np.sort(rng.choice(40_000, 400, replace=False)) for _ in range(300)]
    bounds = [0, 20_000, 40_000]
    sent = list(cooccurrence._dealt(bounds)(iter([pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in lists], pa.list_(pa.int32()))], ["codes"])])))
    size = sum(len(x) for b in sent for c in ("lows", "highs") for x in b.column(b.schema.get_field_index(c)).to_pylist())
    assert size < 2 * 1.75 * 300 * 400  # each code twice, in two bytes before
    docs = spark.createDataFrame([(k, [f"t{c}" for c in rng.choice(30, 12, replace=False)]) for k in range(80)], "doc_id long, tokens array<string>")
    found = cooccurrence.document_pairs(docs, 1, blocks=1).toPandas()
    brute = {(r.a, r.b): r.co for r in found.itertuples()}
    rows = [set(r.tokens) for r in docs.collect()]
    assert brute == {(a, b): n for a in found.a.unique() for b in found.b.unique() if a < b and (n := sum({a, b} <= r for r in rows))}
    changes = sum(a != c and b != d for a, b, c, d in zip(found.a[1:], found.b[1:], found.a, found.b, strict=False))
    assert changes < 3 * 30  # a term's pairs stand together, those where it is the first before the others or behind them


def test_keyword_weights_are_added_in_tasks(spark):
    """A task sends one row for each group and term, not for each document; n-grams skip nulls, groups may be null."""
    rng = np.random.default_rng(7)
    rows = [(k, [None, "x", "y"][k % 3], [None if w == 9 else f"w{w}" for w in rng.integers(0, 10, int(rng.integers(0, 9)))]) for k in range(60)] + [(60, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, pool string, tokens array<string>")
    terms = [(g, [*(t or []), *(" ".join(w for w in p if w is not None) for p in zip(t or [], (t or [])[1:], strict=False))]) for _, g, t in rows]
    df = {w: sum(w in t for _, t in terms) for w in {w for _, t in terms for w in t if w is not None}}
    df = {w: n for w, n in df.items() if n >= 2}
    want = {}
    for g, t in terms:
        tf = {w: t.count(w) for w in set(t) if w in df}
        weight = {w: n * (np.log((1 + len(rows)) / (1 + df[w])) + 1) for w, n in tf.items()}
        length = sum(x * x for x in weight.values()) ** 0.5
        for w, x in weight.items():
            want[g, w] = want.get((g, w), 0) + round(x / length, 6)
    sent = cooccurrence.tfidf(docs, 2, grams=2, carry=("pool",), parts=2, by="pool").collect()
    found = {}
    for r in sent:
        found[r.pool, r.term] = found.get((r.pool, r.term), 0) + r.weight / 1e6
    assert found == {k: pytest.approx(v, abs=2e-5) for k, v in want.items()} and len(sent) <= 2 * len(want)
    assert cooccurrence._millionths(np.array([0.0000005, 0.0000015, 0.1234567])).tolist() == [0, 2, 123457]
