import random

import pytest

from textloom.llm.blocks import star_edges
from textloom.llm.components import block_pairs, deal
from textloom.operators import graph
from textloom.operators.graph import components


def test_hot_keys_are_dealt_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 4)
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(60), i, "t" * (i % 3)) for i in range(3000)]
    sizes = {}
    for k, *_ in rows:
        sizes[k] = sizes.get(k, 0) + 1
    left = spark.createDataFrame([*rows, (None, -1, "null"), (99, -2, "no partner")], "key long, i long, text string")
    known = spark.createDataFrame([(k, n, k * 10) for k, n in sizes.items()], "key long, n long, value long")
    found = graph.meet(left, known, "key", "n", len(rows))
    assert found.columns == ["key", "i", "text", "value"]
    assert sorted(map(tuple, found.collect())) == sorted((k, i, t, k * 10) for k, i, t in rows)
    assert graph.meet(left.limit(0), known, "key", "n", 0).collect() == []


@pytest.mark.parametrize("least", [3, 256])
def test_components_with_hot_nodes(spark, monkeypatch, least):
    monkeypatch.setattr(graph, "HOT", least)
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 900)] + [(5000 + rng.randrange(300), 5000 + rng.randrange(300)) for _ in range(250)] + [(9000, 9000), (None, 1), (2, None)]
    root = {n: n for e in edges for n in e if n is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {n: find(n) for n in root if any(n in e and e[0] != e[1] and None not in e for e in edges)}


def test_stars_of_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 3)
    rows = [(i, [7, 100 + i, 200 + i // 2]) for i in range(100)] + [(500, None), (501, []), (502, [9, 9]), (3, [7])]
    found = {tuple(r) for r in star_edges(spark.createDataFrame([(*r, "x") for r in rows], "node long, keys array<long>, key string")).collect()}
    assert found == {(i, 0) for i in range(1, 100)} | {(i, i - 1) for i in range(1, 100, 2)}
    assert star_edges(spark.createDataFrame([], "node long, keys array<long>")).collect() == []


def test_blocks_are_bounded_by_members_and_weight(spark):
    rows = [(i, 0, 1) for i in range(100)] + [(1000 + i, 1, 50) for i in range(20)] + [(2000, 2, 10_000)]
    dealt = deal(spark.createDataFrame(rows, "node long, component long, weight long"), 30, "weight", 200)
    assert {(r.component, r.n_blocks) for r in dealt.collect()} == {(0, 4), (1, 5), (2, 50)}
    pairs = {}
    for r in block_pairs(dealt).collect():
        assert r.bi <= r.bj and (r.side == 0 or r.bi < r.bj)
        pairs.setdefault((r.component, r.bi, r.bj), set()).add(r.node)
    for c in (0, 1):
        nodes = [n for n, k, _ in rows if k == c]
        together = {frozenset((a, b)) for (k, _, _), own in pairs.items() if k == c for a in own for b in own if a != b}
        assert len(together) == len(nodes) * (len(nodes) - 1) // 2
