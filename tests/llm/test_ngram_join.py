import random
import re
from collections import Counter

import numpy as np
import pytest

from textloom.llm.ngram_join import Comparer, band_keys, drop_near_copies, least_matches, minhash, ngram_join, shingles
from textloom.operators.graph import components


def sets_of(rows):
    out = []
    for doc_id, text in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
        n = min(5, len(words))
        out.append((doc_id, frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()))
    return out


def brute(rows):
    sets = sets_of(rows)
    use = [i for i, (d, s) in enumerate(sets) if d is not None and s]
    links, root = Counter(), {sets[i][0]: sets[i][0] for i in use}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in use:
        for b in use:
            if a < b and 5 * len(sets[a][1] & sets[b][1]) >= 4 * len(sets[a][1] | sets[b][1]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(sets[a][0]), find(sets[b][0])))
                root[y] = x
    out = []
    for i, (d, s) in enumerate(sets):
        if i not in use:
            out.append((d, d, d, 0, True))
        else:
            same = min(e for e, t in sets if t == s and e is not None)
            out.append((d, same, find(d), links[i], d == find(d)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [4096, 16])
def test_against_brute_force(docs_of, corpus, block):
    found = sorted(map(tuple, ngram_join(docs_of(corpus), block=block).collect()), key=str)
    assert found == brute(corpus)
    assert sum(1 for r in found if r[3]) > 100


def test_empty_table_and_no_candidates(docs_of):
    assert ngram_join(docs_of([])).collect() == []
    assert [tuple(r) for r in ngram_join(docs_of([(3, "a b c"), (4, None)])).orderBy("doc_id").collect()] == [(3, 3, 3, 0, True), (4, 4, 4, 0, True)]


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    kept = 0
    for _ in range(200):
        pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
        a, b = np.unique(pool[:800]), np.unique(np.r_[pool[:711], pool[800:889]])  # 711 / 889: just below 0.8
        c = np.unique(np.r_[pool[:715], pool[800:878]])  # 715 / 878: above
        assert not Comparer()([(a, minhash(a))], [(b, minhash(b))])[0, 0]
        kept += Comparer()([(a, minhash(a))], [(c, minhash(c))])[0, 0]
        assert set(band_keys(minhash(a))) & set(band_keys(minhash(c)))
    assert kept == 200
    assert [least_matches(n) for n in (40, 80)] == sorted(least_matches(n) for n in (40, 80))
    assert 0 < least_matches(40) < 32


def test_shingles_of_short_and_long_texts():
    assert len(shingles(None)) == len(shingles("?!")) == 0
    assert len(shingles("a b")) == 1 and list(shingles("A, b")) == list(shingles("a b")) != list(shingles("b a"))
    assert len(shingles("a b c d e f")) == 2
    assert len(shingles(" ".join(map(str, range(50_000))))) == 49_996


def test_components_of_long_paths(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + rng.randrange(50), 1000 + rng.randrange(50)) for _ in range(30)] + [(5, 5), (None, 3), (7, None)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[i] for i in range(301)} == {0}
    root = {n: n for e in edges for n in e if n is not None}
    for _ in range(400):
        for u, v in edges:
            if u is not None and v is not None:
                root[u] = root[v] = min(root[u], root[v])
    assert all(found.get(n, n) == r for n, r in root.items())
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def repeated_ids(corpus):
    """Ids that stand for different texts, some of them in classes of other ids."""
    rows = [(d, t) for d, t in corpus if d is not None]
    return [*rows, (0, rows[200][1]), (0, rows[201][1] + " and more"), (7, "a text of its own with more than five words"), (8, rows[3][1]), (8, rows[3][1]), (None, rows[3][1])]


def test_an_id_of_several_texts(docs_of, corpus):
    rows = repeated_ids(corpus)
    sets = [s for _, s in sets_of(rows)]
    found = Counter((r.doc_id, r.set_id, r.class_id, r.n_links) for r in ngram_join(docs_of(rows)).collect())
    use = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    near = {i: [j for j in use if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in use}
    want = Counter()
    for i, (d, _) in enumerate(rows):
        if i not in near:
            want[d, d, d, 0] += 1
            continue
        reach, todo = set(), [i]
        while todo:
            j = todo.pop()
            if j not in reach:
                reach.add(j)
                todo += near[j]
        want[d, min(rows[j][0] for j in use if sets[j] == sets[i]), min(rows[j][0] for j in reach), len(near[i]) - 1] += 1
    assert found == want


def test_one_row_of_each_class_stays(spark, docs_of, corpus):
    rows = repeated_ids(corpus)
    df = docs_of(rows).selectExpr("*", "doc_id as _id", "1 as `class_id`", "'x' as `row`", "2 as `a.b`")
    found = drop_near_copies(df)
    assert found.columns == df.columns
    got = [(r.doc_id, r.text) for r in found.collect()]
    assert all(r["_id"] == r.doc_id and r["row"] == "x" and r["a.b"] == 2 for r in found.collect())
    assert len(got) == len(set(got)) and set(got) <= set(rows)
    sets = dict(zip(rows, (s for _, s in sets_of(rows)), strict=True))
    same = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    root = {r: r for r in set(rows) if r[0] is not None and sets[r]}
    for a in root:
        for b in root:
            if same(a, b):
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)

    def top(r):
        while root[r] != r:
            r = root[r]
        return r

    kept = [r for r in got if r in root]
    assert sorted(top(r) for r in kept) == sorted({top(r) for r in root})
    assert all(r[0] == top(r)[0] for r in kept)
    assert sorted((r for r in got if r not in root), key=str) == sorted({r for r in rows if r[0] is None or not sets[r]}, key=str)
    assert drop_near_copies(docs_of([])).collect() == []


def test_blocks_bounded_by_grams(docs_of, corpus, monkeypatch):
    monkeypatch.setattr("textloom.llm.ngram_join.GRAMS", 2000)
    assert sorted(map(tuple, ngram_join(docs_of(corpus)).collect()), key=str) == brute(corpus)
