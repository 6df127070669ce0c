import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from textloom.llm.source_mix import Mix, mix_plan, mix_rows, mix_sources


def brute(rows, m):
    tokens, docs = Counter(), defaultdict(list)
    for d, t, s in rows:
        n = len((t or "").split())
        tokens[s or ""] += n
        docs[s or ""].append((d, s, n))
    total = sum(tokens.values())
    q = {s: n / total for s, n in tokens.items() if n}
    h = lambda p: -sum(x * math.log(x) for x in p)
    target = h(q.values()) + m.entropy * (math.log(len(q)) - h(q.values()))

    def weights(tau):
        z = sum(x**tau for x in q.values())
        return {s: x**tau / z for s, x in q.items()}

    def bisect(fits):
        lo, hi = 0.0, 1.0
        if fits(weights(0.0)):
            return 0.0
        for _ in range(20):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if fits(weights(mid)) else (mid, hi)
        return hi

    tau = max(bisect(lambda w: h(w.values()) <= target + 1e-12), bisect(lambda w: max(w[s] / q[s] for s in q) * m.budget <= m.repetition + 1e-12))
    w = weights(tau)
    place = lambda e, d: int(hashlib.md5(f"{m.seed}:{e}:{'' if d is None else d}".encode()).hexdigest()[:15], 16)
    out = []
    for s, own in docs.items():
        budget = math.floor(w.get(s, 0.0) * (m.budget * total))
        full, rest = divmod(budget, tokens[s]) if tokens[s] else (0, 0)
        keys = sorted((place(full, d), -(2**63) if d is None else d, n) for d, _, n in own)
        for d, name, n in own:
            mine = (place(full, d), -(2**63) if d is None else d)
            before = sum(k[2] for k in keys if k[:2] < mine)
            for e in [*range(full), *([full] if before < rest else [])]:
                out.append((d, name, e, place(e, d), n))
    return tau, w, sorted(out, key=str)


def rows_of(seed=1, n=900):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 80])), rng.choice(["hot"] * 20 + ["b"] * 4 + ["c", "d", "", None])) for i in range(n)]
    return rows + [(5000, None, "b"), (5001, "", "b"), (None, "x y", "b"), (5002, "a b c", "c"), (5002, "a b c", "c"), (5003, "", "no tokens"), (5004, "w " * 3000, "d")]


@pytest.mark.parametrize("m", [Mix(), Mix(entropy=1.0, repetition=1.5), Mix(entropy=0.3, repetition=1.0, budget=0.8), Mix(entropy=0.9, repetition=9.0, budget=3.0), Mix(entropy=0.0)])
def test_against_brute_force(docs_of, m, monkeypatch):
    monkeypatch.setattr("textloom.llm.source_mix.BLOCK", 16)
    rows = rows_of()
    tau, w, expected = brute(rows, m)
    df = docs_of([(d, t, None, s) for d, t, s in rows])
    found = mix_sources(df, m).collect()
    assert sorted([(r.doc_id, r.source, r.epoch, r.place, r.n_tokens) for r in found], key=str) == expected
    plan = {r.source: r for r in mix_plan(df, m).collect()}
    assert all(math.isclose(plan[s].weight, x, rel_tol=1e-9) for s, x in w.items())
    assert max(r.budget / r.tokens for r in plan.values() if r.tokens) <= m.repetition + 1e-9
    used = Counter()
    for r in found:
        used[r.source or ""] += r.n_tokens
    most = Counter()
    for _, t, s in rows:
        most[s or ""] = max(most[s or ""], 2 * len((t or "").split()))  # repeated rows come together
    assert all(r.budget <= used[s] for s, r in plan.items())
    assert all(used[s] - r.budget < max(most[s], 1) for s, r in plan.items())


def test_without_broadcast_and_empty(docs_of, monkeypatch):
    monkeypatch.setattr("textloom.llm.source_mix.BROADCAST_ROWS", 0)
    rows = rows_of(2, 200)
    df = docs_of([(d, t, None, s) for d, t, s in rows])
    assert sorted([(r.doc_id, r.source, r.epoch, r.place, r.n_tokens) for r in mix_sources(df).collect()], key=str) == brute(rows, Mix())[2]
    assert mix_sources(docs_of([])).collect() == []
    assert mix_sources(docs_of([(1, None, None, "a")])).collect() == []


def test_a_document_that_crosses_the_budget_stays(docs_of, monkeypatch):
    monkeypatch.setattr("textloom.llm.source_mix.BLOCK", 2)
    monkeypatch.setattr("textloom.llm.source_mix.BLOCKS", 3)
    rows = [(0, "long " * 500, "one")] + [(i, "word " * (i % 7), "many") for i in range(1, 200)]
    m = Mix(entropy=0.5, repetition=1.0, budget=0.8)
    found = mix_sources(docs_of([(d, t, None, s) for d, t, s in rows]), m).collect()
    assert 0 in {r.doc_id for r in found}
    assert sorted([(r.doc_id, r.source, r.epoch, r.place, r.n_tokens) for r in found], key=str) == brute(rows, m)[2]


def test_clashing_names(docs_of):
    df = docs_of([(d, t, None, s) for d, t, s in rows_of(3, 100)]).selectExpr("*", "1 as epoch", "'w' as weight", "2 as `row`", "3 as _doc", "4 as `a.b`")
    found = mix_sources(df, keep=["doc_id", "epoch", "weight"])
    assert found.columns == ["doc_id", "epoch_", "weight_", "epoch", "block", "place", "n_tokens", "weight"]
    whole = mix_rows(df).select("row.*")
    assert whole.columns == df.columns and {(r["epoch"], r["row"], r["_doc"], r["a.b"]) for r in whole.collect()} == {(1, 2, 3, 4)}
