"""Queries over small tables of their own against brute force: nothing is left out of the job."""

import difflib
import itertools
import random
from collections import Counter

from textloom.plans import queries as registry

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, folder, rows):
    """A folder of tables with these (doc_id, text, lang)."""
    spark.createDataFrame([(d, t, lang, "s", len(t)) for d, t, lang in rows], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_pairs_of_rare_terms(spark, tmp_path):
    texts = [f"the w{'abc'[i % 3]}" + (" rare pair" if i < 5 else "") + (" four" if i < 4 else "") + (" odd" if i % 25 == 0 else "") for i in range(200)]
    sf = documents(spark, tmp_path, [(i, t, "en") for i, t in enumerate(texts)])
    sets = [set(t.split()) for t in texts]
    df = Counter(w for s in sets for w in s)
    co = Counter(p for s in sets for p in itertools.combinations(sorted(w for w in s if df[w] >= 5), 2))
    want = {(a, b, n, df[a], df[b], 200) for (a, b), n in co.items() if n >= 3}
    assert ("pair", "rare", 5, 5, 5, 200) in want and len(want) < len(co)
    found = registry.QUERIES["cooc_pairs"](spark, sf)
    assert {tuple(r) for r in found.select("a", "b", "co", "df_a", "df_b", "n_docs").collect()} == want
    assert {(r.a, r.b, r.co) for r in registry.QUERIES["pmi_tscore"](spark, sf).collect()} == {w[:3] for w in want}
    core = {r.term for r in registry.QUERIES["top_n_per_core"](spark, sf).collect() if r.core == "the"}
    assert core == {b if a == "the" else a for a, b, *_ in want if "the" in (a, b)}


def test_targets_of_whole_texts(spark, tmp_path):
    texts = ["filler " * 100 + "und then " * 3000 + "the end", "erthe " + "x" * 500 + " the", "a" * 600 + " que"]
    sf = documents(spark, tmp_path, [(8 * i + 1, t, "en") for i, t in enumerate(texts)])
    found = {r["target"].lower(): r["count"] for r in registry.QUERIES["who_targets"](spark, sf).collect()}
    assert "the" not in texts[0][:400] and "que" not in texts[2][:400]
    assert found == {"und": 1, "the": 1, "erthe": 1, "que": 1}
    assert registry.QUERIES["how_expressions"](spark, sf).count() >= 0


def test_entities_of_whole_texts(spark, tmp_path):
    texts = [(8, "a " * 25 + "z " * 30 + "end", "en"), (16, "b  c" + " z" * 40, "en"), (15, "noise topic", "en")]
    found = registry.QUERIES["entity_frequency"](spark, documents(spark, tmp_path, texts)).collect()
    want = Counter(w for d, t, _ in texts if d % 8 == 0 for w in t.split(" "))
    assert {r.target: r["count"] for r in found} == dict(want) and want["z"] == 70
    assert [r.target for r in sorted(found, key=lambda r: r.place)] == ["z", "a", "end", "b", "", "c"]


def test_near_leaks(spark, tmp_path):
    rng = random.Random(4)
    rows = [(1000, "", "en"), (1001, "short", "en"), (1010, "short", "en"), (1020, "shorty", "en")]
    for i in range(40):
        base = "".join(rng.choice("abcdefgh ") for _ in range(190))
        step = rng.choice([5, 6, 7, 8, 9])
        rows += [(10 * i + 1, base, "en"), (10 * i, "".join("#" if k % step == 0 else x for k, x in enumerate(base)), "en")]
    train = {t for d, t, _ in rows if d % 10}
    want, best = {}, {}
    for d, t, _ in rows:
        if d % 10 == 0:
            best[d] = max(difflib.SequenceMatcher(None, t, x).ratio() for x in train)
            want |= {d: "exact"} if t in train else {d: "fuzzy"} if best[d] > 0.85 else {}
    assert sum(0.85 < x < 0.9 for x in best.values()) > 5 and len(want) < len(best) and want[1010] == "exact"
    found = registry.QUERIES["all_leaks"](spark, documents(spark, tmp_path, rows))
    assert sorted(map(tuple, found.collect())) == sorted(want.items())
