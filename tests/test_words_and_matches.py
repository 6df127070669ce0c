"""Dictionary matching, dictionary tokens, joins on contained terms and splits against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import cooccurrence, sampling, tables
from textloom.operators.match import JA_SENTENCE, _finder


def longest_first(order, text, words):
    low, taken, found = text.lower(), set(), []
    for i, (term, label) in enumerate(order):
        if any(t == term for t, _ in order[:i]):
            continue
        pattern = rf"\b{re.escape(term)}\b" if words else re.escape(term)
        for m in re.finditer(pattern, low):
            if not taken & set(range(*m.span())):
                taken |= set(range(*m.span()))
                found.append({"text": text[slice(*m.span())].strip(), "label": label, "source": "gazetteer"})
    return found


@pytest.mark.parametrize("words", [True, False])
def test_one_pass_finds_what_term_after_term_finds(words):
    rng = random.Random(3)
    for _ in range(300):
        terms = ["".join(rng.choice("ab é") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 8))]
        order = sorted(((t, f"k{i}") for i, t in enumerate(terms) if t), key=lambda x: -len(x[0]))
        text = "".join(rng.choice("abAB é.-") for _ in range(rng.randint(0, 60)))
        assert _finder(order)(text, words) == longest_first(order, text, words), (order, text)


def test_dictionary_tokens_take_the_longest_word(spark):
    words = ["中国", "中国人", "人民", "日本", "日本語", "を"]
    rows = [("zh", "中国人民abc 日本1"), ("ja", "日本語を話す。ABCです"), ("xx", "中国é-9a"), ("zh", None), ("zh", "")]
    df = spark.createDataFrame(rows, "lang string, text string")
    found = {(r.lang, r.text): tuple(r[k] for k in ("zh", "ja", "xx")) for r in df.select("lang", "text", *[T.dictionary_tokens("text", words, k).alias(k) for k in ("zh", "ja", "xx")]).collect()}
    assert found["zh", rows[0][1]][0] == ["中国人", "民", "abc", "日本"]
    assert found["ja", rows[1][1]][1] == ["日本語", "を", "話", "す", "ABC", "で", "す"]
    assert found["xx", rows[2][1]][2] == ["中国", "é", "9", "a"]
    assert found["zh", None] == found["zh", ""] == ([], [], [])


def test_large_vocabularies_meet_without_a_broadcast(spark):
    rng = random.Random(5)
    docs = [(i, "".join(rng.choice("abCé ") for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(99, None), (7, "abab")]
    terms = [(k, "".join(rng.choice("AbcÉ") for _ in range(rng.randint(1, 4)))) for k in range(40)] + [(100, None), (101, ""), (3, "ab")]
    d, v = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(terms, "item long, term string")
    want = Counter((i, t, k, w) for i, t in docs for k, w in terms if t is not None and w is not None and w.lower() in t.lower())
    assert Counter(map(tuple, tables.contains_join(d, v, "text", "term").collect())) == want
    large = tables.contains_join(d, v.where("term <> ''"), "text", "term", rows=5)
    assert Counter(map(tuple, large.collect())) == Counter({k: n for k, n in want.items() if k[3]})
    assert tables.contains_join(d, v.limit(0), "text", "term").collect() == []


def test_splits_and_folds_follow_the_order(spark, monkeypatch):
    rows = [(i, "ab"[i % 3 == 0], None if i % 50 == 0 else i % 2) for i in range(800)] + [(9000, "single", 1)]
    df = spark.createDataFrame(rows, "doc_id long, a string, b int")
    place = lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i)
    groups = {}
    for i, a, b in rows:
        groups.setdefault((a, b), []).append(i)
    want = {i for own in groups.values() for i in sorted(own, key=place)[: round(len(own) * 0.1)]}
    ordered = sorted((i for i, *_ in rows), key=place)
    sizes = [len(rows) // 7 + (f < len(rows) % 7) for f in range(7)]
    folds = {i: f for f in range(7) for i in ordered[sum(sizes[:f]) : sum(sizes[: f + 1])]}
    for buckets in ("full", "two"):
        if buckets == "two":  # nearly all rows lie in buckets where something ends
            monkeypatch.setattr(sampling, "bucket", lambda d: F.when(F.substring(d, 1, 1) < "8", 0).otherwise(1))
        assert {r.doc_id for r in sampling.split(df, ["a", "b"]).where("split = 'val'").collect()} == want
        assert {r.doc_id: r.fold for r in sampling.exact_folds(df, 7).collect()} == folds
    assert sampling.split(df.limit(0), ["a"]).collect() == sampling.exact_folds(df.limit(0)).collect() == []


def test_pairs_of_repeated_ids_and_empty_documents(spark):
    rows = [(1, ["a", "b", "a"]), (1, ["c"]), (2, ["a", "c"]), (3, []), (4, None), (5, ["b", "c", "a"])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    found = {(r.a, r.b): (r.co, r.df_a, r.df_b, r.n_docs) for r in cooccurrence.document_pairs(df).collect()}
    assert found == {("a", "b"): (2, 3, 2, 6), ("a", "c"): (3, 3, 3, 6), ("b", "c"): (2, 2, 3, 6)}
    assert cooccurrence.document_pairs(df.limit(0)).collect() == cooccurrence.window_pairs(df.limit(0)).collect() == []
    codes = cooccurrence.coded_terms(spark.createDataFrame([(f"t{i:03d}", i % 5) for i in range(300)], "term string, n int").repartition(7), "n").collect()
    assert [r.term for r in sorted(codes, key=lambda r: r.code)] == sorted((f"t{i:03d}" for i in range(300)), key=lambda t: (int(t[1:]) % 5, t))
    assert sorted(r.code for r in codes) == list(range(300))


def test_a_fixed_pattern_reads_sentences(spark):
    rows = spark.createDataFrame([("あいうえおがかきくける",), ("東京",)], "t string").select(F.col("t").rlike(JA_SENTENCE)).collect()
    assert [r[0] for r in rows] == [True, False]
