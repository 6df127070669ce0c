import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import aggregates as A
from textloom.operators import cooccurrence as C
from textloom.operators import density, segment
from textloom.plans import queries


def stages_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_cleaners_search_links_only_where_one_is_and_read_runs_once(spark):
    """two passes over each text instead of three, and links are searched only in texts that have one."""
    texts = ["a  b\t　c", "x http://a.b/c d 漢字ー１２かな", "see https://q", "://", "", None, " é!é ", "a\x1cb", "http:/ no"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.clean_zh("t").alias("zh"), T.clean_ja("t").alias("ja"))
    assert [r.zh for r in df.collect()] == ["a b c", "x 漢字", "see", "", "", "", "", "a b", "http no"]
    assert [r.ja for r in df.collect()] == ["a b c", "x 漢字ー１２かな", "see", "", "", "", "", "a b", "http no"]
    assert stages_of(df).count("regexp_replace") <= 4


def test_first_items_without_a_sort_of_all_rows(spark):
    """F16: counts and first rows come from a hash aggregate; before, the least struct sorted every word."""
    draw = random.Random(4)
    rows = [(draw.randrange(40), draw.choice(["x", "y", None]), draw.choices(["a", "b", "c", "d", "e", None], k=draw.randrange(6))) for _ in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, words array<string>")
    seen, first = Counter(), {}
    for doc, lang, words in rows:
        for k, w in enumerate(words):
            seen[lang, w] += 1
            first[lang, w] = min(first.get((lang, w), (doc, k)), (doc, k))
    want = set()
    for lang in ("x", "y", None):
        ranked = sorted((k for k in seen if k[0] == lang), key=lambda k: (-seen[k], first[k], k[1] or ""))
        want |= {(lang, w, seen[lang, w], place + 1) for place, (_, w) in enumerate(ranked[:3])}
    found = A.exploded_counts(df, ["lang"], "words", "doc_id", 3)
    assert {tuple(r) for r in found.collect()} == want


def test_class_keywords_read_the_texts_once(spark):
    """the counts are written once; before, every use of them split the texts anew."""
    df = spark.createDataFrame([(1, "x", ["a", "b", "a"]), (2, "y", ["b"])], "doc_id long, lang string, tokens array<string>")
    found = C.class_keywords(df, "lang", 2)
    assert {(r.lang, r.term) for r in found.collect()} == {("x", "a"), ("x", "b"), ("y", "b")}
    assert "explode" not in stages_of(found).lower() and "Generate" not in stages_of(found)


def test_segments_of_batches_in_slices():
    """a batch becomes Python's objects a slice at a time."""
    column = pa.array([None, "", *["word" * 50] * 500])
    parts = list(segment.slices(column, 2_000))
    assert len(parts) > 20 and pa.concat_arrays(parts).equals(column)
    assert list(segment.slices(column[:0])) == []


def test_spanning_trees_measure_only_what_may_be_nearer(monkeypatch):
    """exact distances only where the product's leave a doubt; before, all rows in every step."""
    draw = np.random.default_rng(2)
    x = np.round(draw.normal(size=(200, 3)) * 4) / 4
    ids, core = draw.permutation(200), np.round(draw.uniform(0, 0.4, 200), 9)
    seen = []
    exact = density.exact_distance
    monkeypatch.setattr(density, "exact_distance", lambda a, b: seen.append(len(a)) or exact(a, b))
    tree = density.spanning(ids, x, core)
    edges = sorted((max(float(exact(x[i][None], x[j])[0]), core[i], core[j]), *sorted((int(ids[i]), int(ids[j])))) for i in range(200) for j in range(i))
    top, want = list(range(200)), []

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for w, u, v in edges:
        if find(u) != find(v):
            top[find(u)] = find(v)
            want.append((w, u, v))
    assert sorted(tree) == want
    assert sum(seen) < 199 * 200 / 2


def test_weights_without_a_row_for_each_document_and_term(spark):
    """a part of the documents asks once for each of its terms; before, every (document, term) was shuffled twice."""
    draw = random.Random(6)
    rows = [(k, "xy"[k % 2], draw.choices(["a", "b", "c", "dd", "é", None], k=draw.randrange(7))) for k in range(150)] + [(3, "y", ["a", "q"]), (200, "x", None), (None, "x", ["a", "b"])]
    df = spark.createDataFrame(rows, "doc_id long, lang string, tokens array<string>")
    texts = {}
    for doc, lang, words in rows:
        texts.setdefault((doc, lang), []).extend([w for w in words or []])
    tf = {k: Counter(w for w in ws if w) for k, ws in texts.items()}
    seen = Counter(w for ws in tf.values() for w in ws)
    want = {}
    for key, ws in tf.items():
        w = {t: k * (np.log((1 + len(rows)) / (1 + seen[t])) + 1) for t, k in ws.items() if seen[t] >= 2}
        want |= {(*key, t): x / np.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
    for parts in (1, 5, 70):
        found = {(r.doc_id, r.lang, r.term): r.weight for r in C.tfidf(df, 2, carry=("lang",), parts=parts).collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1.1e-6 for k in want)
    plan = stages_of(C.tfidf(df, 2, carry=("lang",), parts=5))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def test_weights_of_grams(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"])], "doc_id long, tokens array<string>")
    assert {(r.doc_id, r.term, r.weight) for r in C.tfidf(df, grams=2).collect()} == {(d, t, 0.57735) for d in (1, 2) for t in ("a", "b", "a b")}
    assert {r.term for r in C.tfidf(df.union(df.limit(0)), top=1).collect()} == {"a"}


def gram_rows(docs, least, sizes=(1, 2, 3)):
    seen = Counter(" ".join(w for w in ws[i : i + n] if w is not None) for ws in docs for n in sizes for i in range(len(ws or []) - n + 1))
    return {g: c for g, c in seen.items() if c >= least}


def test_frequent_ngrams_by_two_readings(spark):
    """n-grams are counted by packed hashes, and only those that may be frequent enough become rows; before, all did."""
    draw = random.Random(9)
    docs = [draw.choices(["a", "b", "a b", "", " ", "é", "b a", None, "the", "7"], k=draw.randrange(12)) for _ in range(90)] + [None, [], [None], ["x" * 5000] * 7, ["the", "7"] * 9]
    df = spark.createDataFrame([(d,) for d in docs], "tokens array<string>").repartition(5)
    for least, sizes in ((2, (1, 2, 3)), (7, (1, 2, 3)), (300, (2, 2, 4)), (10**6, (1,))):
        want = gram_rows([d for d in docs if d], least, sizes)
        found = C.ngram_counts(df, sizes, tokens="tokens", least=least).collect()
        assert sorted((r.ngram, r.n, r["count"]) for r in found) == sorted((g, len(g.split(" ")), c) for g, c in want.items() if g.split(" ") != ["7"] * len(g.split(" ")))
        assert sorted(found) == sorted(C.ngram_counts(df, sizes).where(F.col("count") >= least).collect())
    assert C.ngram_counts(df, stop=["the"], least=5).where("ngram in ('the', 'the 7', '7 the')").isEmpty()
    assert C.ngram_counts(df.limit(0), least=2).collect() == []


def test_ngram_query_makes_rows_of_few_ngrams(spark, tmp_path):
    """60,000 n-grams, of which 3 are there 10 times; before, each of them was a row of the exchange."""
    texts = [" ".join("".join(chr(97 + int(c)) for c in str(k * 100 + i)) for i in range(200)) + " one of ten" for k in range(100, 200)]
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.ngram_counts(spark, str(tmp_path))
    assert {(r.ngram, r.n, r["count"]) for r in df.collect()} == {("one", 1, 100), ("of", 1, 100), ("ten", 1, 100), ("one of", 2, 100), ("of ten", 2, 100), ("one of ten", 3, 100)}
    assert "Generate" not in stages_of(df)  # no row for each place


def test_ngram_filter_of_few_bits(monkeypatch):
    """counts stay exact where lists come by slices, spans are many and the filter lets much pass."""
    monkeypatch.setattr(C, "TOKENS", 5)
    draw = random.Random(3)
    docs = [draw.choices("abcdefgh", k=draw.randrange(9)) for _ in range(80)]
    batches = [pa.RecordBatch.from_arrays([pa.array(docs[i : i + 20], pa.list_(pa.string()))], ["tokens"]) for i in range(0, 80, 20)]
    for spans, width, least in ((1, 4, 4), (4, 12, 4), (6, 20, 300)):
        rows = sorted((r for b in C._gram_hashes((1, 2, 3), least, spans)(iter(batches)) for r in b.to_pylist()), key=lambda r: r["span"])
        parts = C._filter_parts(least, spans, width)(iter([pa.RecordBatch.from_pylist(rows[i : i + 7]) for i in range(0, len(rows), 7)]))
        bits = np.zeros((1 << spans, 1 << (width - spans - 3)), dtype=np.uint8)
        for p in parts:
            bits[p["span"][0].as_py()] = np.frombuffer(p["bits"][0].as_py(), dtype=np.uint8)
        found = Counter()
        rows = sorted((r for b in C._filtered_grams((1, 2, 3), bits.ravel(), width, 2)(iter(batches)) for r in b.to_pylist()), key=lambda r: r["span"])
        for k in (1, least):
            blobs = iter([pa.RecordBatch.from_pylist(rows[i : i + 7]) for i in range(0, len(rows), 7)])
            listed = [(r["ngram"], r["count"]) for b in C._gram_sums(k)(blobs) for r in b.to_pylist()]
            found = dict(listed)
            assert len(found) == len(listed)
            assert {g: c for g, c in found.items() if c >= least} == gram_rows(docs, least)
            assert k < least or len(found) == len(gram_rows(docs, least))
