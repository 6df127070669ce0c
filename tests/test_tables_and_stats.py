import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import aggregates as A
from textloom.operators import augment, ensemble, plugins, sampling
from textloom.operators import cooccurrence as C
from textloom.operators import similarity as V
from textloom.operators import statistics as S
from textloom.operators import tables as J


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([(1, "en", ["b", "a"]), (2, "en", ["a", "b", "c"]), (3, "en", [])], "doc_id long, lang string, items array<string>")
    found = A.exploded_counts(df, ["lang"], "items", "doc_id", None).orderBy("place").collect()
    assert [(r.target, r["count"]) for r in found] == [("b", 2), ("a", 2), ("c", 1)]
    assert A.ranked_map(A.exploded_counts(df, ["lang"], "items", "doc_id", 2), ["lang"]).first()["items"] == ["b", "a"]
    assert A.dominant(spark.createDataFrame([(1, "x", "q"), (2, "x", "p"), (3, "x", "p"), (4, "x", "q")], "o long, k string, v string"), ["k"], "v", "o").first()["dominant"] == "q"
    assert A.modal(spark.createDataFrame([("x", "q"), ("x", "p"), ("x", None)], "k string, v string"), ["k"], "v").first()["mode"] == "p"


def test_topic_summary_drops_noise(spark):
    detail = lambda *names: [{"text": n, "label": "L" + n[0], "source": "s"} for n in names]
    df = spark.createDataFrame([(1, 0, ["a1", "b1"], detail("a1", "b1"), True), (2, 0, ["a1"], detail("a1"), False), (3, -1, ["z"], detail("z"), False), (4, 1, [], [], False)], "doc_id long, topic int, targets array<string>, details array<struct<text:string,label:string,source:string>>, llm_enriched boolean")
    found = {r.topic: r for r in A.topic_summary(df).collect()}
    assert set(found) == {0, 1}
    assert found[0].top_targets == ["a1(2)", "b1(1)"] and found[0].target_categories == {"La": 2, "Lb": 1} and found[0].unique_targets == 2 and found[0].llm_enriched_rows == 1
    assert found[1].top_targets == [] and found[1].unique_targets == 0


def test_shares_sum_to_one(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.choice("ab"), rng.choice("xyz")) for _ in range(200)], "k string, v string")
    sums = A.shares_within(df, ["k"], "v").groupBy("k").agg(F.sum("pct").alias("s")).collect()
    assert all(math.isclose(r.s, 100, abs_tol=1e-4) for r in sums)
    assert math.isclose(sum(r.share for r in A.value_counts(df, "v").collect()), 1, abs_tol=1e-5)


def test_lookups_never_multiply_rows(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert rows(J.lookup(df, spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string"), "k", "v", "other"), "k", "v") == [(1, "b"), (2, "other")]


def test_deduplication(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1), (4, None, 1), (5, None, 2)], "o int, t string, x int")
    assert rows(J.first_by_key(df, ["t"], ["o"]), "o") == [(1,), (2,), (4,)]
    assert rows(J.dedup_subset(df, ["missing"], ["o"]), "o") == [(1,), (2,), (3,), (4,), (5,)]
    again = J.first_by_key(J.first_by_key(df, ["t"], ["o"]), ["t"], ["o"])
    assert rows(again, "o") == [(1,), (2,), (4,)]
    assert rows(J.last_by_key(df.where("t is not null"), ["t"], ["o"]), "o") == [(2,), (3,)]
    assert J.union_ragged(df, spark.createDataFrame([(9,)], "y int")).columns == ["o", "t", "x", "y"]


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, [rng.choice("abcdefg") for _ in range(rng.randint(0, 9))]) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    want = Counter(p for _, t in docs for p in itertools.combinations(sorted(set(t)), 2))
    dfs = Counter(x for _, t in docs for x in set(t))
    found = {(r.a, r.b): r for r in C.document_pairs(df).collect()}
    assert {k: r.co for k, r in found.items()} == want
    for r in C.document_scores(C.document_pairs(df)).collect():
        e = dfs[r.a] * dfs[r.b] / 40
        assert r.pmi == pytest.approx(math.log(40 * want[r.a, r.b] / (dfs[r.a] * dfs[r.b]) + 1e-12), abs=1e-6)
        assert r.tscore == pytest.approx((want[r.a, r.b] - e) / math.sqrt(want[r.a, r.b]), abs=1e-6)
    windows = [sorted(set(t[i : i + 4])) for _, t in docs for i in range(len(t)) if len(t[i : i + 4]) >= 2]
    pairs = Counter(p for w in windows for p in itertools.combinations(w, 2))
    terms = Counter(x for _, t in docs for x in t)
    found = {(r.a, r.b): r for r in C.window_pairs(df).collect()}
    assert {k: r.co for k, r in found.items()} == pairs and {r.n_windows for r in found.values()} == {len(windows)}
    core = C.core_pairs(df, ["a"]).collect()
    assert {(r.core, r.term): r.co for r in core} == {("a", x): sum("a" in t and x in t for _, t in docs) for x in "bcdefg" if any("a" in t and x in t for _, t in docs)}
    assert all(r.c_a == terms[r.a] for r in found.values())


def test_log_likelihood_is_g2_of_the_four_cells(spark):
    pair = spark.createDataFrame([("a", "b", 20, 50, 40, 1000), ("c", "d", 2, 50, 40, 1000)], "a string, b string, co long, c_a long, c_b long, n_windows long")
    found = {r.a: r.llr for r in C.window_scores(pair).collect()}
    for name, co in (("a", 20), ("c", 2)):
        cells = np.array([[co, 50 - co], [40 - co, 1000 - 90 + co]], dtype=float)
        e = cells.sum(1, keepdims=True) * cells.sum(0, keepdims=True) / cells.sum()
        assert found[name] == pytest.approx(2 * (cells * np.log(cells / e)).sum(), abs=1e-5)
    # the sum over the second row alone, which is not the statistic
    assert found["a"] != pytest.approx(2 * 20 * math.log(20 / 2.0), abs=1e-3)


def test_rare_terms_are_dropped_on_both_sides(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["a", "r"])], "doc_id long, tokens array<string>")
    assert rows(C.window_pairs(df, 4, 2), "a", "b") == [("a", "b")]
    assert rows(C.document_pairs(df, 2), "a", "b") == [("a", "b")]


def test_constant_scores_scale_to_zero(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 2.0), ("a", "y", 1.0, 4.0)], "core string, term string, pmi double, tscore double")
    assert rows(C.scaled_scores(df), "term", "pmi_norm", "score") == [("x", 0.0, 0.0), ("y", 0.0, 0.5)]
    docs = spark.createDataFrame([(1, "A x"), (2, "a x y"), (3, "a x z"), (4, "x a")], "doc_id long, text string")
    assert C.with_examples(C.top_per_core(C.scaled_scores(df), 1).where("term = 'y'"), docs).first()["examples"] == ["a x y"]


def test_tfidf_rows_have_length_one(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b", "c"]), (3, ["a"])], "doc_id long, tokens array<string>")
    found = C.tfidf(df).groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(r.s == pytest.approx(1, abs=1e-5) for r in found)
    assert {r.term for r in C.tfidf(df, max_df=0.5).collect()} == {"c"}


def test_anova_against_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {"en": rng.normal(0, 1, 40), "zh": rng.normal(0.5, 1, 30), "ja": rng.normal(0.2, 2, 20)}
    df = spark.createDataFrame([(k, float(x), 1.0) for k, v in groups.items() for x in v] + [("en", None, 1.0)], "lang string, x double, y double")
    r = {a["axis"]: a for a in S.anova(df, ["x", "y"], "lang").collect()}
    everything = np.concatenate(list(groups.values()))
    between = sum(len(v) * (v.mean() - everything.mean()) ** 2 for v in groups.values())
    within = sum(((v - v.mean()) ** 2).sum() for v in groups.values())
    assert r["x"]["f_stat"] == pytest.approx(between / 2 / (within / 87)) and r["x"]["eta_squared"] == pytest.approx(between / (between + within))
    assert r["x"]["std"]["en"] == pytest.approx(groups["en"].std()) and set(r["x"]["welch"]) == {"en-ja", "en-zh", "ja-zh"}
    assert S.anova(df, ["x"], "lang", least=25).count() == 0
    # eta squared from F, as published: F 2 / (F 2 + n - 3)
    assert 32068.18 * 2 / (32068.18 * 2 + 3432) == pytest.approx(0.9492, abs=1e-4)
    z = S.z_scores(df.where("x is not null"), ["x", "y"], "lang").groupBy("lang").agg(F.avg("x_z").alias("m"), F.stddev_pop("x_z").alias("s"), F.max(F.abs("y_z")).alias("c")).collect()
    assert all(abs(q.m) < 1e-5 and abs(q.s - 1) < 1e-5 and q.c == 0 for q in z)


def test_components_against_svd(spark):
    x = np.random.default_rng(3).normal(size=(60, 3)) @ np.diag([3, 1, 0.2]) + 5
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    scored, loadings, explained = S.principal_components(df, ["a", "b", "c"])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert explained == pytest.approx((s**2 / (s**2).sum())[:2])
    got = np.array([[r.pc1, r.pc2] for r in scored.collect()])
    assert np.sort(np.abs(got[:, 0])) == pytest.approx(np.sort(np.abs(u[:, 0] * s[0])))
    assert abs(got.mean()) < 1e-9 and loadings.shape == (3, 2)


def test_metrics(spark):
    truth = [1] * 131 + [0] * 2030
    said = [1] * 21 + [0] * 110 + [1] * 64 + [0] * 1966
    df = spark.createDataFrame(list(zip(truth, said, strict=True)), "t int, p int")
    r = S.confusion(df, "t", "p").first()
    assert (r.tp, r.fp, r.fn) == (21, 64, 110) and r.f1 == pytest.approx(0.19444, abs=1e-5)
    empty = S.confusion(df.where("false"), "t", "p").first()
    assert empty.f1 == 0 == empty.accuracy
    rng = random.Random(1)
    scored = [(rng.randint(0, 1), rng.random()) for _ in range(300)]
    sweep = {r.threshold: r.f1 for r in S.threshold_sweep(spark.createDataFrame(scored, "t int, p double"), "t", "p").collect()}
    assert len(sweep) == 95
    for t in (0.01, 0.5, 0.95):
        tp = sum(a == 1 and p >= t for a, p in scored)
        assert sweep[t] == pytest.approx(2 * tp / (sum(p >= t for _, p in scored) + sum(a for a, _ in scored)), abs=1e-6)
    best = S.best_threshold(S.threshold_sweep(spark.createDataFrame(scored, "t int, p double"), "t", "p")).first()
    assert best.f1 == max(sweep.values()) and best.threshold == min(t for t, f in sweep.items() if f == best.f1)
    assert S.best_threshold(S.threshold_sweep(spark.createDataFrame([(0, 0.5)], "t int, p double"), "t", "p")).first().threshold == 0.5


def test_sample_size_and_entropy(spark):
    assert S.sample_size(20_000, 0.03) == 1014 and S.sample_size(100_000, 0.05) == 383
    assert S.sample_size(10, 0.03) <= 10 and S.sample_size(0) == 0 and S.sample_size(10_000, 0.01, cap=500) == 500
    found = [r.e for r in spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double").select(S.binary_entropy("p").alias("e")).collect()]
    assert found == [0, 1, 0]


def vectors(spark, n=40, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    return x, spark.createDataFrame([(i, [float(v) for v in r], i % 4) for i, r in enumerate(x)], "id long, embedding array<double>, label int")


def test_vector_operators_against_numpy(spark):
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    for block in (4096, 3):
        top = V.top_k_cosine(df.where("id < 5"), df, 3, "id", "id", block=block).orderBy("seed", "place").collect()
        for s in range(5):
            assert [r.pool for r in top if r.seed == s] == list(np.argsort(-cos[s], kind="stable")[:3])
    m = {r.label: r.mean_cosine for r in V.mean_similarity(df, "embedding", ["label"]).collect()}
    for k in range(4):
        own = cos[k::4, k::4]
        assert m[k] == pytest.approx((own.sum() - len(own)) / (len(own) * (len(own) - 1)), abs=1e-6)
    centred = {r.id: np.array(r.centred) for r in V.centre_by(df, "label", "embedding").collect()}
    assert all(np.linalg.norm(v) == pytest.approx(1) for v in centred.values())
    axes = V.axis_vectors(df.where("label < 2").withColumn("axis", F.lit("a")).withColumn("polarity", F.when(F.col("label") == 0, "pos").otherwise("neg")))
    axis = u[0::4].mean(0) - u[1::4].mean(0)
    got = {r.id: r.bias_a for r in V.project(df, axes).collect()}
    assert all(got[i] == pytest.approx(float(u[i] @ (axis / np.linalg.norm(axis))), abs=1e-6) for i in range(40))
    assert np.array(axes.first()["vec"]) == pytest.approx(axis)
    assert V.redundancy(df.where("id < 5"), df.where("id < 0"), "id", "id").first()["share"] == 0
    p = V.precision_at_k(df, 3, "id", "label").first()["precision"]
    want = np.mean([np.mean([j % 4 == i % 4 for j in [j for j in np.argsort(-cos[i], kind="stable") if j != i][:3]]) for i in range(40)])
    assert p == pytest.approx(want, abs=1e-6)
    assert -1 <= V.silhouette(df, "label", "embedding") <= 1
    clustered = V.kmeans(df, 3, "embedding")
    assert V.drop_outliers(clustered, 0.5).count() < 40 and V.closest_to_centre(clustered, 1, "id").count() == 3


def test_leaks(spark):
    base = "the quick brown fox jumps over the lazy dog again and again"
    val = spark.createDataFrame([(1, base), (2, base + "!"), (3, "something else entirely here"), (4, "")], "id long, text string")
    train = spark.createDataFrame([(9, base), (8, "unrelated words of another kind")], "id long, text string")
    for blocking in (True, False):
        assert rows(V.leaks(val, train, "id", "id", blocking=blocking), "id", "kind") == [(1, "exact"), (2, "fuzzy")]
    verdict = V.leak_verdict(val, V.leaks(val, train, "id", "id")).first()
    assert verdict.exact_rate == verdict.fuzzy_rate == 0.25 and verdict.leaking


def test_splits_are_deterministic_and_stratified(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.randint(0, 1), rng.choice([0, 0, 0, 1])) for i in range(997)], "doc_id long, a int, b int")
    one, two = (rows(sampling.split(df.repartition(n), ["a", "b"], 0.1), "doc_id", "split") for n in (1, 7))
    assert one == two
    sizes = Counter((r.a, r.b) for r in df.collect())
    val = Counter((r.a, r.b) for r in sampling.split(df, ["a", "b"], 0.1).where("split = 'val'").collect())
    assert all(abs(val[k] - n * 0.1) <= 1 for k, n in sizes.items())
    folds = Counter(r.fold for r in sampling.exact_folds(df, 5).collect())
    assert max(folds.values()) - min(folds.values()) <= 1 and len(folds) == 5
    assert {r.fold for r in sampling.folds(df, 5).collect()} == set(range(5))
    assert sampling.sample_k(df, 10_000).count() == 997 and rows(sampling.sample_k(df, 7), "doc_id") == rows(sampling.sample_k(df.repartition(5), 7), "doc_id")


def test_groups_stay_together(spark):
    df = spark.createDataFrame([(i, str(i // 3) if i < 90 else None, i % 2) for i in range(150)], "doc_id long, group_id string, y int")
    found = sampling.group_split(df, ["y"], share=0.2).collect()
    assert len(found) == 150
    by = {}
    for r in found:
        if r.group_id is not None:
            by.setdefault(r.group_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values()) and {"val", "train"} <= {r.split for r in found}


def test_annotation_sample_never_repeats_rows(spark):
    votes = lambda i: [{"model": "m", "label": int(i % 3 == 0), "prob": 0.9}, {"model": "n", "label": int(i % 2 == 0), "prob": 0.3 if i % 5 else 0.95}]
    df = spark.createDataFrame([(i, f"text {i}", votes(i)) for i in range(60)], "doc_id long, text string, votes array<struct<model:string,label:int,prob:double>>")
    evaluated = ensemble.evaluate(df)
    for n in (5, 50, 1000):
        found = sampling.annotation_sample(evaluated, n, 2).collect()
        assert len(found) == len({r.doc_id for r in found}) <= n
    r = evaluated.where("doc_id = 0").first()
    assert r.model_votes == "2/0" and not r.conflict and r.avg_prob == pytest.approx(0.925) and r.avg_p_pos == pytest.approx(0.925)
    r = evaluated.where("doc_id = 1").first()
    assert r.avg_prob == pytest.approx(0.6) and r.avg_p_pos == pytest.approx(0.4)


def test_models_plug_in_and_fail_softly(spark):
    df = spark.createDataFrame([(1, "Bad word"), (2, None)], "doc_id long, text string")

    def broken():
        def call(texts):
            raise RuntimeError("down")

        return call

    out = plugins.classify(plugins.classify(df, lambda: plugins.KeywordClassifier(["bad"]), "kw"), broken, "down").orderBy("doc_id").collect()
    assert [(v.model, v.label, v.prob) for v in out[0].votes] == [("kw", 1, 1.0), ("down", 0, 0.0)] and out[1].votes[0].label == 0
    e = df.select(plugins.hashed_embedding("text", 16).alias("e")).collect()
    assert len(e[0].e) == 16 and any(e[0].e) and not any(e[1].e)


def test_governor_backs_off():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    g = plugins.Governor(2, 8, clock=lambda: now[0], sleep=sleep)
    calls = []

    def request():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429 slow down")
        return "ok"

    assert g.call(request) == "ok" and g.concurrency == 2 and 5 in slept and 10 in slept
    with pytest.raises(ValueError):
        g.call(lambda: (_ for _ in ()).throw(ValueError("no")))


def test_augmentation(spark):
    df = spark.createDataFrame([(1, "a text of some length", "en"), (2, "你好世界你好世界", "zh"), (3, "abc", "en"), (4, None, "en")], "doc_id long, text string, lang string")
    one = rows(augment.insert_punctuation(df), "doc_id", "augmented")
    assert one == rows(augment.insert_punctuation(df.repartition(3)), "doc_id", "augmented")
    assert all(len(a) > len(t or "") and "".join(x for x in a if x.isalnum()) == "".join(x for x in t if x.isalnum()) for (_, a), t in zip(one[:2], ["a text of some length", "你好世界你好世界"], strict=True))
    few = dict(rows(augment.insert_punctuation(df, count=(1, 3)), "doc_id", "augmented"))
    assert few[3] == "abc" and few[4] == "" and 1 <= len(few[1]) - 21 <= 3

    embed = lambda d, c: d.withColumn("embedding", plugins.hashed_embedding(c, 32))
    translate = lambda d, c, lang: d.withColumn(c, F.when(F.lit(lang) == "de", F.concat(F.col(c), F.lit(" extra"))).otherwise(F.lit("unrelated")))
    out = augment.back_translate(df.where("doc_id = 1"), translate, [["de"], ["fr"]], embed, 0.7)
    assert rows(out, "group_id", "text", "augment_method") == [(1, "a text of some length extra", "de")]
    labelled = spark.createDataFrame([(1, "a text of some length", 1)], "row_id long, text string, y int")
    merged = augment.merge_augmented(labelled, out)
    assert rows(merged, "text", "y", "augment_method") == sorted([("a text of some length", 1, "original"), ("a text of some length extra", 1, "de")], key=str)
    batches = [["alpha beta", "gamma delta"], ["epsilon zeta", "eta theta"], ["alpha beta", "gamma delta"], ["iota"]]
    generate = lambda k: spark.createDataFrame([(k * 10 + i, t) for i, t in enumerate(batches[k])], "doc_id long, text string")
    pool, shares = augment.generate_until_redundant(spark, generate, embed, 4)
    assert shares[0] == 0 and shares[-1] == 1.0 and len(shares) == 3 and pool.count() == 4
