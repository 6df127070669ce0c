import time
import csv
import datetime
import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators.match import Rules
from textloom.plans import export as X
from textloom.plans import orchestrate as O
from textloom.plans import stages
from textloom.sinks import writers as W
from textloom.sources import lexicons, readers
from textloom.streaming import incremental as R


def test_csv_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"line\none ""q"""\n2,b\n', encoding="utf-8")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), strings=True)
    assert [tuple(r) for r in df.collect()] == [("1", 'line\none "q"'), ("2", "b")] and readers.text_column(df) == "text"
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), "id int, text string").schema["id"].dataType.typeName() == "integer"
    (tmp_path / "b.csv").write_bytes("编号\t文本\n1\t你好\n".encode("gb18030"))
    assert [tuple(r) for r in readers.read_sniffed(spark, str(tmp_path / "b.csv")).collect()] == [("1", "你好")]
    (tmp_path / "c.tsv").write_text("id\ttext\textra\n1\thello\tx\n2\t \ty\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_posts(spark, str(tmp_path / "c.tsv"), "src").collect()] == [("1", "hello", "src")]
    assert readers.read_glob(spark, str(tmp_path / "a*.csv")).first()["file"].endswith("a.csv")
    assert readers.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "a.csv")]) == str(tmp_path / "a.csv")
    assert readers.first_existing(spark, [str(tmp_path / "no")]) is None


def test_json_and_array_readers(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"en": ["a", " b ", "a"], "jp": ["c", ""]}', encoding="utf-8")
    assert {tuple(r) for r in lexicons.read_keywords(spark, str(tmp_path / "k.json")).collect()} == {("en", "a"), ("en", "b"), ("jp", "c")}
    (tmp_path / "stop.txt").write_text("the\n# remark\n a \n\nthe\n", encoding="utf-8")
    assert {r.word for r in lexicons.read_stop_words(spark, str(tmp_path / "stop.txt")).collect()} == {"the", "a"}
    (tmp_path / "p.json").write_text('{"1": {"post_tokens": ["a", "b"], "annotators": [{"target": ["X"]}, {"target": ["Y"]}]}, "2": {"post_tokens": ["c"], "annotators": [{"target": ["Z"]}]}}', encoding="utf-8")
    assert [tuple(r) for r in readers.read_annotated_posts(spark, str(tmp_path / "p.json"), "Y").collect()] == [("1", "a b")]
    (tmp_path / "s.json").write_text('{"cat": [{"en": "one", "zh": "一", "ja": ""}, {"en": "two"}]}', encoding="utf-8")
    assert {tuple(r) for r in readers.read_parallel_suite(spark, str(tmp_path / "s.json")).collect()} == {("cat", "cat-0", "en", "one"), ("cat", "cat-0", "zh", "一"), ("cat", "cat-1", "en", "two")}
    np.savez(tmp_path / "m.npz", harm=np.arange(3.0), fairness=np.ones((2, 3)))
    np.save(tmp_path / "v.npy", np.eye(2))
    found = {(r.name, r.row): list(r.vector) for r in readers.read_arrays(spark, str(tmp_path / "m.npz")).union(readers.read_arrays(spark, str(tmp_path / "v.npy"))).collect()}
    assert found[("harm", 0)] == [0, 1, 2] and found[("fairness", 1)] == [1, 1, 1] and found[("v", 1)] == [0, 1]
    with gzip.open(tmp_path / "l.json.gz", "wt", encoding="utf-8") as f:
        f.write('{"text": "a"}\nbroken\n{"text": "b"}\n')
    assert [r.text for r in readers.read_json_lines(spark, str(tmp_path / "l.json.gz"), "text string").collect()] == ["a", "b"]


def test_corpora(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text God {i}" if i % 2 else "none", "en" if i % 3 else "ja") for i in range(60)], "doc_id long, text string, lang string")
    found = readers.filtered_corpus(df, ["God"], 250, 3)
    assert found.count() == 30 and found.columns == ["text", "char_count"] and readers.filtered_corpus(df, ["god"]).count() == 0
    assert readers.filtered_corpus(df, ["God"], cap=4).count() == 4
    quota = readers.quota_per_shard(df, 4, 5)
    assert all(r["count"] <= 5 for r in quota.groupBy("shard").count().collect())
    df.write.parquet(str(tmp_path / "a.parquet"))
    registry = [{"name": "one", "path": str(tmp_path / "a.parquet"), "column": "text", "lang": "en"}, {"name": "two", "path": str(tmp_path / "a.parquet"), "column": "doc_id", "lang": "ja"}]
    assert {(r.lang, r["count"]) for r in readers.read_registry(spark, registry, 7).groupBy("lang").count().collect()} == {("en", 7), ("ja", 7)}


def test_pages(spark):
    html = "<html><head><title> A &\n B </title><style>x</style></head><body><!-- no --><p>One &lt;two&gt;</p><script>bad()</script><a class=k href='/u?x=1'>three</a> 3 < 4</body></html>"
    r = spark.createDataFrame([(html,), (None,)], "html string").select(readers.page_text("html").alias("t"), readers.page_title("html").alias("h"), readers.page_links("html").alias("l")).collect()
    assert r[0].t == "A & B One <two> three 3 < 4" and r[0].h == "A & B" and r[0].l == ["/u?x=1"]
    assert r[1].t == "" and r[1].l == []


@pytest.mark.parametrize("start", ["<script>", "<!--", "<div", "<a ", "<title>", "<title", "<a href"])
def test_pages_of_what_is_never_closed(spark, start):
    page = "<p>first</p>" + start * (4_000_000 // len(start))
    began = time.time()
    df = spark.createDataFrame([(page,)], "html string")
    found = df.select(readers.page_text("html").alias("text"), readers.page_title("html"), readers.page_links("html")).first()
    assert found.text.startswith("first")
    assert time.time() - began < 30


def test_configuration(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("# remark\ninput: a.csv\nstages:\n  who: true\n  how: false\nwho:\n  top_n: 3\nexport:\n  formats: [jsonl, csv]\nratio: 0.5\nname: 'x'\n", encoding="utf-8")
    assert readers._plain_yaml(path.read_text())["export"] == {"formats": ["jsonl", "csv"]}
    cfg = readers.load_config(str(path), {"input": "b.csv", "who": {"top_n": None}}, {"output": "o", "who": {"min": 2}})
    assert cfg["input"] == "b.csv" and cfg["stages"] == {"who": True, "how": False} and cfg["who"] == {"min": 2, "top_n": 3} and cfg["ratio"] == 0.5 and cfg["output"] == "o" and cfg["name"] == "x"
    assert readers.load_config(str(tmp_path / "none.yaml")) == {}
    ns = O.arguments(["--input", "i", "--only", "who", "--lang", "ja", "--config", str(path)])
    assert O.configuration(ns)["stages"] == {"who": True, "how": False, "why": False} and O.configuration(ns)["lang"] == "ja"
    with pytest.raises(SystemExit):
        O.arguments(["--only", "who", "--skip", "how"])


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "你, \"q\"", ["a"]), (1, None, [])], "id int, text string, tags array<string>")
    path = W.write_csv_file(df, str(tmp_path / "o/x.csv"), order=["id"])
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf")
    with open(path, encoding="utf-8-sig", newline="") as f:
        assert list(csv.reader(f)) == [["id", "text", "tags"], ["1", "", "[]"], ["2", '你, "q"', '["a"]']]
    assert spark.read.option("header", True).option("escape", '"').csv(W.write_csv(df, str(tmp_path / "d"))).count() == 2
    lines = [json.loads(r.value) for r in spark.read.text(W.write_jsonl(df, str(tmp_path / "j"))).collect()]
    assert {"id": 1, "text": None, "tags": []} in lines
    assert W.append_new(df.select("id"), str(tmp_path / "t.parquet"), "id") == 2
    assert W.append_new(spark.createDataFrame([(1,), (3,), (3,)], "id int"), str(tmp_path / "t.parquet"), "id") == 1
    cache = W.KeyedCache(spark, str(tmp_path / "cache"))
    assert cache.load().count() == 0
    cache.put(spark.createDataFrame([("a", "1"), ("b", "1")], "key string, value string"))
    cache.put(spark.createDataFrame([("b", "2"), ("c", "2")], "key string, value string"))
    assert {tuple(r) for r in cache.load().collect()} == {("a", "1"), ("b", "2"), ("c", "2")}
    assert "| a\\|b |" in W.markdown_table([{"k": "a|b"}] * 3, limit=2) and "1 more" in W.markdown_table([{"k": "a|b"}] * 3, limit=2) and W.markdown_table([]) == "_no rows_\n"
    assert W.run_id(datetime.datetime(2024, 1, 2, 3, 4, 5)) == "20240102_030405"


RULES = Rules({"moral_accusation": ["hypocrite", "伪善"], "dehumanization": ["pest"]}, ["think"], [], {"en": r"\b(?:deceiv|cheat)\w*\b", "zh": "欺骗|掩盖", "ja": "騙す"})
GAZETTEER = [("green club", "group"), ("绿社", "group"), ("緑会", "group")]


@pytest.fixture
def documents(spark):
    rows = []
    for i in range(12):
        rows += [(i * 4, "The Green Club deceived us, hypocrite people", "en", 0), (i * 4 + 1, "绿社 欺骗 大家 伪善", "zh", 0), (i * 4 + 2, "緑会 は 騙す", "jp", 1), (i * 4 + 3, "Green Club again", "en", -1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, topic int")


@pytest.fixture
def axes(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(k, [float(x) for x in rng.normal(size=64)]) for k in ("harm", "fairness")], "axis string, vec array<double>")


def test_run_from_end_to_end(spark, documents, axes, tmp_path):
    inputs = O.Inputs(gazetteer=GAZETTEER, rules=RULES, axes=axes)
    result = O.run(spark, documents, inputs, {"work": str(tmp_path / "work")})
    assert result.stages_run == ["who", "how", "why"] and not result.errors
    assert result.stats == {"total_documents": 48, "topic_count": 2, "language_counts": {"en": 24, "zh": 12, "ja": 12}}
    # targets come from the entity column, noise topics stay out, and jp is ja in every layer
    who = {(r.topic, r.lang): r for r in result.who.collect()}
    assert set(who) == {(0, "en"), (0, "zh"), (1, "ja")} and who[0, "zh"].targets == ["绿社"] and who[0, "en"].target_counts["The Green Club"] == 12
    how = {(r.lang, r.verb): r.frame_type for r in result.how.collect()}
    assert how == {("en", "deceived"): "moral_accusation", ("zh", "欺骗"): "moral_accusation", ("ja", "騙す"): "other"}
    assert {"bias_harm", "bias_fairness"} < set(result.why.columns) and result.why.count() == 36 and {r.axis for r in result.anova.collect()} == {"bias_harm", "bias_fairness"}
    docs = X.merged_documents(result).collect()
    assert len(docs) == 36 and all(set(r.why) == {"harm", "fairness"} and r.text and r.how.frame_type for r in docs)
    assert {tuple(r.who) for r in docs if r.lang == "ja"} == {("緑会",)}
    files = X.export(result, str(tmp_path / "out"))
    assert len(files) == 7
    report = open(files[-1], encoding="utf-8").read()
    assert all(x in report for x in ("## WHO", "## HOW", "## WHY", "moral_accusation"))
    summary = {(r.topic, r.lang): r for r in X.summary_rows(result).collect()}
    assert summary[0, "en"].how_dominant_frame == "moral_accusation" and summary[0, "en"].how_frame_count == 12 and summary[1, "ja"].why_harm_mean is not None
    pct = X.how_summary(result.how).groupBy("lang").agg(F.sum("pct_in_lang").alias("s")).collect()
    assert all(r.s == pytest.approx(100, abs=0.1) for r in pct)
    meta = json.load(open(files[1], encoding="utf-8"))
    assert meta["how_record_count"] == 36 and meta["why_record_count"] == 36 and set(meta["why_axis_means"]) == {"harm", "fairness"}
    # a later run that skips layers reads what is there
    cached = O.run(spark, documents, inputs, {"work": str(tmp_path / "work"), "viz_only": True})
    assert cached.stages_run == ["who_cached", "how_cached", "why_cached"] and cached.how.count() == 36
    none = O.run(spark, documents, inputs, {"stages": {"who": False, "how": False, "why": False}})
    assert none.stages_run == [] and X.export(none, str(tmp_path / "none"))


def test_one_language_for_all_layers(spark, documents, axes):
    result = O.run(spark, documents, O.Inputs(gazetteer=GAZETTEER, rules=RULES, axes=axes), {"lang": "ja"})
    assert result.stats["total_documents"] == 12
    assert {r.lang for r in result.who.collect()} == {r.lang for r in result.how.collect()} == {r.lang for r in result.why.collect()} == {"ja"}


def test_failures_are_recorded_unless_strict(spark, documents):
    inputs = O.Inputs(gazetteer=GAZETTEER, rules=RULES)
    result = O.run(spark, documents, inputs)
    assert result.stages_run == ["who", "how"] and result.errors[0]["stage"] == "why" and result.why is None
    with pytest.raises(ValueError):
        O.run(spark, documents, inputs, {"strict": True})


def test_noise_never_reaches_the_export(spark, documents):
    labelled = spark.createDataFrame([(1, 0, "en", "t", "x", "go", "go", "noise", "window", 0), (2, 0, "en", "t2", "x", "lie", "lie", "other", "window", 0)], "doc_id long, topic int, lang string, text string, target string, verb string, predicate string, frame_type string, layer string, ord int")
    r = X.Result(how=labelled)
    assert [d.text for d in X.merged_documents(r).collect()] == ["t2"] and X.frame_counts(labelled) == {"other": 1}


def test_plug_ins_enrich_only_rows_with_few_entities(spark, documents):
    asked = []

    def enrich(df):
        asked.append(df.count())
        return df.withColumn("more", F.array(F.struct(F.lit("green club").alias("text"), F.lit("X").alias("label"), F.lit("llm").alias("source")), F.struct(F.lit("New Group").alias("text"), F.lit("X").alias("label"), F.lit("llm").alias("source"))))

    found = stages.who_entities(stages.prepare(documents), GAZETTEER, enrich=enrich, least=1).collect()
    assert asked == [0] and not any(r.llm_enriched for r in found)
    found = stages.who_entities(stages.prepare(documents), GAZETTEER, enrich=enrich, least=2).collect()
    assert any(r.llm_enriched and "New Group" in r.targets for r in found)


def test_labels_come_from_cache_then_model_then_rules(spark, documents):
    docs = stages.prepare(documents)
    vocabulary = spark.createDataFrame([(0, ["green club", "绿社"]), (1, ["緑会"])], "topic int, terms array<string>")
    plain = stages.how_labels(docs, vocabulary, RULES)
    assert stages.instances(plain).count() == 3
    key = plain.where("lang = 'zh'").first()["classification_key"]
    cache = spark.createDataFrame([(key, "institutional_rot")], "key string, value string")
    seen = []

    def classify(todo):
        seen.extend(r.lang for r in todo.collect())
        return todo.select("classification_key", F.lit("dehumanization").alias("frame_type"))

    found = {r.lang: r.frame_type for r in stages.how_labels(docs, vocabulary, RULES, classify, cache).collect()}
    assert found == {"zh": "institutional_rot", "en": "dehumanization", "ja": "dehumanization"} and sorted(seen) == ["en", "ja"]


def test_command_line(spark, documents, axes, tmp_path, capsys):
    documents.write.parquet(str(tmp_path / "docs.parquet"))
    axes.write.parquet(str(tmp_path / "axes.parquet"))
    (tmp_path / "rules.json").write_text(json.dumps({"frames": RULES.frames, "actions": RULES.actions}), encoding="utf-8")
    (tmp_path / "gaz.json").write_text(json.dumps({"categories": {"group": ["green club", "绿社", "緑会"]}}), encoding="utf-8")
    base = ["--input", str(tmp_path / "docs.parquet"), "--output", str(tmp_path / "out"), "--rules", str(tmp_path / "rules.json"), "--gazetteer", str(tmp_path / "gaz.json")]
    assert O.main([*base, "--axes", str(tmp_path / "axes.parquet")], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 7
    assert O.main(["--input", str(tmp_path / "nothing.csv")], spark) == 1
    assert O.main([*base, "--strict"], spark) == 2


# -- streams ----------------------------------------------------------------------------------------------------------


def test_filtered_append_goes_on_after_a_restart(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "doc_id long, text string"

    def feed(*texts, start):
        spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], schema).write.mode("append").parquet(source)
        R.append_to(R.filtered(R.stream_files(spark, source, schema), ["God"]), sink, state).awaitTermination()
        return sorted(r.doc_id for r in spark.read.parquet(sink).collect())

    assert feed("God a", "none", start=0) == [0]
    assert feed("b God", "God c", start=10) == [0, 10, 11]


def test_seen_keys_survive_restarts(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for keys in ([1, 1, 2], [2, 3]):
        spark.createDataFrame([(k,) for k in keys], "uid long").write.mode("append").parquet(source)
        R.append_to(R.first_seen(R.stream_files(spark, source, "uid long"), ["uid"]), sink, state).awaitTermination()
    assert sorted(r.uid for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_late_rows_within_the_watermark_are_seen(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t), (1, t + datetime.timedelta(minutes=1)), (2, t)], "uid long, ts timestamp").write.parquet(source)
    R.append_to(R.first_seen(R.stream_files(spark, source, "uid long, ts timestamp"), ["uid"], "ts", "10 minutes"), sink, state).awaitTermination()
    assert spark.read.parquet(sink).count() == 2


def test_quotas(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(i * 10 + j, "en" if j % 3 else "ja") for j in range(10)], "id long, lang string").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: R.stream_files(spark, source, "id long, lang string", files_per_batch=1)
    R.append_until(stream(), str(tmp_path / "a"), str(tmp_path / "as"), 13).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "a")).count() == 13
    R.append_until(stream(), str(tmp_path / "b"), str(tmp_path / "bs"), 5, "lang").awaitTermination()
    found = {r.lang: r["count"] for r in spark.read.parquet(str(tmp_path / "b")).groupBy("lang").count().collect()}
    assert found == {"en": 5, "ja": 5}


def test_labels_are_asked_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    asked = []

    def label(df):
        asked.extend(r.key for r in df.collect())
        return df.withColumn("label", F.lit("x"))

    for keys in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(k,) for k in keys], "key string").write.mode("append").parquet(source)
        R.append_labels(R.stream_files(spark, source, "key string"), label, sink, state, "key").awaitTermination()
    assert sorted(asked) == ["a", "b", "c"] == sorted(r.key for r in spark.read.parquet(sink).collect())


def test_unfinished_rows(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    progress = spark.createDataFrame([(1, "de"), (1, "fr"), (2, "de"), (2, "de")], "id long, path string")
    assert sorted(r.id for r in R.unfinished(rows, progress, "id", 2).collect()) == [2, 3]
