"""Model replies, batches, factories, shared rates and the tables behind charts."""

import threading

import pytest
from pyspark.sql import functions as F

from textloom.operators import plugins, replies
from textloom.operators.match import Rules
from textloom.plans import export
from textloom.plans.stages import how_labels

RULES = Rules({"moral_accusation": ["bad"], "institutional_rot": ["rotten"]}, ["the"], [], {"en": r"\b(?:bad|rotten|fine)\b"})


def test_replies_are_parsed_or_left(spark):
    rows = [("Sure:\n```json\n{\"1\": \"a\", \"2\": \"b\"}\n```",), ("{\"x\": {\"1\": \"inner\"}}",), ("no object",), ("{broken",), ("{\"1\": broken}",), (None,), ("",)]
    found = [r[0] for r in spark.createDataFrame(rows, "r string").select(replies.reply_map("r")).collect()]
    assert found == [{"1": "a", "2": "b"}, {"1": "inner"}, None, None, None, None, None]
    lists = [('Here: [{"text": " A B ", "category": "X"}, {"text": "C"}, {"category": "no text"}] and [1]',), ("[]",), ("none",), ('[{"text": "cut',), (None,)]
    found = [[tuple(e) for e in r[0]] for r in spark.createDataFrame(lists, "r string").select(replies.reply_entities("r")).collect()]
    assert found == [[("A B", "X", "llm"), ("C", "Unknown", "llm")], [], [], [], []]


def test_batches_answer_every_row(spark):
    df = spark.range(103).select(F.col("id").cast("string").alias("classification_key"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("predicate"), F.lit("ctx bad").alias("context"), F.lit("en").alias("lang"), F.lit("t").alias("target")).repartition(3)

    def model():
        def ask(items):
            assert len(items) <= 10 and set(items[0]) == {"predicate", "context", "lang", "target"}
            n = [int(x["predicate"].split()[1]) for x in items]
            if any(k % 50 == 0 for k in n):
                raise OSError("429")
            if any(k % 17 == 0 for k in n):
                return "I can't say"
            return "{" + ", ".join(f'"{i}": "{"institutional_rot" if k % 2 else "unheard of"}"' for i, k in enumerate(n, 1) if k % 3) + "}"

        return ask

    found = {int(r.classification_key): r.frame_type for r in replies.classify_in_batches(df, model, RULES, size=10).collect()}
    assert sorted(found) == list(range(103))
    assert all(found[k] == "moral_accusation" for k in (0, 17, 34, 50, 100))  # by the rules
    assert {"institutional_rot", "other"} <= set(found.values()) <= {"institutional_rot", "other", "moral_accusation"}
    assert all(k % 2 == 1 and k % 3 for k, v in found.items() if v == "institutional_rot")
    assert replies.numbered_prompt([{"a": 1, "b": None}, {"a": 2}], "Say:") == "Say:\n1. a: 1\n2. a: 2"


def test_labels_come_from_replies_and_the_cache(spark):
    docs = spark.createDataFrame([(1, 0, "en", "the dog is bad and rotten"), (2, 0, "en", "a dog was fine")], "doc_id long, topic int, lang string, text string")
    words = spark.createDataFrame([(0, ["dog"])], "topic int, terms array<string>")
    model = lambda: lambda items: "{" + ", ".join(f'"{i}": "social_exclusion"' for i in range(1, len(items) + 1)) + "}"
    first = how_labels(docs, words, RULES, lambda todo: replies.classify_in_batches(todo, model, RULES)).collect()
    assert {r.frame_type for r in first} == {"social_exclusion"} and len(first) == 3
    cache = spark.createDataFrame([(r.classification_key, "dehumanization") for r in first], "key string, value string")
    asked = []
    again = how_labels(docs, words, RULES, lambda todo: asked.append(todo.count()) or replies.classify_in_batches(todo, model, RULES), cache).collect()
    assert asked == [0] and {r.frame_type for r in again} == {"dehumanization"}


def test_models_by_name_and_failures(spark, tmp_path, monkeypatch):
    (tmp_path / "some_models").mkdir()
    (tmp_path / "some_models" / "__init__.py").write_text("")
    (tmp_path / "some_models" / "one.py").write_text("from textloom.operators.plugins import factory\n\n\n@factory('Upper')\ndef upper():\n    return lambda: lambda texts: [t.upper() for t in texts]\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert {"keywords", "upper"} <= set(plugins.discover("some_models"))
    assert plugins.make("upper")()(["a"]) == ["A"]
    assert plugins.make("Keywords", keywords=["x"])()(["x y"])[0]["label"] == 1
    with pytest.raises(KeyError, match="known"):
        plugins.make("absent")

    def broken():
        def model(texts):
            if "b" in texts:
                raise ValueError("no")
            return [len(t) for t in texts]

        return model

    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").repartition(2, "doc_id")
    found = {r.doc_id: (r.n, r.failed) for r in plugins.apply_model(df, broken, "text", "n", "int", -1, "failed").collect()}
    assert found[2] == (-1, True) and found[1] in ((1, False), (-1, True))


def test_threads_and_tasks_share_a_rate(spark):
    clock = [0.0]
    governor = plugins.Governor(5, 4, clock=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s))
    seen, lock = [], threading.Lock()

    def request(i):
        def run():
            with lock:
                seen.append(i)
            return i * i

        return run

    assert governor.map([request(i) for i in range(40)]) == [i * i for i in range(40)]
    assert sorted(seen) == list(range(40)) and clock[0] >= 6.5  # five at once, then five a second
    assert plugins.rate_of_a_task(spark.range(10).repartition(2), 8.0) == 4.0


def test_tables_behind_charts(spark, tmp_path):
    how = spark.createDataFrame([(1, 0, "en", "t", "dog", "bad", "moral_accusation", "window", "bad"), (2, 1, "de", "t", "cat", "is", "noise", "window", "is"), (3, 1, "de", "t", "cat", "rotten", "institutional_rot", "window", "rotten")], "doc_id long, topic int, lang string, text string, target string, predicate string, frame_type string, layer string, verb string")
    why = spark.createDataFrame([(i, i % 2, "en" if i % 3 else "de", i / 10, 1 - i / 7) for i in range(12)], "doc_id long, topic int, lang string, bias_a double, bias_b double")
    who = spark.createDataFrame([(0, "en", ["dog"], {"dog": 2})], "topic int, lang string, targets array<string>, target_counts map<string,bigint>")
    result = export.Result(who=who, how=how, why=why, run_id="r")
    tables = export.chart_tables(result)
    assert len(tables) == 10 and {(r.target, r.frame_type, r["count"]) for r in tables["how_target_by_frame"].collect()} == {("dog", "moral_accusation", 1), ("cat", "institutional_rot", 1)}
    files = export.export(result, str(tmp_path), ("charts",))
    assert len(files) == 10 and all((tmp_path / f"r_chart_{name}.csv").read_text(encoding="utf-8-sig").count("\n") > 1 for name in tables)
    assert export.chart_tables(export.Result()) == {}
