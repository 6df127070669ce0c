import math

import pytest
from pyspark.sql import functions as F

from textloom.operators import similarity as V
from textloom.operators import statistics as S
from textloom.operators import tables as J


def test_flags_and_equality(spark):
    df = spark.createDataFrame([(1, 1, 1, " Yes"), (2, 1, 0, "no"), (3, None, 1, None)], "id int, a int, b int, t string")
    ids = lambda d: [r.id for r in d.orderBy("id").collect()]
    assert ids(J.flags(df, ["a", "b"])) == [1] and ids(J.flags(df, any_of=["a", "b"])) == [1, 2, 3] and ids(J.flags(df, ["b"], ["a"])) == [1]
    assert ids(df.where(J.equals_any_case("t", "YES"))) == [1]


def test_products(spark):
    found = J.product_rows(spark.createDataFrame([("x",), ("y",)], "subject string"), spark.createDataFrame([("is",), ("was",)], "predicate string"))
    assert sorted(r.text for r in found.collect()) == ["x is", "x was", "y is", "y was"]


def test_translations(spark):
    df = spark.createDataFrame([("Green",), ("blue hill",), ("赤",), ("青",), ("黒",)], "name string")
    cache = spark.createDataFrame([("青", "Blue")], "key string, value string")
    asked = []

    def plugin(todo):
        asked.extend(r.key for r in todo.collect())
        return todo.where("key = '黒'").select("key", F.lit("Black").alias("value"))

    found = {r.name: r.translated for r in J.translate_names(df, "name", {"green": "Verde"}, cache, plugin).collect()}
    assert found == {"Green": "Verde", "blue hill": "Blue Hill", "赤": "赤", "青": "Blue", "黒": "Black"} and sorted(asked) == ["赤", "黒"]
    assert J.translate_names(df, "name", {}).where("name = '赤'").first()["translated"] == "赤"


def test_losses_and_votes(spark):
    df = spark.createDataFrame([(0.3, 1.0, "HATE", 0.9), (-40.0, 1.0, "ok", 0.8), (800.0, 0.0, None, None)], "x double, y double, l string, s double")
    loss = [r.v for r in df.select(S.focal_loss("x", "y").alias("v")).collect()]
    p = 1 / (1 + math.exp(-0.3))
    assert loss[0] == pytest.approx(0.25 * (1 - p) ** 2 * -math.log(p)) and loss[1] == pytest.approx(0.25 * 40) and loss[2] == pytest.approx(0.75 * 800)
    assert [tuple(r.v) for r in df.select(S.vote_rule("l", "s", ["hate"]).alias("v")).collect()] == [(1, 0.9), (0, 0.8), (0, 0.0)]


def test_topics(spark):
    rows = [(i, [float(i % 3 == 0) * 5 + (i % 7) * 0.01, float(i % 3 == 1) * 5, float(i % 3 == 2) * 5], ["a", "b"] if i % 2 else ["c", "d"]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, tokens array<string>")
    found = V.bisecting_topics(df, 3, "embedding", components=2)
    assert found.columns == [*df.columns, "topic"] and found.select("topic").distinct().count() == 3
    assert {r.topic for r in V.bisecting_topics(df, 3, "embedding", least=1000).collect()} == {-1}
    placed, words = V.word_topics(df, 2)
    assert placed.count() == 60 and words.count() == 2 and set(words.first()["words"]) <= {"a", "b", "c", "d"}
