import hashlib

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.distributions import f_tail, incomplete_beta, t_tail


@pytest.fixture
def value(spark):
    """The value of a column expression over one row of strings."""

    def of(expression, **row):
        df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)) if row else spark.range(1)
        return df.select(expression.alias("v")).first()["v"]

    return of


@pytest.mark.parametrize(
    ("clean", "text", "expected"),
    [
        (T.clean_zh, "你好!! http://x.y/z 世界 abc　12", "你好 世界 abc 12"),
        (T.clean_ja, "カタカナ・ひらがな漢字ー１２!! https://a.b", "カタカナ・ひらがな漢字ー１２"),
        (T.clean_en, "Hello​World www.a.b me@x.y\nIt's A-1 & é", "hello world it's a-1"),
        (T.clean_en, None, ""),
        (T.squeeze, " a　\t\n b ", "a b"),
    ],
)
def test_cleaners(value, clean, text, expected):
    assert value(clean("t"), t=text) == expected


def test_language_codes_and_guess(value):
    assert value(T.language_code("t"), t=" JP ") == "ja" == value(T.language_code("t"), t="ja")
    assert [value(T.guess_language("t"), t=x) for x in ("これはペン", "漢字漢字abc", "a漢字bcdefgh", None)] == ["ja", "zh", "en", "en"]


def test_labels(value):
    assert [value(T.label_strict("t"), t=x) for x in ("是", " YES", "0", "否", "maybe", None)] == [1, 1, 0, 0, None, None]
    assert [value(T.label_lenient("t"), t=x) for x in ("是", "2.7", "no", "maybe", None)] == [1, 2, 0, 0, 0]


def test_fingerprint_keeps_cjk(value):
    assert value(T.fingerprint("t", F.lit("zh")), t="圣母/圣母 婊_A") == "圣母圣母婊a"
    assert value(T.fingerprint("t", F.lit("jp")), t="騙した") == "騙し"
    assert value(T.fingerprint("t", F.lit("ja")), t="見る") == "見る"


def test_keys_ids_and_labels(value):
    key = value(T.classification_key("p", "x", "l", "t"), p=" a  b ", x="c" * 300, l="JP", t="Ü")
    assert key == '{"context":"' + "c" * 220 + '","lang":"jp","predicate":"a b","target":"ü"}'
    assert value(T.record_id("a", "b"), a="x", b=None) == hashlib.sha1(b"x||").hexdigest()
    assert value(T.short_label("t"), t="x" * 40) == "x" * 27 + "…" and value(T.short_label("t"), t="short") == "short"
    assert value(T.named_count("t"), t="Big (old) name(12)").asDict() == {"name": "Big (old) name", "count": 12}
    assert value(T.named_count("t"), t="none") is None


@pytest.mark.parametrize(("text", "expected"), [('["A", "B"]', ["A", "B"]), ("['A', 'It\\'s']", ["A", "It's"]), ("A, B,, C", ["A", "B", "C"]), ("[A, B]", ["A", "B"]), ("", []), (None, [])])
def test_entity_lists(value, text, expected):
    assert value(T.entity_list("t"), t=text) == expected


def test_keywords_are_literal(value):
    assert value(T.contains_any("t", ["a.c", "x+y"]), t="abc") is False
    assert value(T.contains_any("t", ["a.c", "X+y"]), t="1x+Y2") is True
    assert value(T.contains_any("t", []), t="a") is False and value(T.contains_any("t", ["a"]), t=None) is False
    assert value(T.hit_words("t", ["Ab", "c", "b"]), t="xABx") == ["Ab", "b"]


def test_without_keeps_repeats(value):
    assert value(T.without(F.split("t", " "), ["the"]), t="a the a 12 b1 the") == ["a", "a", "b1"]


def test_p_values():
    assert T.p_value(0.0) == "<4.941e-324" and T.p_value(0.0123) == "1.230e-02" and T.p_value(float("nan")) == "nan"


def test_tails_against_published_values():
    assert f_tail(4.10, 2, 10) == pytest.approx(0.05, abs=2e-4)  # F table, 5 %
    assert f_tail(7.56, 2, 10) == pytest.approx(0.01, abs=1e-4)
    assert t_tail(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert t_tail(0, 5) == 1 and f_tail(0, 1, 1) == 1 and f_tail(1e9, 3, 3000) < 1e-300
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)  # 1 - P(Binomial(4, 0.4) < 2)
