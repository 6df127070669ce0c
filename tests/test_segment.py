import itertools
import math
import random

import pytest

from textloom.operators import segment
from textloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))): rng.randint(1, 50) for _ in range(60)}
    rows = [*words.items(), ("ab", 7), ("日本", 30), ("日本語", 9), ("", 5), (None, 3), ("zz", 0)]
    return segment.learn(spark.createDataFrame(rows, "word string, n long"))


def cuts(text):
    for k in range(len(text)):
        for ends in itertools.combinations(range(1, len(text)), k):
            yield [text[a:b] for a, b in zip((0, *ends), (*ends, len(text)), strict=True)]


def test_the_path_is_the_likeliest(model):
    """Against all ways to cut short texts."""
    rng = random.Random(2)
    cost = lambda words: sum(model.words.get(w, model.unknown if len(w) == 1 else -math.inf) for w in words)
    for text in ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 11))) for _ in range(60)] + ["日本語日本x"]:
        path = segment.best_path(text, model)
        assert "".join(path) == text
        assert cost([w for w in path]) == pytest.approx(max(map(cost, cuts(text))))
    assert segment.best_path("", model) == []


def test_the_tags_are_the_likeliest(model):
    """Against all tags of short stretches."""

    def cost(tags, text):
        if tags[0] not in "BS" or tags[-1] not in "ES" or any(b not in segment.FOLLOWS[a] for a, b in itertools.pairwise(tags)):
            return -math.inf
        emitted = sum(model.letters.get((t, c), model.rare[t]) for t, c in zip(tags, text, strict=True))
        return model.starts[tags[0]] + emitted + sum(model.follows[p] for p in itertools.pairwise(tags))

    def tags_of(words):
        return "".join("S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E" for w in words)

    for text in ("xaby", "q", "xyzxy", "abxa", "ddxxc"):
        assert cost(tags_of(segment.tagged(text, model)), text) == pytest.approx(max(cost("".join(t), text) for t in itertools.product(segment.TAGS, repeat=len(text))))


def test_texts(spark, model):
    rows = [(1, None), (2, ""), (3, "ab! 日本語 x9"), (4, "ab" * 30_000), (5, " .")]
    found = {r.id: r.words for r in segment.segmented(spark.createDataFrame(rows, "id long, text string"), model).collect()}
    assert found[1] is None and found[2] == [] and found[5] == []
    assert "".join(found[3]) == "ab日本語x" and "日本語" in found[3]
    assert "".join(found[4]) == "ab" * 30_000
    empty = segment.learn(spark.createDataFrame([], "word string, n long"))
    assert "".join(segment.cut_words("abc", empty)) == "abc"


def test_held_out_boundaries(spark):
    rows = QUERIES["segmented_documents"](spark, "/root/testdata/sf0.01").collect()
    own, found, right = (sum(r[k] for r in rows) for k in ("n_own", "n_found", "n_right"))
    assert len(rows) > 150
    assert 2 * right / (own + found) > 0.75  # 0.76: words of four invented languages share their syllables
