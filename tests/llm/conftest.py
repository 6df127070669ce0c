import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, component int, key string, n int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with extra columns whose names the operators use inside; every column may be null."""

    def make(rows):
        full = [(*(list(r) + [None] * (5 - len(r))), "x", 1, 2, "k", None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Synthetic prose with exact copies, near copies, chains of near copies, shared passages, short and empty texts."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for _ in range(120):
        texts.append([rng.choice(vocab) for _ in range(rng.randint(1, 300))])
    for _ in range(80):
        words = list(rng.choice(texts[:60]))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(words)
    for _ in range(60):
        texts.append(passage + [rng.choice(vocab) for _ in range(rng.randint(0, 200))])
    base = [rng.choice(vocab) for _ in range(250)]
    for i in range(70):
        words = list(base)
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(words)
    out = [" ".join(t) for t in texts] + ["", " \n", "!!!", "one two", "one  two", "ONE two."]
    out += [texts[0] and " ".join(texts[0]).upper() + "."]
    return [*enumerate(out), (10_000, None), (10_001, " ".join(texts[5])), (10_001, " ".join(texts[5])), (None, " ".join(texts[5]))]
