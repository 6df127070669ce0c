import random
import time

import public_tokenizers
from tokenizers import Tokenizer

from textloom.llm.token_counts import WordBpe, token_counts

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["", " ", "<|startoftext|>hello<|endoftext|> world's I'LL", "aaaaaaaaaaa bbbbbbbbbbbb aaaa aaaaaaa", "日本語テキスト ÀÉ é 12345 ½ ² Ⅷ", "x y　z\u0085w\x1cq", "İstanbul ΣΑΣ", "<|StartOfText|>", "a<|endoftext|>b<|startoftext", "😀👨‍👩‍👧 don't''s", "\x00\x01", "ſ ǅ 𝔘", "word " * 20_000, "q" * 5000]


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abcthe inger'sé1!? \n<|>") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    assert WordBpe(PATH).count(texts) == library(texts)


def test_query_columns_and_cases(docs_of):
    rows = [*enumerate(ODD), (None, "no id"), (50, None), (51, "twice"), (51, "twice"), (52, "a " * 2049)]
    found = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs_of(rows), PATH).collect()}
    texts = [t or "" for _, t in rows]
    assert found == {(d, len(t.encode()), n, n > 2048) for (d, _), t, n in zip(rows, texts, library(texts), strict=True)}
    assert token_counts(docs_of(rows), PATH).count() == len(rows)
    assert token_counts(docs_of([]), PATH).collect() == []


def test_long_words_equal_the_library():
    rng = random.Random(4)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "acgt", "abcdefghijklmnopqrstuvwxyz", "eé日t", "a") for n in (255, 256, 257, 300, 1000, 4001)]
    texts += ["".join(rng.choice(["the", "ing", "er", "q", "and"]) for _ in range(2000)), " ".join("x" * n for n in range(240, 300))]
    assert WordBpe(PATH).count(texts) == library(texts)


def test_a_million_letters():
    rng = random.Random(5)
    for letters in ("acgt", "abcdefghijklmnopqrstuvwxyz"):
        text = "".join(rng.choice(letters) for _ in range(1_000_000))
        began = time.time()
        found = WordBpe(PATH).count([text])
        assert time.time() - began < 20
        assert found == library([text])
