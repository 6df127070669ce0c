import math
import random
import zlib

import numpy as np
import pytest

from textloom.llm.language_id import KneserNey, LanguageModel, _grams, _spelled, language_filter, language_id, words_of

SYLLABLES = {"aa": "ba ke lo mi nu".split(), "bb": "tra sche ung keit zu".split(), "cc": "cion mente ado ñar el".split()}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def test_probabilities_sum_to_one():
    rng = random.Random(1)
    words = prose(rng, "bb", 300).split()
    symbols = sorted({c for w in words for c in w})
    model = LanguageModel({"bb": [" ".join(words)]})
    one = KneserNey(words, len(symbols) + 1)
    assert all(np.all(np.diff(k.astype(object)) > 0) for k, _ in one.grams)
    for prefix in ("", "t", "tra", "schezu", "qx"):
        # a word's score is the product over its letters and its end; compare continuations of one prefix
        head = model.score([prefix])[0, 0]
        codes, place, owner = _spelled([prefix])
        assert len(_grams(codes, 3)) == len(codes)
        end = _step(model, prefix, None)
        total = end + sum(_step(model, prefix, c) for c in symbols) + _step(model, prefix, "☃")
        assert math.isclose(total, 1, rel_tol=1e-3), (prefix, total, head)


def _step(model, prefix, letter):
    """P(letter or end | prefix) from whole-word scores."""
    end = lambda w: model.score([w])[0, 0]
    without = end(prefix) - _last(model, prefix)
    if letter is None:
        return math.exp(_last(model, prefix))
    word = prefix + letter
    return math.exp(end(word) - _last(model, word) - without)


def _last(model, word):
    """log P(end | word), from the model's own arrays."""
    codes, place, owner = _spelled([word])
    hashes = [_grams(codes, n) for n in range(1, model.order + 1)]
    at = len(codes) - 1
    logp = None
    for n in range(1, model.order + 1):
        if place[at] < n - 1:
            break
        keys, values = model.grams[n - 1]
        i = np.searchsorted(keys, hashes[n - 1][at])
        if i < len(keys) and keys[i] == hashes[n - 1][at]:
            logp = float(values[i, 0])
        elif n == 1:
            logp = float(model.contexts[0][1][0, 0]) + model.floor
        else:
            keys, values = model.contexts[n - 1]
            i = np.searchsorted(keys, hashes[n - 2][at - 1])
            logp += float(values[i, 0]) if i < len(keys) and keys[i] == hashes[n - 2][at - 1] else 0.0
    return logp


def test_held_out_accuracy_and_rejection(docs_of):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang := "aabbcc"[i % 3 * 2 : i % 3 * 2 + 2], rng.randint(5, 80)), lang) for i in range(300)]
    rows += [(900, None, "aa"), (901, "123 !?", "bb"), (902, "", None), (None, prose(rng, "aa", 30), "aa"), (903, prose(rng, "bb", 30), None), (904, "щука жила была " * 40, None), (905, prose(rng, "cc", 20_000), None), (906, "x", None), (906, "x", None)]
    found = language_id(docs_of(rows)).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    held = [(by[i].lang_pred, lang) for i, _, lang in rows[:300] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 30 and sum(a == b for a, b in held) == len(held)
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in by if i is not None)
    assert {(by[i].lang_pred, by[i].score, by[i].rejected) for i in (900, 901, 902)} == {("und", 0.0, True)}
    assert by[None].held_out is False and by[None].lang_pred == "aa"
    assert by[903].lang_pred == "bb" and by[905].lang_pred == "cc" and by[904].rejected
    assert not any(by[i].rejected for i in [*range(300), 903, 905])
    assert all(0 <= r.score <= 1 for r in found)
    kept = language_filter(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(r.doc_id) for r in found if not r.rejected)


def test_nothing_to_learn_from(docs_of):
    assert [r.lang_pred for r in language_id(docs_of([(1, "abc"), (2, None)])).collect()] == ["und", "und"]
    assert language_id(docs_of([])).collect() == language_filter(docs_of([])).collect() == []
    assert [r.doc_id for r in language_filter(docs_of([(1, "abc"), (2, None), (3, "1")])).collect()] == [1]


def test_labels_sources_and_ids_are_no_inputs(docs_of):
    rng = random.Random(4)
    rows = [(i, prose(rng, "aabbcc"[i % 3 * 2 : i % 3 * 2 + 2], 40), "aabbcc"[i % 3 * 2 : i % 3 * 2 + 2], f"s{i % 3}") for i in range(90)]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    changed = [(i, t, "zz" if i in held else lang, "other") for i, t, lang, _ in rows]
    a = {r.doc_id: (r.lang_pred, r.score) for r in language_id(docs_of(rows)).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in language_id(docs_of(changed)).collect()}
    assert a == b


class Plain:
    """Interpolated Kneser-Ney with plain dictionaries: lower orders count predecessors, but for the starts of words."""

    def __init__(self, words, symbols, order=5):
        self.order, self.symbols = order, symbols
        raw = [{} for _ in range(order + 1)]
        for w in words:
            s = "<" + w + ">"
            for end in range(1, len(s)):
                for n in range(1, min(order, end + 1) + 1):
                    gram = s[end + 1 - n : end + 1]
                    raw[n][gram] = raw[n].get(gram, 0) + 1
        self.counts = [{} for _ in range(order + 1)]
        for n in range(1, order + 1):
            before = {}
            for gram in raw[n + 1] if n < order else ():
                before[gram[1:]] = before.get(gram[1:], 0) + 1
            for gram, k in raw[n].items():
                own = n == order or (n > 1 and gram[0] == "<")
                self.counts[n][gram] = k if own else max(before.get(gram, 0), 1) if n == 1 else before.get(gram, 0)
        self.discount, self.totals = [0.0] * (order + 1), [{} for _ in range(order + 1)]
        for n in range(1, order + 1):
            once, twice = (sum(k == x for k in self.counts[n].values()) for x in (1, 2))
            self.discount[n] = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)
            for gram, k in self.counts[n].items():
                total, kinds = self.totals[n].get(gram[:-1], (0, 0))
                self.totals[n][gram[:-1]] = total + k, kinds + 1

    def p(self, context, letter):
        """P(letter | context): the context's own estimate, and what it leaves to the shorter one."""
        n = len(context) + 1
        below = self.p(context[1:], letter) if n > 1 else 1 / (self.symbols + 1)
        if context not in self.totals[n]:
            return below
        total, kinds = self.totals[n][context]
        return max(self.counts[n].get(context + letter, 0) - self.discount[n], 0) / total + self.discount[n] * kinds / total * below

    def score(self, word):
        s = "<" + word + ">"
        return sum(math.log(self.p(s[max(0, i - self.order + 1) : i], s[i])) for i in range(1, len(s)))


def test_equals_plain_dictionaries():
    rng = random.Random(3)
    samples = {lang: [prose(rng, lang, 60) for _ in range(20)] for lang in SYLLABLES}
    model = LanguageModel(samples)
    fit = {k: [w for i, t in enumerate(v) if i % 5 for w in words_of(t)] for k, v in samples.items()}
    symbols = len({c for v in fit.values() for w in v for c in w}) + 1
    plain = {k: Plain(v, symbols) for k, v in fit.items()}
    words = [*fit["aa"][:40], *fit["bb"][:40], *fit["cc"][:40], "x", "q", "qqqqqqq", "ünïcödé", "bakelo" * 20, "e"]
    found = model.score(words)
    for i, lang in enumerate(model.languages):
        assert np.allclose(found[:, i], [plain[lang].score(w) for w in words], rtol=2e-4, atol=2e-4)


def test_letters_are_letters_only(docs_of):
    rng = random.Random(6)
    rows = [(i, prose(rng, "aabbcc"[i % 3 * 2 : i % 3 * 2 + 2], 30), "aabbcc"[i % 3 * 2 : i % 3 * 2 + 2]) for i in range(60)]
    signs = [(500 + i, t) for i, t in enumerate(["²", "½", "①", "Ⅷ", "٣", "_", "²½ 12 _", "⅓ Ⅻ", "😀", "\u0301"])]
    letters = [(600 + i, t) for i, t in enumerate(["a²", "ª", "ʰ", "一", "ǅ"])]
    found = {r.doc_id: r for r in language_id(docs_of(rows + signs + letters)).collect()}
    assert all((found[d].lang_pred, found[d].score, found[d].n_letters, found[d].rejected) == ("und", 0.0, 0, True) for d, _ in signs)
    assert all(found[d].lang_pred != "und" and found[d].n_letters == 1 for d, _ in letters)
    kept = {r.doc_id for r in language_filter(docs_of(signs + letters)).collect()}  # no label, so no model
    assert kept == {d for d, _ in letters}


def test_false_and_true_rejections():
    rng = random.Random(7)
    samples = {lang: [prose(rng, lang, rng.randint(20, 200)) for _ in range(100)] for lang in SYLLABLES}
    model = LanguageModel(samples)
    own = model.predict([prose(rng, lang, rng.randint(1, 300)) for lang in SYLLABLES for _ in range(400)])
    assert sum(p[4] for p in own) <= 6
    mixed = model.predict([prose(rng, "aa", 64) + " " + prose(rng, "bb", 64) for _ in range(50)])
    assert not any(p[4] for p in mixed)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(40, 400))) for _ in range(200)] + ["щука жила " * n for n in (3, 30)] + [rng.randbytes(n).hex() for n in (20, 200)]
    assert all(p[4] for p in model.predict(junk))


def test_whole_query_equals_plain_dictionaries(spark):
    """op3 on every row of sf0.001: the language and the cross-entropy that plain models, learnt from the same texts, give."""
    from textloom.llm.queries import op3_language_id

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = {}
    for doc_id, text, lang in sorted((r for r in rows if None not in r), key=lambda r: r[:2]):
        if zlib.crc32(str(doc_id).encode()) % 5 and len(text) <= 20_000 and words_of(text.lower()):
            texts.setdefault(lang, []).append(text.lower())
    fit = {k: [w for i, t in enumerate(v) if i % 5 or len(v) < 5 for w in words_of(t)] for k, v in texts.items()}
    symbols = len({c for v in fit.values() for w in v for c in w}) + 1
    plain = {k: Plain(v, symbols) for k, v in fit.items()}
    scores = {k: {} for k in plain}
    found = {r.doc_id: r for r in op3_language_id(spark, sf).collect()}
    assert len(found) == len(rows)
    for doc_id, text, _ in rows:
        words = words_of((text or "").lower())
        if not words:
            assert found[doc_id].lang_pred == "und"
            continue
        cost = {k: -sum(scores[k][w] if w in scores[k] else scores[k].setdefault(w, m.score(w)) for w in words) / sum(len(w) + 1 for w in words) for k, m in plain.items()}
        best = min(cost, key=cost.get)
        assert found[doc_id].cross_entropy == pytest.approx(cost[best], abs=2e-4)
        assert found[doc_id].lang_pred == best or cost[found[doc_id].lang_pred] - cost[best] < 4e-4
