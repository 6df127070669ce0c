"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import math
import pickle
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.ragged import WORD_LIMIT, mix, portions, release, released
from textloom.session import cut

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, n_letters long, rejected boolean"
# What \w takes beside letters (Unicode's categories L) and decimal digits: signs such as ² ½ Ⅷ.
_NUMBERS = re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()) + "]")
_WORD = re.compile(r"[^\W\d_]+")
ORDER = 5
DOCS_PER_LANGUAGE = 400
MAX_CHARS = 20_000
SURE = 20  # letters over which the score weighs the languages
WINDOW = 32  # words of a text that are judged together
FALSE_REJECTIONS = 0.001  # share of unseen stretches of the learnt languages that may be rejected
LEAST_LIMIT = 4.0  # deviations below which nothing is rejected, however few stretches there are to calibrate with
_START, _END = "\x02", "\x03"
_P = np.uint64(0x100000001B3)


def words_of(text: str) -> list[str]:
    """Runs of letters."""
    words = _WORD.findall(text)
    return words if text.isascii() or "".join(words).isalpha() else _WORD.findall(_NUMBERS.sub(" ", text))


def _spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with their ends, the place of each within its word, and the word of each."""
    text = "".join([_START + w + _END for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    return codes, np.arange(len(codes)) - starts[owner], owner


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points that end at each place; the first n - 1 places mean nothing."""
    h = np.full(len(codes), np.uint64(n))
    for back in range(n - 1, -1, -1):
        h = (h ^ np.roll(codes, back)) * _P
        h ^= h >> np.uint64(31)
    return mix(h)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of values at the wanted keys of a sorted array, nan where a key is missing."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = values[at]
    found[keys[at] != wanted] = np.nan
    return found


def _together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted array of the keys of all languages, with a column of values for each language, nan where it lacks the key."""
    keys = np.unique(np.concatenate([k for k, _ in parts]))
    values = np.full((len(keys), len(parts)), np.nan, dtype=np.float32)
    for i, (k, v) in enumerate(parts):
        values[np.searchsorted(keys, k), i] = v
    return keys, values


class KneserNey:
    """One language: for each order a sorted array of gram hashes with log probabilities, and one of contexts with back-off weights.

    Contexts don't cross the start of a word, so that a word's log probability doesn't depend on its neighbours.
    Lower orders count distinct predecessors; grams at the start of a word, which have none, keep their own counts.
    """

    def __init__(self, words: list[str], symbols: int, order: int = ORDER):
        codes, place, _ = _spelled(words)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        kinds = []
        for n in range(1, order + 1):
            ends = np.flatnonzero(place >= max(1, n - 1))
            keys, first, counts = np.unique(_grams(codes, n)[ends], return_index=True, return_counts=True)
            kinds.append((keys, ends[first], counts))
        lower: np.ndarray | None = None
        for n in range(1, order + 1):
            keys, ends, counts = kinds[n - 1]
            if n < order:
                longer, longer_ends, _ = kinds[n]
                tails = _grams(codes, n)[longer_ends]
                before = np.zeros(len(keys), dtype=np.int64)
                np.add.at(before, np.searchsorted(keys, tails), 1)
                counts = np.where(place[ends] == n - 1, counts, before) if n > 1 else np.maximum(before, 1)
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            discount = min(max(discount, 0.05), 0.95)
            heads = np.zeros(len(keys), dtype=np.uint64) if n == 1 else _grams(codes, n - 1)[ends - 1]
            head_keys, at = np.unique(heads, return_inverse=True)
            total = np.bincount(at, weights=counts)
            kept = np.bincount(at)
            back = discount * kept / total
            if n == 1:
                below = np.full(len(keys), 1 / (symbols + 1))
            else:
                below = lower[np.searchsorted(kinds[n - 2][0], _grams(codes, n - 1)[ends])]
            p = (counts - discount).clip(0) / total[at] + back[at] * below
            lower = p
            self.grams.append((keys, np.log(p).astype(np.float32)))
            self.contexts.append((head_keys, np.log(back).astype(np.float32)))


def learnt(texts: list[str]) -> list[str]:
    """The words of a language's sample that its model is fitted on."""
    return [w for i, t in enumerate(texts) if i % 5 or len(texts) < 5 for w in words_of(t)]


def kept(texts: list[str]) -> list[str]:
    """The texts of a sample that are kept for calibration."""
    return [t for j, t in enumerate(texts) if j % 5 == 0 and words_of(t)] or [t for t in texts if words_of(t)]


def _sample(table: pd.DataFrame) -> list[str]:
    """The sample of one language in a fixed order."""
    texts = [t.lower() for _, t in sorted(zip(table["doc_id"].tolist(), table["text"].tolist(), strict=True))]
    return [t for t in texts if words_of(t)]


class LanguageModel:
    """The models of all languages with their calibration; `rows` caches what words score."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER, false_rejections: float = FALSE_REJECTIONS, models: dict[str, KneserNey] | None = None, symbols: int | None = None):
        """samples: lower-cased texts of each language; of each language every fifth is kept for calibration.

        With `models` (and the number of `symbols` they count on), samples are the kept texts alone. They are cut into
        stretches of 1, 4, 16, 64 and all of their windows. `limit` is the deviation that only the share
        `false_rejections` of these stretches exceeds.
        """
        self.languages = sorted(samples)
        self.order = order
        if models is None:
            words = {k: learnt(v) for k, v in samples.items()}
            symbols = len({c for v in words.values() for w in v for c in w}) + 1
            models = {k: KneserNey(v, symbols, order) for k, v in words.items()}
            samples = {k: kept(v) for k, v in samples.items()}
        found = [models[k] for k in self.languages]
        self.floor = -math.log(symbols + 1)
        self.grams = [_together([m.grams[n] for m in found]) for n in range(order)]
        self.contexts = [_together([m.contexts[n] for m in found]) for n in range(order)]
        self.start()
        self.mean, self.spread = np.zeros(len(self.languages)), np.ones(len(self.languages))
        stretches: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i, k in enumerate(self.languages):
            costs, sizes = [], []
            for t in samples[k]:
                own = words_of(t)
                self.learn_words(own)
                cost, size, _ = self.windows(own)
                for n in (1, 4, 16, 64, len(size)):
                    at = np.arange(0, len(size), n)
                    costs.append(np.add.reduceat(cost, at))
                    sizes.append(np.add.reduceat(size, at))
            cost, size = np.concatenate(costs), np.concatenate(sizes)
            each = cost / size
            long = size >= 100 if (size >= 100).sum() >= 5 else size > 0
            self.mean[i], self.spread[i] = np.average(each[long], weights=size[long]), max(each[long].std(), 0.02)
            stretches.append((i, each, size))
        self.limit = max(LEAST_LIMIT, float(np.quantile(np.concatenate([self.deviation(i, each, size) for i, each, size in stretches]), 1 - false_rejections, method="higher")))

    def start(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.languages)))

    def deviation(self, language: int, entropy, letters):
        """How far a cross-entropy lies above what its language has; short texts scatter more."""
        return (entropy - self.mean[language]) / np.sqrt(self.spread[language] ** 2 + 6.0 / letters)

    def windows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every WINDOW learnt words: the cost (nats) in the language that suits them best, their letters with word ends, and the cost in each language.

        A text of several known languages so costs what its parts cost, and isn't taken for one of none.
        """
        rows = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        at = np.arange(0, len(words), WINDOW)
        each = -np.add.reduceat(self.table[rows], at, axis=0)
        return each.min(axis=1), np.add.reduceat(np.fromiter(map(len, words), np.int64, len(words)) + 1, at), each

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, its end included, in each language: the longest gram that a language knows, times the back-off weights above it."""
        codes, place, owner = _spelled(words)
        hashes = [_grams(codes, n) for n in range(1, self.order + 1)]
        p = _find(*self.grams[0], hashes[0])
        logp = np.where(np.isnan(p), self.contexts[0][1][0] + np.float32(self.floor), p)
        for n in range(2, self.order + 1):
            at = np.flatnonzero(place >= n - 1)
            p = _find(*self.grams[n - 1], hashes[n - 1][at])
            back = _find(*self.contexts[n - 1], hashes[n - 2][at - 1])
            logp[at] = np.where(np.isnan(p), logp[at] + np.nan_to_num(back, nan=0.0), p)
        logp[place == 0] = 0
        return np.add.reduceat(logp.astype(np.float64), np.flatnonzero(place == 0), axis=0)

    def learn_words(self, words: list[str]) -> None:
        """Scores the words that the cache lacks, all at once."""
        index = self.index
        new = [w for w in dict.fromkeys(words) if w not in index]
        if not new:
            return
        base, end = len(index), len(index) + len(new)
        if end > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(end, 2 * len(self.table)) - len(self.table), len(self.languages)))])
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.table[base + i : base + i + len(part)] = self.score(part)
        index.update(zip(new, range(base, end), strict=True))

    def predict(self, texts: list[str]) -> list[tuple]:
        """(language, score, cross-entropy, letters, rejected) of each text."""
        if len(self.index) > WORD_LIMIT:
            self.start()
        found = [words_of(t.lower()) for t in texts]
        self.learn_words([w for words in found for w in words])
        out = []
        for words in found:
            if not words:
                out.append(("und", 0.0, None, 0, True))
                continue
            cost, size, each = self.windows(words)
            letters = int(size.sum())
            entropy = each.sum(axis=0) / letters
            best = int(np.argmin(entropy))
            weight = np.exp((entropy[best] - entropy) * min(letters, SURE))
            rejected = bool(self.deviation(best, cost.sum() / letters, letters) > self.limit)
            out.append((self.languages[best], float(1 / weight.sum()), float(entropy[best]), letters - len(words), rejected))
        return out


def predict_all(model: LanguageModel, texts: pa.Array) -> list[tuple]:
    """predict() of a column, about a million characters at a time."""
    return [p for part in portions(texts) for p in model.predict([t or "" for t in part])]


def train(docs: DataFrame, learnable, docs_per_language: int = DOCS_PER_LANGUAGE, max_chars: int = MAX_CHARS, order: int = ORDER) -> LanguageModel | None:
    """Fits the models on a bounded sample of labelled rows; None if there are none.

    About `docs_per_language` documents of each language of at most `max_chars` characters, chosen by the hash of
    their id, so the sample (and the model, which is broadcast) doesn't grow with the table. The number of rows
    of each language comes from a count over the whole table. Each language is fitted in a task of its own; the driver
    gets the models and the few texts that calibrate them.
    """
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    buckets = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(buckets, math.ceil(buckets * docs_per_language / n)))])
    picked = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(buckets)) < share[F.col("lang")])
    picked = cut(picked.select("doc_id", "lang", "text"))
    letters = picked.groupBy("lang").applyInPandas(lambda t: pd.DataFrame({"letter": sorted({c for w in learnt(_sample(t)) for c in w})}), "letter string")
    symbols = letters.distinct().count() + 1

    def fit(table: pd.DataFrame) -> pd.DataFrame:
        texts = _sample(table)
        if not texts:
            return pd.DataFrame({"lang": [], "model": [], "kept": []})
        return pd.DataFrame({"lang": table["lang"][:1], "model": [pickle.dumps(KneserNey(learnt(texts), symbols, order))], "kept": [pickle.dumps(kept(texts))]})

    fitted = picked.groupBy("lang").applyInPandas(fit, "lang string, model binary, kept binary").collect()
    model = LanguageModel({r["lang"]: pickle.loads(r["kept"]) for r in fitted}, order, models={r["lang"]: pickle.loads(r["model"]) for r in fitted}, symbols=symbols) if fitted else None
    del fitted
    release()
    return model


def language_id(docs: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, cross_entropy, n_letters, rejected. No shuffle.

    Without a model, one is trained on the rows whose crc32(doc_id) mod 5 is not 0. The language with the lowest
    cross-entropy per letter over the whole text wins. score is its weight among all languages over a stretch of SURE
    letters with that cross-entropy: letters aren't independent, and over a whole text the weight would be 1 for nearly
    all. A row is rejected if it has no letter, or if its cost per letter, each WINDOW words in the language that suits
    them best, lies further above the language's mean than a limit that FALSE_REJECTIONS of the stretches of documents
    that the models have not seen exceed.

    Cases: null text, or text without a letter: `und`, score 0, rejected; ties go to the first language by name; no
    labelled row to learn from: all rows `und`; null id: not held out and never learnt from; repeated rows are
    predicted each; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    model = model or train(rows, fold != 0)
    held = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    if model is None:
        return rows.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(0).cast("long").alias("n_letters"), F.lit(True).alias("rejected"))
    model.start()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    clear = lambda: shared.value.start()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict_all(shared.value, batch.column(2))
            lang, score, entropy, letters, rejected = zip(*found, strict=True) if found else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(letters, pa.int64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "n_letters", "rejected"],
            )

    return rows.select("doc_id", held, "text").mapInArrow(released(run, clear), SCHEMA)


def language_filter(docs: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that language_id() doesn't reject, with all their columns. No shuffle; Python gets the texts only.

    Cases: null text, or text without a letter, goes; without a labelled row to learn from, nothing else does; rows
    with a null id or language are judged as all others; repeated rows stay or go together; an empty table gives no
    rows; columns may have any name.
    """
    if model is None:
        fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
        model = train(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), fold != 0)
    if model is None:
        return docs.where(F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    model.start()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    clear = lambda: shared.value.start()

    @F.arrow_udf("boolean")
    def accepted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = released(lambda some: (pa.array([not p[4] for p in predict_all(shared.value, batch)], pa.bool_()) for batch in some), clear)
        yield from run(texts)

    return docs.where(accepted(F.col(text_col)))
