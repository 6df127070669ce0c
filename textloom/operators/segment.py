"""Words of texts written without blanks: the likeliest path of dictionary words, and letter tags where the dictionary ends."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

SIZE = 200_000  # words of a dictionary, the most frequent ones: the bound of what is broadcast
SLICE = 1 << 18  # bytes of texts that a task turns into Python's objects at a time
TAGS = "BMES"  # a letter begins, continues or ends a word, or is one
FOLLOWS = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}  # fixed by what the tags mean


@dataclass
class Words:
    """Log probabilities: of words, of unknown letters, and of the letters and successions of tags."""

    words: dict[str, float]
    unknown: float
    starts: dict[str, float]
    follows: dict[tuple[str, str], float]
    letters: dict[tuple[str, str], float]
    rare: dict[str, float]
    found: ahocorasick.Automaton | None = field(default=None, repr=False)

    def automaton(self) -> ahocorasick.Automaton:
        if self.found is None:
            self.found = ahocorasick.Automaton()
            for word, p in self.words.items():
                self.found.add_word(word, (len(word), p))
            self.found.make_automaton()
        return self.found


def learn(words: DataFrame, size: int = SIZE) -> Words:
    """The model of a table (word, n). Counts of words, tags and letters are aggregates; the driver gets `size` words, and a
    row for each letter of the script and tag.

    Words that are null or empty, or whose n is below 1, don't count. Ties at the end of the dictionary go by the word.
    """
    known = words.where("word is not null and word <> '' and n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    total = known.agg(F.sum("n")).first()[0] or 0
    kept = known.orderBy(F.desc("n"), "word").limit(size).collect() if total else []
    last = F.char_length("word")
    tag = F.when(last == 1, "S").when(F.col("at") == 1, "B").when(F.col("at") == last, "E").otherwise("M")
    placed = known.withColumn("at", F.explode(F.sequence(F.lit(1), last))).select(tag.alias("tag"), F.substring("word", F.col("at"), F.lit(1)).alias("letter"), "n")
    letters = {(r["tag"], r["letter"]): r["n"] for r in placed.groupBy("tag", "letter").agg(F.sum("n").alias("n")).collect()}
    tags = {t: sum(n for (own, _), n in letters.items() if own == t) for t in TAGS}
    begun = max(1, tags["B"] + tags["S"])
    starts = {t: _log((tags[t] + 1) / (begun + 2)) for t in "BS"}
    # of the letters that follow B or M, as many are E as words end; the words of two letters have no M
    pairs = {"B": (tags["B"] - _twos(known), _twos(known)) if total else (0, 0)}
    pairs["M"] = (tags["M"] - pairs["B"][0], tags["E"] - pairs["B"][1])
    follows = {(t, u): _log((n + 1) / (sum(pairs[t]) + 2)) for t in "BM" for u, n in zip("ME", pairs[t], strict=True)}
    follows |= {(t, u): starts[u] for t in "ES" for u in "BS"}
    script = len({letter for _, letter in letters}) + 1
    return Words(
        {r["word"]: _log(r["n"] / total) for r in kept}, _log(1 / max(2, total)), starts, follows,
        {(t, letter): _log((n + 1) / (tags[t] + script)) for (t, letter), n in letters.items()}, {t: _log(1 / (tags[t] + script)) for t in TAGS},
    )


def _log(p: float) -> float:
    return math.log(p) if p > 0 else -1e9


def _twos(words: DataFrame) -> int:
    return words.where(F.char_length("word") == 2).agg(F.sum("n")).first()[0] or 0


def best_path(text: str, model: Words) -> list[str]:
    """The words of the path with the highest sum of log probabilities; a letter that begins no word on it costs `unknown`."""
    n = len(text)
    score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    ends: dict[int, list[tuple[int, float]]] = {}
    if len(model.words):
        for end, hit in model.automaton().iter(text):
            ends.setdefault(end + 1, []).append(hit)
    for i in range(1, n + 1):
        best, at = score[i - 1] + model.unknown, i - 1
        for size, p in ends.get(i, ()):
            if score[i - size] + p > best or (score[i - size] + p == best and i - size < at):
                best, at = score[i - size] + p, i - size
        score[i], back[i] = best, at
    out = []
    while n:
        out.append(text[back[n] : n])
        n = back[n]
    return out[::-1]


def tagged(text: str, model: Words) -> list[str]:
    """The words of a stretch that the dictionary lacks: the likeliest tags of its letters."""
    emit = lambda t, c: model.letters.get((t, c), model.rare[t])
    rows = [{t: (model.starts.get(t, -math.inf) + emit(t, text[0]), "") for t in TAGS}]
    for c in text[1:]:
        last = rows[-1]
        rows.append({t: max((last[s][0] + model.follows[s, t] + emit(t, c), s) for s in TAGS if t in FOLLOWS[s]) for t in TAGS})
    tag = max("ES", key=lambda t: rows[-1][t][0])
    tags = [tag]
    for row in rows[:0:-1]:
        tag = row[tag][1]
        tags.append(tag)
    out = [""]
    for c, t in zip(text, tags[::-1], strict=True):
        if t in "BS" and out[-1]:
            out.append("")
        out[-1] += c
    return out


def cut_words(text: str, model: Words) -> list[str]:
    """best_path(), with its stretches of unknown letters cut by tagged()."""
    out: list[str] = []
    odd = ""
    for word in [*best_path(text, model), ""]:
        if len(word) == 1 and word not in model.words:
            odd += word
            continue
        if odd:
            out += tagged(odd, model)
            odd = ""
        if word:
            out.append(word)
    return out


def slices(column: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """A batch in parts of about `size` bytes, one row at least: what a task holds as Python's own objects."""
    if not len(column):
        return
    rows = max(1, size * len(column) // max(1, column.get_total_buffer_size()))
    for i in range(0, len(column), rows):
        yield column.slice(i, rows)


def segmented(docs: DataFrame, model: Words, text: str = "text", out: str = "words") -> DataFrame:
    """Adds the words of each text, blanks and all else that isn't a letter being ends of words. The model is broadcast once; no shuffle.

    Null texts have null words; texts without letters have none; texts of any length are cut whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<string>")
    def words(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            done = [pa.array([], pa.list_(pa.string()))]
            for some in slices(part):
                found = []
                for t in some.to_pylist():
                    runs = "".join(c if c.isalpha() else " " for c in t).split() if t is not None else []
                    found.append([w for run in runs for w in cut_words(run, shared.value)] if t is not None else None)
                done.append(pa.array(found, pa.list_(pa.string())))
            yield pa.concat_arrays(done)

    return docs.withColumn(out, words(F.col(text)))


@F.arrow_udf(ArrayType(IntegerType()))
def boundaries(words: pa.Array) -> pa.Array:
    """Where words end in the text without blanks, the last end left out; none for no words or null."""
    done = [pa.array([], pa.list_(pa.int32()))]
    for part in slices(words):
        out = []
        for some in part.to_pylist():
            ends = np.cumsum([len(w) for w in some or []], dtype=np.int32)
            out.append(ends[:-1])
        done.append(pa.array(out, pa.list_(pa.int32())))
    return pa.concat_arrays(done)
