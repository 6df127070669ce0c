"""Phrase collocation mining: contiguous pattern growth over projected occurrences, one task per prefix."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.ragged import WORD_LIMIT, mix, portions, released, runs
from textloom.session import cut

LEAST = 10  # occurrences of a phrase
WORDS = 3  # of the longest phrase
TOP = 2000  # phrases of a language
SHARE = 1000  # words with more than this part of all words are hot
PORTION = 6_000_000  # bytes of text whose occurrences are combined at a time
BUCKET = 500_000  # occurrences of a group of prefixes
FILTER_BITS = 1 << 26  # the most bits of the filter of frequent words, which is broadcast: 8 MB
MARK = b"."  # stands between pieces; no word holds it

_FOLD = bytes(MARK[0] if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def pieces(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased, with MARK where pieces meet."""
    return text.translate(_FOLD).replace(MARK, b" . ").split()


def _by_language(part: list, langs: list) -> dict[str, list[bytes]]:
    """The tokens of each language's texts; pieces of two texts never meet."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, part, strict=True):
        texts.setdefault(lang, []).append(text or b"")
    return {lang: pieces(MARK.join(found)) for lang, found in texts.items()}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """(lang, text) batches as tokens by language, about PORTION bytes at a time."""
    langs: list[str] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        done = 0
        for part in portions(batch.column(1), PORTION // 4):
            langs += batch.column(0).slice(done, len(part)).to_pylist()
            texts += part
            size += sum(len(t) for t in part if t)
            done += len(part)
            if size > PORTION:
                yield _by_language(texts, langs)
                langs, texts, size = [], [], 0
    if texts:
        yield _by_language(texts, langs)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f) partial counts."""
    counts: dict[str, Counter] = {}

    def flushed() -> pa.RecordBatch:
        rows = [(lang, w, f) for lang, c in counts.items() for w, f in c.items() if w != MARK]
        counts.clear()
        lang, word, f = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(f, pa.int64())], ["lang", "word", "f"])

    for by_language in _slices(batches):
        for lang, tokens in by_language.items():
            counts.setdefault(lang, Counter()).update(tokens)
        if sum(map(len, counts.values())) > 2 * WORD_LIMIT:
            yield flushed()
    yield flushed()


def _seed(salt: str, lang: str) -> int:
    """xxhash64(salt, lang) as the JVM has it: the hash of a column is the seed of the next."""
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=xxhash.xxh64_intdigest(salt, seed=42))


class Codes(dict):
    """word -> its code, xxhash64(salt, lang, word), if the filter of frequent words holds it, else 0."""

    def __init__(self, seed: int, held: np.ndarray):
        super().__init__()
        self.seed, self.held, self.mask = seed, held, len(held) * 64 - 1

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word, seed=self.seed)
        a, b = code & self.mask, (code >> 26) & self.mask
        sure = word != MARK and (int(self.held[a >> 6]) >> (a & 63)) & (int(self.held[b >> 6]) >> (b & 63)) & 1
        value = self[word] = code if sure else 0
        return value


def windows(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct occurrences, their numbers): for each word and its successor the next words up to `length`, 0 past the end of a run of frequent words."""
    padded = np.concatenate([codes, np.zeros(length, dtype=np.uint64)])
    at = np.flatnonzero((padded[:-1] != 0)[: len(codes)] & (padded[1:] != 0)[: len(codes)])
    if not len(at):
        return np.zeros((0, length), dtype=np.uint64), np.zeros(0, dtype=np.int64)
    rows = padded[at[:, None] + np.arange(length)]
    rows[np.minimum.accumulate(rows != 0, axis=1) == 0] = 0
    distinct, ids = np.unique(rows, return_inverse=True)
    ids = ids.reshape(rows.shape)
    base, span = len(distinct), len(distinct)
    key = ids[:, 0].astype(np.int64)
    for j in range(1, length):
        if span * base >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].reshape(-1)
            span = int(key.max()) + 1
        key = key * base + ids[:, j]
        span *= base
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return rows[first], counts


def _project(salt: str, held, hot, buckets: int, length: int):
    """mapInArrow function: (lang, text) to the occurrences behind each prefix, packed by bucket.

    A prefix is a first word. The occurrences of a hot one are dealt by their first two words, and where both are hot
    by the third as well, so that no bucket holds more than what a word that isn't hot has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, common = held.value, hot.value
        known: dict[str, Codes] = {}
        for by_language in _slices(batches):
            for lang, tokens in by_language.items():
                words = known.setdefault(lang, Codes(_seed(salt, lang), bits))
                codes = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
                rows, counts = windows(codes, length)
                if sum(map(len, known.values())) > 2 * WORD_LIMIT:
                    known.clear()
                if not len(rows):
                    continue
                deal = mix(rows[:, 0])
                first = np.isin(rows[:, 0], common)
                deal[first] = mix(deal[first] + rows[first, 1])
                if length > 2:
                    both = first & np.isin(rows[:, 1], common)
                    deal[both] = mix(deal[both] + rows[both, 2])
                bucket = (deal % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort([rows[:, j] for j in range(length - 1, -1, -1)] + [bucket])
                bucket, rows, counts = bucket[order], rows[order], counts[order]
                ends = np.flatnonzero(np.diff(bucket)) + 1
                starts = np.concatenate([[0], ends])
                packed = [np.ascontiguousarray(r.T).tobytes() for r in np.split(rows, ends)]
                times = [c.astype(np.uint32).tobytes() for c in np.split(counts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(packed, pa.binary()), pa.array(times, pa.binary())], ["bucket", "words", "times"])

    return released(run)


def grow(rows: np.ndarray, counts: np.ndarray, common: np.ndarray, least: int) -> tuple[list[tuple[int, ...]], list[int]]:
    """Phrases of two words and more with their occurrences, by prefix, depth first.

    Sorted occurrences make every prefix one stretch. A prefix is extended right by each next word of its stretch, and
    an extension is followed further only while it is frequent. Two hot words at the start have part of their
    occurrences here; so they are always followed, and their number is a part of the sum.
    """
    order = np.lexsort([rows[:, j] for j in range(rows.shape[1] - 1, -1, -1)])
    rows, upto = rows[order], np.concatenate([[0], np.cumsum(counts[order])])
    hot = np.isin(rows[:, :2], common).all(axis=1)
    phrases: list[tuple[int, ...]] = []
    found: list[int] = []

    def extend(prefix: tuple[int, ...], low: int, high: int) -> None:
        depth = len(prefix)
        words = rows[low:high, depth]
        starts = np.concatenate([[0], np.flatnonzero(words[1:] != words[:-1]) + 1]) + low
        ends = np.append(starts[1:], high)
        times = upto[ends] - upto[starts]
        go = (rows[starts, depth] != 0) & ((times >= least) | (hot[starts] & (depth == 1)))
        for a, b, t in zip(starts[go].tolist(), ends[go].tolist(), times[go].tolist(), strict=True):
            phrase = (*prefix, int(rows[a, depth]))
            phrases.append(phrase)
            found.append(t)
            if depth + 1 < rows.shape[1]:
                extend(phrase, a, b)

    firsts = np.concatenate([[0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1]) if len(rows) else np.zeros(0, dtype=np.int64)
    ends = np.append(firsts[1:], len(rows))
    enough = (upto[ends] - upto[firsts] >= least) | np.isin(rows[firsts, 0], common) if len(rows) else []
    for a, b, ok in zip(firsts.tolist(), ends.tolist(), enough, strict=len(rows) > 0):
        if ok:
            extend((int(rows[a, 0]),), a, b)
    return phrases, found


def _grown(hot, length: int, least: int):
    """mapInArrow function over buckets: their phrases as lists of codes with occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(columns: dict, i: int) -> tuple:
            words = np.frombuffer(columns["words"][i].as_buffer(), dtype=np.uint64).reshape(length, -1).T
            return words, np.frombuffer(columns["times"][i].as_buffer(), dtype=np.uint32)

        for _, held in runs(batches, ["bucket"], row):
            phrases, found = grow(np.concatenate([w for w, _ in held]), np.concatenate([t for _, t in held]).astype(np.int64), hot.value, least)
            flat = np.array([c for p in phrases for c in p], dtype=np.uint64).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(p) for p in phrases])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(found, pa.int64())], ["codes", "a"])

    return released(run)


def _coded(words: DataFrame) -> DataFrame:
    """Adds the code of each word, under a salt with which no two words of the table share one and none has 0."""
    salt = 0
    while True:
        coded = words.withColumns({"salt": F.lit(str(salt)), "code": F.xxhash64(F.lit(str(salt)), "lang", "word")})
        clash = coded.groupBy("code").agg(F.count("*").alias("n")).where("n > 1 or code = 0").limit(1).count()
        if not clash:
            return coded
        salt += 1


def _filter(codes: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of two bits a code; the driver gets no more than FILTER_BITS / 64 numbers."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    places = F.array(F.col("code").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("code", 26).bitwiseAND(F.lit(bits - 1)))
    placed = codes.select(F.explode(places).alias("p")).select(F.shiftright("p", 6).alias("at"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    found = placed.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", bucket: int = BUCKET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of 2 to `words` words of each language by score.

    Texts (A-Z lower-cased) are split at . , ; : ! ? and line ends into pieces, these at blanks into words. n counts a
    language's words, a, l and r a phrase's and its two parts' occurrences; a phrase has a >= `least`. Each cut scores
    floor(1,000,000 a^2 / (l r)), in decimals of 38 digits; the lowest counts, ties go to the shorter first part.
    Phrases inside a longer one with at least half their occurrences are dropped. Order: score, then a, both falling,
    then the phrase.

    1. Words are counted; each gets a 64-bit code, checked to be its own among all words of the corpus.
    2. Each occurrence of a frequent word is projected to the frequent words that follow it in its piece. Equal ones are
       combined before the shuffle; the test for frequency is a Bloom filter of bounded size, whose errors cost
       traffic only, as every count is exact.
    3. Prefixes are dealt over tasks, hot ones by their next words, and grown right, depth first.
    4. Phrases are joined with the counts of their parts, of which there are as many as frequent phrases.

    Cases: null texts are empty, a null language is `und`; texts without words add nothing; very long texts are read
    whole, a portion of whole texts at a time; repeated rows count again; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    counted = rows.mapInArrow(released(_count), "lang string, word binary, f long")
    counted = cut(counted.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("f").alias("f")))
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    coded = _coded(counted)
    frequent = cut(coded.where(F.col("f") >= least))
    salt = (frequent.select("salt").first() or ["0"])[0]
    held = spark.sparkContext.broadcast(_filter(frequent, frequent.count()))
    common = frequent.where(F.col("f") > max(1, total // SHARE)).select("code").toArrow()["code"]  # fewer than SHARE
    hot = spark.sparkContext.broadcast(common.to_numpy().view(np.uint64))
    buckets = max(spark.sparkContext.defaultParallelism, -(-total // bucket))

    projected = rows.mapInArrow(_project(salt, held, hot, buckets, words), "bucket int, words binary, times binary")
    dealt = projected.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    grown = dealt.mapInArrow(_grown(hot, words, least), "codes array<long>, a long")
    phrases = cut(grown.groupBy("codes").agg(F.sum("a").alias("a")).where(F.col("a") >= least))

    size = F.size("codes")
    inner = phrases.where(size > 2).select("a", "codes", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = inner.select("a", "codes", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("i"))
    inside = inner.groupBy(F.slice("codes", F.col("i"), F.col("m")).alias("codes")).agg(F.max("a").alias("longer"))
    free = phrases.join(inside, "codes", "left").where("longer is null or 100 * longer < 50 * a").drop("longer")

    known = frequent.select(F.array("code").alias("part"), "f").union(phrases.where(size < words).select("codes", "a"))
    cuts = free.select("codes", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("codes", F.lit(1), F.col("k")), "tail": F.slice("codes", F.col("k") + 1, size)})
    scored = cuts.join(known.select(F.col("part").alias("head"), F.col("f").alias("l")), "head").join(known.select(F.col("part").alias("tail"), F.col("f").alias("r")), "tail")
    scored = scored.withColumn("score", F.expr("(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * 1000000BD) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = scored.groupBy("codes", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelled = best.select("codes", "a", "cut", F.posexplode("codes").alias("i", "code")).join(frequent.select("code", "lang", "word"), "code")
    spelled = spelled.groupBy("codes", "a", "cut", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = spelled.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
o AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
f AS (
  SELECT lang, m, words[i:i + m - 1] AS phrase, count(*) AS a FROM o, (VALUES (1), (2), (3)) AS s(m) WHERE i + m - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
free AS (
  SELECT * FROM f WHERE m > 1 AND NOT EXISTS (
    SELECT 1 FROM f AS g WHERE g.lang = f.lang AND g.m = 3 AND f.m = 2 AND (g.phrase[1:2] = f.phrase OR g.phrase[2:3] = f.phrase) AND 100 * g.a >= 50 * f.a)),
c AS (
  SELECT free.*, k, x.a AS l, y.a AS r, free.a::HUGEINT * free.a * 1000000 // (x.a::HUGEINT * y.a) AS score
  FROM free, (VALUES (1), (2)) AS s(k), f AS x, f AS y
  WHERE k < free.m AND x.lang = free.lang AND y.lang = free.lang AND x.phrase = free.phrase[1:k] AND y.phrase = free.phrase[k + 1:free.m]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM c),
t AS (SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score FROM b WHERE cut = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT z.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""
