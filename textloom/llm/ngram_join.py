"""Jaccard self-join on word 5-grams: MinHash buckets, Bayesian pruning of candidates, exact verification."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.blocks import classed, linked, numbered, star_edges
from textloom.llm.components import deal
from textloom.llm.ragged import WordHash, lists, mix, portions, released
from textloom.operators.graph import components
from textloom.session import cut, packed

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
GRAM = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5  # a pair at 0.8 shares no band with probability (1 - 0.8^5)^40 = 1e-7
HASHES = BANDS * ROWS
STEP = 40  # MinHash values compared at a time
TOLERANCE = 1e-9
BLOCK = 4096  # sets of a block
GRAMS = 4_000_000  # and their grams: 32 MB of hashes
_words = WordHash()


def shingles(text: str | None, gram: int = GRAM) -> np.ndarray:
    """Sorted hashes of a text's distinct word n-grams; a text of fewer words has one of all its words, none if it has no word."""
    ids = np.fromiter(map(_words.__getitem__, WORD.findall((text or "").lower())), np.uint64)
    n = min(gram, len(ids))
    if not n:
        return ids
    h = np.full(len(ids) - n + 1, np.uint64(n))
    for i in range(n):
        h = mix(h + ids[i : len(ids) - n + 1 + i])
    return np.unique(h)


def digest(grams: np.ndarray) -> bytes:
    """128 bits that stand for a set of grams."""
    return xxhash.xxh3_128_digest(grams.tobytes())


_draw = np.random.default_rng(20240229)
_A = (_draw.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _draw.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]
_BAND = _draw.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def minhash(grams: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of a set that isn't empty."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[i : i + 2048] * _A + _B).min(axis=1), out=out)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A bucket for each band, as signed 64-bit numbers."""
    mixed = mix(signature.reshape(BANDS, ROWS).astype(np.uint64) * _BAND + np.uint64(0x9E3779B9))
    return mix(mixed.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def least_matches(compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The least number of equal MinHash values with which a pair stays.

    With a uniform prior, P(J >= t | m of n equal) = P(Binomial(n + 1, t) <= m); pairs below the tolerance go.
    """
    total = 0.0
    for m in range(compared + 1):
        total += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if total >= tolerance:
            return m
    return compared


class Comparer:
    """compare() of linked(): Jaccard >= threshold between two lists of (grams, MinHash values)."""

    def __init__(self, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, tile: int = 256):
        self.threshold, self.tile = threshold, tile
        self.least = {n: least_matches(n, threshold, tolerance) for n in range(STEP, HASHES + 1, STEP)}

    def __call__(self, left: list, right: list) -> np.ndarray:
        sizes = [np.array([len(g) for g, _ in side]) for side in (left, right)]
        hashes = [np.stack([m for _, m in side]) for side in (left, right)]
        columns = np.ascontiguousarray(hashes[1].T)
        near = np.zeros((len(left), len(right)), dtype=bool)
        for top in range(0, len(left), self.tile):
            end = min(top + self.tile, len(left))
            a, b = sizes[0][top:end, None], sizes[1][None, :]
            alive = (np.minimum(a, b) >= self.threshold * np.maximum(a, b)) & (a > 0)
            if left is right:
                alive &= np.arange(top, end)[:, None] < np.arange(len(right))[None, :]
            same = np.zeros(alive.shape, dtype=np.uint16)
            for k in range(STEP):
                same += hashes[0][top:end, k, None] == columns[k]
            i, j = np.nonzero(alive & (same >= self.least[STEP]))
            count = same[i, j].astype(np.int64)
            for n in range(STEP, HASHES, STEP):
                if not len(i):
                    break
                for part in range(0, len(i), 200_000):
                    s = slice(part, part + 200_000)
                    count[s] += (hashes[0][top + i[s], n : n + STEP] == hashes[1][j[s], n : n + STEP]).sum(axis=1)
                stay = count >= self.least[n + STEP]
                i, j, count = i[stay], j[stay], count[stay]
            if len(i):
                both = self.overlaps(left, right, top + i, j)
                union = sizes[0][top + i] + sizes[1][j] - both
                hit = both >= self.threshold * union - 1e-9
                near[top + i[hit], j[hit]] = True
        if left is right:
            near |= near.T
        return near

    @staticmethod
    def overlaps(left: list, right: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact sizes of the intersections of the pairs (i, j)."""
        rows, at = np.unique(i, return_inverse=True)
        cols, to = np.unique(j, return_inverse=True)
        if len(i) < 4 * (len(rows) + len(cols)):
            return np.array([len(np.intersect1d(left[a][0], right[b][0], assume_unique=True)) for a, b in zip(i, j, strict=True)])
        flat = [np.concatenate([side[k][0] for k in own]) for side, own in ((left, rows), (right, cols))]
        owner = [np.repeat(np.arange(len(own)), [len(side[k][0]) for k in own]) for side, own in ((left, rows), (right, cols))]
        shared = np.intersect1d(*map(np.unique, flat), assume_unique=True)
        total = np.zeros((len(rows), len(cols)), dtype=np.float32)
        at_shared = []
        for f in flat:
            pos = np.minimum(np.searchsorted(shared, f), max(len(shared) - 1, 0))
            at_shared.append(np.where(shared[pos] == f, pos, -1) if len(shared) else np.full(len(f), -1))
        for start in range(0, len(shared), 2048):
            ones = []
            for s, o, n in zip(at_shared, owner, (len(rows), len(cols)), strict=True):
                here = (s >= start) & (s < start + 2048)
                m = np.zeros((n, min(2048, len(shared) - start)), dtype=np.float32)
                m[o[here], s[here] - start] = 1
                ones.append(m)
            total += ones[0] @ ones[1].T
        return total[at, to].astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to (doc_id, key, text) the digest, the size and the band keys of the text's set, about a million characters at a time."""
    for batch in batches:
        done = 0
        for part in portions(batch.column(2)):
            digests, sizes, keys = [], [], []
            for text in part:
                grams = shingles(text)
                digests.append(digest(grams) if len(grams) else None)
                sizes.append(len(grams))
                keys.append(band_keys(minhash(grams)) if len(grams) else np.zeros(0, np.int64))
            _words.trim()
            flat = lists(np.concatenate(keys), np.array([len(k) for k in keys], dtype=np.int64), pa.int64())
            own = batch.slice(done, len(part))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), flat], ["doc_id", "key", "digest", "size", "keys"])
            done += len(part)


def _load(columns: dict, i: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The grams and MinHash values of a row; None if it isn't the row that its digest was made of (a repeated id)."""
    grams = shingles(columns["text"][i].as_py())
    _words.trim()
    return (grams, minhash(grams)) if len(grams) and digest(grams) == columns["digest"][i].as_py() else None


def _classes(docs: DataFrame, threshold: float, block: int, id_col: str, text_col: str, key: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with a set: doc_id, key, set_id, class_id, links, component; and doc_id and key of the rows without an id or a word.

    `key` may tell rows of one id apart; it is carried along. A component is a class, and unlike its class_id never
    stands for two.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))
    sketched = cut(rows.mapInArrow(released(_sketch, _words.clear), "doc_id long, key binary, digest binary, size long, keys array<long>"))
    usable = sketched.where("doc_id is not null and digest is not null")
    sets = numbered(usable.groupBy("digest").agg(F.min("doc_id").alias("set_id"), F.count("*").alias("mult"), F.first("size").alias("size")))
    ends = sets.join(usable.select("digest", F.col("doc_id").alias("set_id"), "keys"), ["digest", "set_id"]).select("node", "keys")
    members = cut(sets.join(components(star_edges(ends)), "node"))
    dealt = deal(members, block, "size", GRAMS)
    texts = dealt.join(rows.select(F.col("doc_id").alias("set_id"), "text"), "set_id")
    found = linked(texts, _load, Comparer(threshold), _words.clear)
    classes = classed(sets, found, "set_id").select("digest", "set_id", "class_id", "links", "component")
    out = sketched.select("doc_id", "key", "digest").where("doc_id is not null and digest is not null").join(classes, "digest").drop("digest")
    return out, sketched.where("doc_id is null or digest is null").select("doc_id", "key")


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, set_id, class_id, n_links, kept.

    Rows link when their sets of word 5-grams (words of op2's form, lower-cased; a shorter text is one gram) have a
    Jaccard similarity of at least `threshold`. set_id is the smallest id with the same set, n_links the number of other
    rows linked directly, class_id the smallest id reachable by links, kept = (doc_id = class_id).

    1. Rows become MinHash bands and a digest of their set; equal sets collapse before anything is compared, and each
       set gets a number of its own, so that an id which stands for several texts joins nothing.
    2. Sets that share a band hang below the smallest number of the bucket: linear in the rows for any bucket size.
       Connected components of these edges hold every candidate pair.
    3. Each component goes to a task (a large one, by its sets or their grams, to a task for each pair of blocks) with
       its texts, where pairs are dropped by size, then by MinHash values compared STEP at a time while the posterior
       probability of reaching the threshold is at least TOLERANCE, and the rest is verified exactly on the sets.
       Tasks emit counts, not pairs.

    Sets are compared by 64-bit hashes of their grams. A pair at the threshold goes unseen with probability 1e-7.

    Cases: null or empty text, or text without a word: no links, a class of its own; a null id: never compared, null
    set_id and class_id, kept; repeated rows count as separate rows of the same set; an id that stands for different
    texts has a row for each, with the links and the class of that text; equal similarities need no order; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    linked_rows, alone = _classes(docs, threshold, block, id_col, text_col, F.lit(None).cast("binary"))
    done = linked_rows.select("doc_id", "set_id", "class_id", F.col("links").alias("n_links"), (F.col("doc_id") == F.col("class_id")).alias("kept"))
    return done.union(alone.select("doc_id", F.col("doc_id").alias("set_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept")))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of ngram_join(), with all its columns: the one with the smallest id.

    Cases: rows without an id are kept, all of them; texts without a word (null and empty ones among them) are classes
    of their own; of rows with the same id and text one stays; of an id that stands for different texts, one row of each
    class whose smallest id it is; equal ids in a class go to the smaller digest of the text; an empty table gives no
    rows; columns may have any name.
    """
    key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    found, alone = _classes(docs, threshold, block, id_col, text_col, key)
    first = found.where("doc_id = class_id").groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.*")
    winners = first.union(alone.where("doc_id is not null").distinct())
    keyed = docs.select(packed(docs).alias("row"), F.col(id_col).cast("long").alias("doc_id"), key.alias("key"))
    # repeated rows meet in the same place, so that dropping them needs no shuffle of its own
    stay = keyed.join(winners, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    return stay.select("row").union(keyed.where("doc_id is null").select("row")).select("row.*")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' ')))) AS grams
  FROM w WHERE len(words) > 0),
sets AS (SELECT grams, min(doc_id) AS set_id, count(*) AS mult, len(grams) AS size FROM s GROUP BY grams),
g AS (SELECT set_id, size, unnest(grams) AS gram FROM sets),
pairs AS (
  SELECT a.set_id AS x, b.set_id AS y FROM g a JOIN g b ON a.gram = b.gram AND a.set_id <> b.set_id
  GROUP BY a.set_id, b.set_id, a.size, b.size HAVING 5 * count(*) >= 4 * (a.size + b.size - count(*))),
reach AS (SELECT set_id AS node, set_id AS low FROM sets UNION SELECT p.y, r.low FROM reach r JOIN pairs p ON p.x = r.node),
classes AS (SELECT node, min(low) AS class_id FROM reach GROUP BY node),
links AS (SELECT x, sum(mult) AS n FROM pairs JOIN sets ON set_id = y GROUP BY x)
SELECT s.doc_id, sets.set_id, class_id, CAST(coalesce(n, 0) + mult - 1 AS BIGINT) AS n_links, s.doc_id = class_id AS kept
FROM s JOIN sets USING (grams) JOIN classes ON node = sets.set_id LEFT JOIN links ON x = sets.set_id
UNION ALL
SELECT doc_id, doc_id, doc_id, 0, true FROM w WHERE len(words) = 0
"""
