"""Token counts of a BPE vocabulary by rank-synchronous merging over ragged numpy arrays."""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.ragged import WORD_LIMIT, portions, released

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_NONE = np.int64(2**62)
LONG = 256  # bytes of a word whose places are kept by rank


class WordBpe:
    """A BPE model with word ends, read from a tokenizers JSON file.

    Supports the file's own parts: NFC, white space replaced, lower case; a split by one pattern whose matches are the
    words; byte-level symbols; an end-of-word suffix; special strings found in the raw text count as one token each.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or model["continuing_subword_prefix"]:
            raise ValueError(f"not a vocabulary of words with ends: {path}")
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(map(regex.escape, sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True))) or r"(?!)")
        letters = _byte_letters()
        self.inner = np.array([vocab.get(letters[b], -1) for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab.get(letters[b] + suffix, -1) for b in range(256)], dtype=np.int64)
        self.size = np.int64(max(vocab.values()) + 1)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        keys = np.array([a * int(self.size) + b for a, b, _ in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int64)
        self.made = np.array([c for _, _, c in pairs], dtype=np.int64)  # by rank
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it has none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank_of[at], _NONE)

    def merge(self, words: list[str]) -> np.ndarray:
        """The number of symbols that survive in each word.

        All words lie in one flat array of symbols with their owners. A round finds every word's lowest rank and
        applies that pair at all its places in the word at once, leftmost first where places overlap, as a merge of
        one rank can only make new places for pairs of other symbols. Symbols the vocabulary lacks count as none.
        Words of more than LONG bytes go to sweep(), where a round costs what it merges and not the whole word.
        """
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        long = np.fromiter((len(w) > LONG for w in raw), bool, len(raw))
        if long.any():
            out = np.zeros(len(raw), dtype=np.int64)
            out[~long] = self.merge([w for w, far in zip(words, long, strict=True) if not far])
            out[long] = self.sweep([w for w in raw if len(w) > LONG])
            return out
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        owner = np.repeat(np.arange(len(raw)), lengths)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends[lengths > 0]] = self.last[flat[ends[lengths > 0]]]
        done = np.zeros(len(raw), dtype=np.int64)
        names = np.arange(len(raw))
        known = symbols >= 0
        symbols, owner = symbols[known], owner[known]
        while len(symbols):
            rank = np.full(len(symbols), _NONE)
            if len(symbols) > 1:
                same = owner[1:] == owner[:-1]
                rank[:-1][same] = self.ranks(symbols[:-1][same], symbols[1:][same])
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(symbols)])
            idle = lowest == _NONE
            done[names[owner[first[idle]]]] += sizes[idle]
            low = np.repeat(lowest, sizes)
            at = np.flatnonzero((rank == low) & (low != _NONE))
            if not len(at):
                break
            at = _apart(at)
            symbols[at] = self.made[rank[at]]
            stay = np.repeat(~idle, sizes)
            stay[at + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return done

    def sweep(self, raw: list[bytes]) -> np.ndarray:
        """merge() of long words: the ranks of all words go up together, and each meets its places only.

        A merge makes places for pairs of its own new symbol alone, and those have higher ranks than the one that made
        the symbol. So every rank has one round, over the places that are filed under it; symbols are linked to
        their neighbours, and only the pairs beside a merge get a new rank.
        """
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        owner = np.repeat(np.arange(len(raw)), lengths)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        known = symbols >= 0
        symbols, owner = symbols[known], owner[known]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.r_[owner[1:] != owner[:-1], True][:n]
        after[last] = -1
        before[np.flatnonzero(last[:-1]) + 1] = -1
        before[:1] = -1
        alive = np.ones(n, dtype=bool)
        rank = np.full(n, _NONE)
        filed: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def file(places: np.ndarray) -> None:
            """Ranks the pairs that begin at `places` and files them."""
            pair = after[places] >= 0
            rank[places[~pair]] = _NONE
            places = places[pair]
            rank[places] = found = self.ranks(symbols[places], symbols[after[places]])
            order = np.argsort(found, kind="stable")
            order = order[: np.searchsorted(found[order], _NONE)]
            found, places = found[order], places[order]
            starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]][: len(found)])
            for r, part in zip(found[starts].tolist(), np.split(places, starts[1:]), strict=len(found) > 0):
                if r not in filed:
                    filed[r] = []
                    heapq.heappush(waiting, r)
                filed[r].append(part)

        file(np.arange(n))
        while waiting:
            r = heapq.heappop(waiting)
            at = np.concatenate(filed.pop(r))
            at = np.unique(at[alive[at] & (rank[at] == r)])
            if not len(at):
                continue
            chained = np.r_[False, after[at[:-1]] == at[1:]]
            start = np.flatnonzero(~chained)
            sizes = np.diff(np.r_[start, len(at)])
            at = at[(np.arange(len(at)) - np.repeat(start, sizes)) % 2 == 0]
            right = after[at]
            symbols[at] = self.made[r]
            alive[right] = False
            after[at] = after[right]
            more = after[at] >= 0
            before[after[at][more]] = at[more]
            file(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        return np.bincount(owner[alive], minlength=len(raw))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the words that the cache lacks are merged together."""
        found, totals, new = [], [], {}
        known = self.known
        for text in texts:
            special = 0
            parts = [text]
            if "<|" in text:
                parts = self.special.split(text)
                special = len(parts) - 1
            words: list[str] = []
            for part in parts:
                clean = part if part.isascii() else unicodedata.normalize("NFC", part)
                words += self.words.findall(clean.lower())
            found.append(words)
            totals.append(special)
            new.update(dict.fromkeys(w for w in words if w not in known))
        if new:
            fresh = list(new)
            known.update(zip(fresh, self.merge(fresh).tolist(), strict=True))
        out = [t + sum(map(known.__getitem__, words)) for t, words in zip(totals, found, strict=True)]
        if len(known) > WORD_LIMIT:
            known.clear()
        return out


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """The model of a file, once per process, with the words that it has cached."""
    return WordBpe(path)


def _apart(at: np.ndarray) -> np.ndarray:
    """Of places in a row (i, i + 1, ...), every second from the leftmost: pairs that overlap are merged from the left."""
    if len(at) < 2:
        return at
    start = np.flatnonzero(np.r_[True, np.diff(at) != 1])
    sizes = np.diff(np.r_[start, len(at)])
    return at[(np.arange(len(at)) - np.repeat(start, sizes)) % 2 == 0]


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). No shuffle.

    `vocabulary` is the path of a tokenizers JSON file that every executor can open (an installed package or an
    attached file). Whole texts are counted; a batch is cut to a few MB, so memory is bounded by the longest text.

    Cases: null text = empty text = 0 bytes and 0 tokens; a null id is returned as it is; repeated rows are counted
    each; an empty table gives no rows; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in batches:
            counts = [n for part in portions(batch.column(1), 2_000_000) for n in bpe.count(part)]
            tokens = np.array(counts, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(released(run, lambda: word_bpe(vocabulary).known.clear()), SCHEMA)
