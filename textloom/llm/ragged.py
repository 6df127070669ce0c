"""Arrow helpers for the operators that run numpy on the executors."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORD_LIMIT = 150_000  # words that a worker's cache holds before it starts anew: about 30 MB
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """word -> 64-bit hash, the same on every executor; bounded by trim()."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def trim(self) -> None:
        if len(self) > WORD_LIMIT:
            self.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; good low and high bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def portions(texts: pa.Array, limit: int = 1_000_000, step: int = 64) -> Iterator[list[str | None]]:
    """A column as lists of about `limit` characters each, so that a batch never stands in memory twice."""
    part: list[str | None] = []
    size = 0
    for i in range(0, len(texts), step):
        more = texts.slice(i, step).to_pylist()
        part += more
        size += sum(len(t) for t in more if t)
        if size > limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def release() -> None:
    """Gives what a task has freed back to the system: the worker lives on, idle, beside the JVM's next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim is not None:
        trim(0)


def released(run: Callable, clear: Callable | None = None) -> Callable:
    """`run` of mapInArrow(), after which the worker's caches are cleared and its memory is released, also if the task fails."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if clear is not None:
                clear()
            release()

    return task


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], row: Callable) -> Iterator[tuple[tuple, list]]:
    """Groups a stream that is sorted by `keys`: yields (key, [row(batch columns, i), ...]) and holds one group at a time."""
    key, rows = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        named = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        at = list(zip(*(named[k].to_pylist() for k in keys), strict=True))
        for i, k in enumerate(at):
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(row(named, i))
    if rows:
        yield key, rows
