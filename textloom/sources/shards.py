"""JSON lines in remote shards as a stream that resumes where it stopped: byte ranges over HTTP, or of files."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from textloom.sources.arrays import opened

PART_BYTES = 16 << 20  # of a shard that one task reads; a compressed shard is one task's
BLOCK = 1 << 18
RETRIES = 6  # of a request without a byte in between
SCHEMA = "shard string, at long, line string"


def is_remote(url: str) -> bool:
    return url.startswith(("http://", "https://"))


def size_of(url: str) -> int:
    """The bytes of a shard; 0 if it isn't there yet."""
    if not is_remote(url):
        files, path = opened(url)
        return files.get_file_info(path).size or 0
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=60) as reply:
            return int(reply.headers["Content-Length"])
    except urllib.error.HTTPError as error:
        if error.code in (404, 410):
            return 0
        raise


def blocks(url: str, start: int, stop: int, pause: float = 0.2) -> Iterator[bytes]:
    """Bytes [start, stop) of a shard. A request that breaks off is sent again for what is missing; after RETRIES requests
    in a row without a byte the error goes on, and with it the task, which Spark runs again."""
    if not is_remote(url):
        files, path = opened(url)
        with files.open_input_file(path) as f:
            while start < stop and (part := f.read_at(min(BLOCK, stop - start), start)):
                start += len(part)
                yield part
        return
    failed = 0
    while start < stop:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"Range": f"bytes={start}-{stop - 1}"}), timeout=60) as reply:
                # a server without ranges sends all from the first byte
                skip = start if reply.status == 200 else 0
                while skip and (part := reply.read(min(BLOCK, skip))):
                    skip -= len(part)
                while start < stop and (part := reply.read(min(BLOCK, stop - start))):
                    start, failed = start + len(part), 0
                    yield part
            if start < stop:
                raise ConnectionError(f"{url} ended at byte {start} of {stop}")
        except (OSError, urllib.error.URLError) as error:
            if isinstance(error, urllib.error.HTTPError) and error.code < 500:
                raise
            failed += 1
            if failed > RETRIES:
                raise
            time.sleep(pause * failed)


def lines(url: str, start: int, stop: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in bytes [start, stop) of a shard of which `size` bytes may be read.

    A range reads on to the end of its last line and leaves out the line that began before it, so that every line is in
    one range. Places are bytes; in a compressed shard (.gz), those of its text.
    """
    packed = url.endswith(".gz")
    at, rest = (0, b"") if packed or not start else (start - 1, b"")
    skipping = at != start
    unpack = zlib.decompressobj(31) if packed else None
    for block in blocks(url, at, size):
        if unpack is not None:
            plain = b""
            while block:  # members may follow one another
                plain += unpack.decompress(block)
                block = unpack.unused_data if unpack.eof else b""
                if unpack.eof:
                    unpack = zlib.decompressobj(31)
            block = plain
        rest += block
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if not skipping:
                if not packed and at >= stop:
                    return
                yield at, line
            skipping = False
            at += len(line) + 1
        if not packed and at >= stop and not skipping:
            return
    if rest and not skipping and (packed or at < stop):
        yield at, rest


class Range(InputPartition):
    def __init__(self, url: str, start: int, stop: int, size: int):
        super().__init__((url, start, stop, size))
        self.url, self.start, self.stop, self.size = url, start, stop, size


class ShardReader(DataSourceStreamReader):
    """Offsets are the bytes of each shard that have been planned. They stand in the stream's own log, so that a restart
    plans a batch that wasn't finished with the same ranges, and goes on behind one that was.

    A shard may grow by whole lines or come later; a compressed one is read once it is there, and must be whole then.
    """

    def __init__(self, urls: list[str], part_bytes: int):
        self.urls, self.part_bytes = urls, part_bytes

    def initialOffset(self) -> dict:  # noqa: N802
        return {url: 0 for url in self.urls}

    def latestOffset(self) -> dict:  # noqa: N802
        return {url: size_of(url) for url in self.urls}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for url in self.urls:
            a, b = start.get(url, 0), end.get(url, 0)
            step = max(1, b - a) if url.endswith(".gz") else self.part_bytes
            if url.endswith(".gz") and a:
                continue
            out += [Range(url, i, min(b, i + step), b) for i in range(a, b, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str]] = []
        size = 0
        for at, line in lines(partition.url, partition.start, partition.stop, partition.size):
            if line.strip():
                rows.append((at, line.decode("utf-8", "replace")))
                size += len(line)
            if size > 4 << 20:
                yield self._batch(partition.url, rows)
                rows, size = [], 0
        yield self._batch(partition.url, rows)

    @staticmethod
    def _batch(url: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([url] * len(rows), pa.string()), pa.array([a for a, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.string())], ["shard", "at", "line"])


class ShardSource(DataSource):
    """Format `shards`: option urls (a JSON list), partBytes."""

    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ShardReader:  # noqa: N802
        return ShardReader(json.loads(self.options["urls"]), int(self.options.get("partbytes", PART_BYTES)))


def stream_shards(spark: SparkSession, urls: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """(shard, at, line): a stream of the lines of shards at HTTP or file URLs, plain or gzipped; blank lines go.

    Use from_json() on `line`. Every shard is dealt over tasks by ranges of bytes, and a connection that breaks is taken
    up again at the byte it has reached.
    """
    spark.dataSource.register(ShardSource)
    return spark.readStream.format("shards").option("urls", json.dumps(urls)).option("partBytes", part_bytes).load()
