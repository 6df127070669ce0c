import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from textloom.sources import shards
from textloom.streaming import incremental


class Breaking(BaseHTTPRequestHandler):
    """Serves byte ranges and breaks off after at most `most` bytes of each request; the first requests fail altogether."""

    files: dict = {}
    most = 3000
    failing = 2
    asked: list = []

    def log_message(self, *args):
        pass

    def do_HEAD(self):
        body = self.files.get(self.path)
        self.send_response(404 if body is None else 200)
        self.send_header("Content-Length", str(len(body or b"")))
        self.end_headers()

    def do_GET(self):
        body = self.files[self.path]
        a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
        type(self).asked.append((self.path, a))
        if len(self.asked) <= self.failing:
            self.send_error(503)
            return
        self.send_response(206)
        self.send_header("Content-Length", str(b + 1 - a))
        self.end_headers()
        self.wfile.write(body[a : min(b + 1, a + self.most)])
        self.close_connection = True


@pytest.fixture
def server():
    Breaking.files, Breaking.asked = {}, []
    found = ThreadingHTTPServer(("127.0.0.1", 0), Breaking)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}"
    found.shutdown()


def text(name, ids):
    return "".join(json.dumps({"id": f"{name}{i}", "text": "wörter " * (i % 40)}) + "\n" + "\n" * (i % 3 == 0) for i in ids).encode()


def test_every_line_is_in_one_range(tmp_path):
    body = text("a", range(50)) + b"no end of line"
    path = tmp_path / "a.jsonl"
    path.write_bytes(body)
    want = [(at, line) for at, line in shards.lines(str(path), 0, len(body), len(body))]
    assert b"\n".join(line for _, line in want) == body and all(body[at : at + len(line)] == line for at, line in want)
    for step in (1, 7, 64, 1000, 10**6):
        assert [x for i in range(0, len(body), step) for x in shards.lines(str(path), i, min(len(body), i + step), len(body))] == want


def test_a_stream_of_breaking_connections(spark, server, tmp_path):
    Breaking.files = {"/a.jsonl": text("a", range(200)), "/b.jsonl.gz": gzip.compress(text("b", range(100))) + gzip.compress(text("b", range(100, 130)))}
    urls = [f"{server}/{x}" for x in ("a.jsonl", "b.jsonl.gz", "later.jsonl")]

    def run():
        rows = shards.stream_shards(spark, urls, 5000).selectExpr("get_json_object(line, '$.id') AS id")
        incremental.append_to(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    want = [f"a{i}" for i in range(200)] + [f"b{i}" for i in range(130)]
    assert run() == sorted(want)
    assert len(Breaking.asked) > 8
    Breaking.files["/a.jsonl"] += text("a", range(200, 230))
    Breaking.files["/later.jsonl"] = text("c", range(5))
    before = len(Breaking.asked)
    want += [f"a{i}" for i in range(200, 230)] + [f"c{i}" for i in range(5)]
    assert run() == sorted(want)
    assert min(a for path, a in Breaking.asked[before:] if path == "/a.jsonl") >= len(text("a", range(200))) - 1
    assert not any(path == "/b.jsonl.gz" for path, _ in Breaking.asked[before:])


def test_a_shard_that_never_answers_is_an_error(server):
    Breaking.files = {"/a.jsonl": b"x\n"}
    Breaking.failing, kept = 10**6, Breaking.failing
    try:
        with pytest.raises(OSError):
            list(shards.blocks(f"{server}/a.jsonl", 0, 2, pause=0.01))
    finally:
        Breaking.failing = kept
