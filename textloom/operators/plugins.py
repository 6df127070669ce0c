"""Seams for models that are not part of the engine, with deterministic offline defaults, and the helpers of remote calls."""

from __future__ import annotations

import importlib
import pkgutil
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class BatchModel(Protocol):
    """Called with a list of texts on the executors, once per Arrow batch; returns a value for each."""

    def __call__(self, texts: list[str]) -> list: ...


FACTORIES: dict[str, Callable[..., Callable[[], BatchModel]]] = {}


def factory(name: str):
    """Registers a function that makes a model's factory, under a name that configurations can use."""

    def register(f):
        FACTORIES[name.lower()] = f
        return f

    return register


def make(name: str, **options) -> Callable[[], BatchModel]:
    """The factory of a registered model."""
    if name.lower() not in FACTORIES:
        raise KeyError(f"no model {name!r}; known: {', '.join(sorted(FACTORIES)) or 'none'}")
    return FACTORIES[name.lower()](**options)


def discover(package: str) -> list[str]:
    """Imports all modules of a package, whose registrations run; returns the names that are known then."""
    root = importlib.import_module(package)
    for module in pkgutil.walk_packages(getattr(root, "__path__", []), f"{package}."):
        importlib.import_module(module.name)
    return sorted(FACTORIES)


def apply_model(df: DataFrame, model: Callable[[], BatchModel], text_col: str, out_col: str, out_type: str, default=None, failed_col: str | None = None) -> DataFrame:
    """Adds a column made by a model. `model` is a factory that is called once per task; a batch that fails gives defaults,
    and is marked in `failed_col` if that is named."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out_col}` {out_type}" + (f", `{failed_col}` boolean" if failed_col else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model()
        for batch in batches:
            failed = False
            try:
                values = own(batch[text_col].fillna("").tolist())
            except Exception:  # noqa: BLE001  a model's failure must not lose rows
                values, failed = [default] * len(batch), True
            yield batch.assign(**{out_col: pd.Series(values, index=batch.index, dtype=object)} | ({failed_col: failed} if failed_col else {}))

    return df.mapInPandas(run, schema)


def classify(df: DataFrame, model: Callable[[], BatchModel], name: str, text_col: str = "text") -> DataFrame:
    """Appends struct(model, label, prob) to the array column `votes`; a failing batch votes 0 with probability 0."""
    scored = apply_model(df, model, text_col, "_vote", "struct<label:int,prob:double>", {"label": 0, "prob": 0.0})
    vote = F.array(F.struct(F.lit(name).alias("model"), F.col("_vote.label").alias("label"), F.col("_vote.prob").alias("prob")))
    before = F.col("votes") if "votes" in df.columns else F.array().cast("array<struct<model:string,label:int,prob:double>>")
    return scored.withColumn("votes", F.concat(before, vote)).drop("_vote")


class KeywordClassifier:
    """Offline default of classify(): 1 with the share of keywords that occur, at least a half, if any does."""

    def __init__(self, keywords: list[str]):
        self.keywords = [k.lower() for k in keywords]

    def __call__(self, texts: list[str]) -> list[dict]:
        out = []
        for t in texts:
            hits = sum(k in t.lower() for k in self.keywords)
            out.append({"label": int(hits > 0), "prob": 0.5 + 0.5 * hits / len(self.keywords) if hits else 0.0})
        return out


@factory("keywords")
def keyword_classifier(keywords: list[str]) -> Callable[[], BatchModel]:
    return lambda: KeywordClassifier(keywords)


def hashed_embedding(text_col: str, dim: int = 64):
    """Offline default embedding: signed feature hashing of words, natively."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dim)).alias("i"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v")))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(slots, lambda s: s["i"] == i), F.lit(0.0), lambda a, s: a + s["v"]))


def rate_of_a_task(df: DataFrame, rate: float) -> float:
    """The part of a cluster's rate of calls that each task of a stage over `df` may use, so that all together keep to it."""
    together = min(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
    return rate / max(together, 1)


class Governor:
    """Token bucket with adaptive concurrency for remote models: `rate` calls a second, halved on a limit, raised after successes.

    One object may be shared by the threads of a process; tasks of a cluster share a rate by rate_of_a_task().
    """

    def __init__(self, rate: float, concurrency: int, least: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.concurrency, self.least, self.most = rate, concurrency, least, concurrency
        self.clock, self.sleep, self.tokens, self.at, self.good = clock, sleep, max(rate, 1.0), clock(), 0
        self.lock = threading.Lock()

    def acquire(self) -> None:
        while True:
            with self.lock:
                now = self.clock()
                self.tokens = min(max(self.rate, 1.0), self.tokens + (now - self.at) * self.rate)
                self.at = now
                if self.tokens >= 1 - 1e-9:  # what is missing may be less than a clock can tell
                    self.tokens -= 1
                    return
                wait = (1 - self.tokens) / self.rate
            self.sleep(wait)

    def map(self, requests: Iterable[Callable[[], object]], **options) -> list:
        """Runs requests in threads, as many at a time as the limits of the time allow; results in order."""
        waiting, out = list(requests), []
        while waiting:
            now, waiting = waiting[: self.concurrency], waiting[self.concurrency :]
            with ThreadPoolExecutor(len(now)) as pool:
                out += pool.map(lambda r: self.call(r, **options), now)
        return out

    def report(self, limited: bool) -> None:
        with self.lock:
            self.good = 0 if limited else self.good + 1
            if limited:
                self.concurrency = max(self.least, self.concurrency // 2)
            elif self.good % 10 == 0:
                self.concurrency = min(self.most, self.concurrency + 1)

    def call(self, request: Callable[[], object], is_limit: Callable[[Exception], bool] = lambda e: "429" in str(e), attempts: int = 3) -> object:
        """Runs a request with backoff 2^attempt seconds, five times that on a limit; the last error is raised."""
        for attempt in range(attempts):
            self.acquire()
            try:
                out = request()
                self.report(False)
                return out
            except Exception as error:  # noqa: BLE001
                limited = is_limit(error)
                self.report(limited)
                if attempt == attempts - 1:
                    raise
                self.sleep(2**attempt * (5 if limited else 1))
        return None
