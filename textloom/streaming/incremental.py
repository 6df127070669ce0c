"""Incremental corpora: filtered appends with checkpoints, deduplication across restarts, quotas, and completed keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from textloom.functions.text import contains_any


def stream_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files of a folder, old and new."""
    r = spark.readStream.format(fmt).schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).load(path)


def filtered(stream: DataFrame, keywords: list[str], most: int = 250, least: int = 1, text: str = "text") -> DataFrame:
    return stream.where(F.char_length(text).between(least, most) & contains_any(text, keywords, True)).withColumn("char_count", F.char_length(text))


def first_seen(stream: DataFrame, keys: list[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """Rows whose key was not seen before, also across restarts. With a time column and delay, the state is bounded."""
    if time and delay:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def append_to(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = True) -> StreamingQuery:
    """Exactly-once append to a folder; `once` processes what is there and stops. Restarting goes on where it stopped."""
    w = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


class Quota(StatefulProcessor):
    """Lets rows of a key pass until `quota` have; how many did is state, kept for `keep` ms without rows (None: for good).

    Of the rows that come together, those first by `order` pass, so that a batch's arrival order is of no account.
    """

    def __init__(self, quota: int, order: str | None, keep: int | None):
        self.quota, self.order, self.keep = quota, order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.passed = handle.getValueState("passed", "n long", self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        done = self.passed.get()[0] if self.passed.exists() else 0
        left = self.quota - done
        best: pd.DataFrame | None = None
        for part in rows:
            if left <= 0:
                continue
            best = part if best is None else pd.concat([best, part])
            best = (best.sort_values(self.order, kind="stable") if self.order else best).head(left)
        if best is not None and len(best):
            self.passed.update((done + len(best),))
            yield best

    def close(self) -> None:
        pass


def under_quota(stream: DataFrame, by: str | None, quota: int, order: str | None = None, keep: int | None = None) -> DataFrame:
    """The rows of a stream until each value of `by` has had `quota`, also across restarts.

    Counts live in the state store under the stream's checkpoint, and the sink is never read: a restart goes on with the
    counts of the last batch that was finished, so rows are neither lost nor let through twice. Null is a value of `by`;
    without `by` all rows share one quota.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    key = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")) if by else F.lit("")
    keyed = stream.withColumn("_key", key)
    return keyed.groupBy("_key").transformWithStateInPandas(Quota(quota, order, keep), stream.schema, "Append", "ProcessingTime" if keep else "None")


def append_until(stream: DataFrame, path: str, checkpoint: str, quota: int, by: str | None = None, order: str | None = None) -> StreamingQuery:
    """Appends until the sink has `quota` rows (per value of `by`); see under_quota()."""
    return append_to(under_quota(stream, by, quota, order), path, checkpoint)


def append_labels(stream: DataFrame, label: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Labels only rows whose key the sink lacks and appends them; a batch that is run again adds nothing."""
    from textloom.sinks.writers import append_new

    def write(batch: DataFrame, number: int) -> None:
        from textloom.sources.readers import first_existing

        spark = batch.sparkSession
        todo = batch.dropDuplicates([key])
        if first_existing(spark, [path]):
            todo = todo.join(spark.read.parquet(path).select(key), key, "left_anti")
        append_new(label(todo), path, key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unfinished(rows: DataFrame, progress: DataFrame, key: str, paths: int) -> DataFrame:
    """Rows whose key has not finished all of its paths yet."""
    done = progress.groupBy(key).agg(F.count_distinct("path").alias("_n")).where(F.col("_n") >= paths)
    return rows.join(done.select(key), key, "left_anti")
