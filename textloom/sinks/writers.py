"""Writers: tables, JSON lines, caches and Markdown. Single-file forms are for small results and are made on the driver."""

from __future__ import annotations

import csv
import datetime
import io
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"
SMALL_ROWS = 100_000


def run_id(now: datetime.datetime | None = None) -> str:
    return (now or datetime.datetime.now()).strftime("%Y%m%d_%H%M%S")


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for formats without them."""
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A folder of CSV files with headers, one per task."""
    flat(df).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def put_file(path: str, text: str, encoding: str = "utf-8") -> str:
    """One file in the file system that the path or the session names; on a cluster that isn't the driver's disk."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.getScheme() != "file":
            out = fs.create(target, True)
            out.write(bytearray(text.encode(encoding)))
            out.close()
            return path
    path = path.removeprefix("file://")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def write_csv_file(df: DataFrame, path: str, bom: bool = True, order: list | None = None) -> str:
    """One CSV file, with a byte order mark for spreadsheet programs; refuses tables over SMALL_ROWS rows."""
    rows = flat(df.orderBy(*order) if order else df)
    found = rows.limit(SMALL_ROWS + 1).collect()
    if len(found) > SMALL_ROWS:
        raise ValueError(f"over {SMALL_ROWS} rows: use write_csv()")
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(rows.columns)
    w.writerows([["" if v is None else v for v in r] for r in found])
    return put_file(path, out.getvalue(), "utf-8-sig" if bom else "utf-8")


def append(df: DataFrame, path: str) -> str:
    """Appends to a Parquet table: schema and header live in the files, so the first write is like any other."""
    df.write.mode("append").parquet(path)
    return path


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key the table lacks; returns how many."""
    spark = df.sparkSession
    from textloom.sources.readers import first_existing

    fresh = df.dropDuplicates([key])
    if first_existing(spark, [path]):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh = fresh.persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").parquet(path)
        return n
    finally:
        fresh.unpersist()


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines with nulls kept as nulls, one file per task."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)
    return path


def write_table(df: DataFrame, path: str, kind: str = "csv") -> str:
    """An annotation set as CSV or JSON lines."""
    return write_csv(df, path) if kind == "csv" else write_jsonl(df, path)


def write_json(data: dict, path: str) -> str:
    return put_file(path, json.dumps(data, ensure_ascii=False, indent=2, default=str))


class KeyedCache:
    """A table of (key, value): left join to read; writes replace the table by renaming a finished folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "key string, value string"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        hp = self.spark._jvm.org.apache.hadoop.fs.Path
        return hp, hp(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def load(self) -> DataFrame:
        hp, fs = self._fs()
        return self.spark.read.schema(self.schema).parquet(self.path) if fs.exists(hp(self.path)) else self.spark.createDataFrame([], self.schema)

    def put(self, new: DataFrame) -> None:
        """Adds rows; a key that was known takes its new value."""
        hp, fs = self._fs()
        one = new.groupBy("key").agg(F.max("value").alias("value"))
        old = self.load().join(one, "key", "left_anti")
        fresh, gone = f"{self.path}.new", f"{self.path}.old"
        old.unionByName(one).write.mode("overwrite").parquet(fresh)
        fs.delete(hp(gone), True)
        if fs.exists(hp(self.path)):
            fs.rename(hp(self.path), hp(gone))
        fs.rename(hp(fresh), hp(self.path))
        fs.delete(hp(gone), True)


def markdown_table(rows: list[dict], columns: list[str] | None = None, limit: int = 20) -> str:
    """A Markdown table of dictionaries; cells lose line ends and bars, longer tables end with a remark."""
    if not rows:
        return "_no rows_\n"
    columns = columns or list(rows[0])
    cell = lambda v: ("" if v is None else f"{v:.4f}" if isinstance(v, float) else ", ".join(map(str, v)) if isinstance(v, list) else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]
    lines += [f"| {' | '.join(cell(r.get(x)) for x in columns)} |" for r in rows[:limit]]
    return "\n".join(lines) + "\n" + (f"\n_{len(rows) - limit} more rows_\n" if len(rows) > limit else "")
