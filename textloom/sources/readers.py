"""Readers of tables, nested JSON, arrays, pages and sharded corpora."""

from __future__ import annotations

import html as _html
import io
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import c

ENCODINGS = ("utf-8", "gb18030", "iso-8859-1")
BUILT_IN = ("iso-8859-1", "us-ascii", "utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32")  # others need Java's charsets
SEPARATORS = (",", "\t", ";")
DOCUMENTS = "doc_id bigint, text string, lang string, topic int"
# Records of crawlers, whose fetching is not part of the engine. Fixed column names.
CRAWL_SCHEMAS = {
    "board_posts": "title string, floor int, author string, time string, main_content string, lzl_replies string, link string, keyword string",
    "thread_posts": "keyword string, thread_url string, title string, author string, time string, text string, uid string",
    "short_posts": "keyword string, lang string, content string, datetime string, url string, author string, likes string, retweets string, replies string, scrape_time string",
    "crawl_extract": "text string, char_count int",
}


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, sep: str = ",", encoding: str = "utf-8", tolerant: bool = False, strings: bool = False) -> DataFrame:
    """CSV with header, quoted line ends and doubled quotes. `strings` keeps every column text, `tolerant` skips bad lines."""
    if encoding.lower() not in BUILT_IN:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sep).option("encoding", encoding)
    r = r.option("mode", "DROPMALFORMED" if tolerant else "PERMISSIVE")
    if schema:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", not strings).csv(path)


def text_column(df: DataFrame, candidates: tuple[str, ...] = ("text", "content", "main_content", "comment_text", "response")) -> str:
    """The first candidate that exists, else the second column, else the first."""
    return next((x for x in candidates if x in df.columns), df.columns[min(1, len(df.columns) - 1)])


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator that is most frequent in the first line; a comma on ties."""
    line = spark.read.text(path).first()
    return max(SEPARATORS, key=lambda s: (line[0].count(s), -SEPARATORS.index(s))) if line else ","


def read_sniffed(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """Tries encodings and separators in turn; the first table of two columns whose header has no replacement sign is taken."""
    for encoding in encodings:
        for sep in separators:
            df = read_csv(spark, path, sep=sep, encoding=encoding, tolerant=True, strings=True)
            bad = any("�" in x for x in df.columns) or (df.columns and not df.where(F.concat_ws("", *[F.col(f"`{x}`") for x in df.columns]).contains("�")).isEmpty())
            if len(df.columns) >= 2 and not bad:
                return df
    return read_csv(spark, path, tolerant=True, strings=True)


def read_posts(spark: SparkSession, path: str, source: str, sep: str | None = None) -> DataFrame:
    """(post_id, text, source) of the first two columns of a tolerant CSV; rows without text go."""
    df = read_csv(spark, path, sep=sep or sniff_separator(spark, path), tolerant=True, strings=True)
    return df.select(F.col(f"`{df.columns[0]}`").alias("post_id"), F.col(f"`{df.columns[1]}`").alias("text"), F.lit(source).alias("source")).where("trim(text) <> ''")


def read_annotated_posts(spark: SparkSession, path: str, target: str) -> DataFrame:
    """(post_id, text) of a JSON object {id: {post_tokens, annotators: [{target: [...]}]}} where an annotator names the target."""
    from textloom.sources.lexicons import whole_text

    shape = "map<string,struct<post_tokens:array<string>,annotators:array<struct<target:array<string>>>>>"
    rows = whole_text(spark, path).select(F.explode(F.from_json("content", shape)).alias("post_id", "p"))
    hit = F.exists("p.annotators", lambda a: F.array_contains(a["target"], target))
    return rows.where(F.coalesce(hit, F.lit(False))).select("post_id", F.array_join("p.post_tokens", " ").alias("text"))


def read_parallel_suite(spark: SparkSession, path: str, langs: tuple[str, ...] = ("en", "zh", "ja")) -> DataFrame:
    """(category, group_id, lang, text) of a JSON object {category: [{lang: text}]}; groups are numbered by place."""
    from textloom.sources.lexicons import whole_text

    rows = whole_text(spark, path).select(F.explode(F.from_json("content", "map<string,array<map<string,string>>>")).alias("category", "items"))
    rows = rows.select("category", F.posexplode("items").alias("at", "item")).select(F.concat_ws("-", "category", F.col("at").cast("string")).alias("group_id"), "category", F.explode("item").alias("lang", "text"))
    return rows.where(F.col("lang").isin(*langs) & (F.trim("text") != "")).select("category", "group_id", "lang", "text")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(name, row, vector) of .npy and .npz files, read through Spark, decoded on the executors."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                found = np.load(io.BytesIO(content), allow_pickle=False)
                named = dict(found.items()) if hasattr(found, "files") else {os.path.basename(file).removesuffix(".npy"): found}
                for name, value in named.items():
                    m = np.atleast_2d(np.asarray(value, dtype=np.float64))
                    for start in range(0, len(m), 2048):
                        part = m[start : start + 2048]
                        yield pd.DataFrame({"name": name, "row": range(start, start + len(part)), "vector": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, "name string, row long, vector array<double>")


def load_config(path: str, overrides: dict | None = None, defaults: dict | None = None) -> dict:
    """Configuration: command line over file over defaults. Reads YAML where the library is there, else `key: value` lines with two-space nesting."""
    data: dict = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml

            data = yaml.safe_load(text) or {}
        except ModuleNotFoundError:
            data = _plain_yaml(text)
    return _merge(_merge(defaults or {}, data), overrides or {})


def _merge(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v if v is not None else out.get(k)
    return out


def _plain_yaml(text: str) -> dict:
    out: dict = {}
    stack: list[tuple[int, dict]] = [(-1, out)]
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#") or ":" not in bare:
            continue
        depth = len(bare) - len(bare.lstrip())
        key, _, value = bare.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            stack[-1][1][key.strip()] = _scalar(value.strip())
        else:
            stack[-1][1][key.strip()] = child = {}
            stack.append((depth, child))
    return out


def _scalar(v: str):
    if v.startswith("[") and v.endswith("]"):
        return [_scalar(x.strip()) for x in v[1:-1].split(",") if x.strip()]
    if v.lower() in ("true", "false", "null", "~"):
        return {"true": True, "false": False}.get(v.lower())
    for kind in (int, float):
        try:
            return kind(v)
        except ValueError:
            continue
    return v.strip("\"'")


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of some paths that exists, in any store that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            return p
    return None


def read_glob(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """CSV files of a pattern with the column `file`."""
    return read_csv(spark, pattern, schema).withColumn("file", F.input_file_name())


def filtered_corpus(df: DataFrame, keywords: list[str], most: int = 250, least: int = 1, cap: int | None = None, text: str = "text", case_sensitive: bool = True) -> DataFrame:
    """Texts of a length with a keyword, with char_count; `cap` stops the scan early."""
    from textloom.functions.text import contains_any

    out = df.where(F.char_length(text).between(least, most) & contains_any(text, keywords, case_sensitive)).select(F.col(text).alias("text"), F.char_length(text).alias("char_count"))
    return out.limit(cap) if cap else out


def quota_per_shard(df: DataFrame, shards: int, quota: int, id_col: str = "doc_id") -> DataFrame:
    """Up to `quota` rows of each shard (hash of the id), chosen by the hash; Spark keeps `quota` per task before the shuffle."""
    rows = df.withColumn("shard", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(1), id_col), id_col))
    return rows.withColumn("_p", place).where(F.col("_p") <= quota).drop("_p")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzipped or not; malformed lines go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_registry(spark: SparkSession, registry: list[dict], limit: int | None = None) -> DataFrame:
    """(dataset, lang, content) of several datasets {name, path, format, column, lang}, at most `limit` rows per language."""
    out = None
    for entry in registry:
        df = spark.read.format(entry.get("format", "parquet")).load(entry["path"])
        part = df.select(F.lit(entry["name"]).alias("dataset"), F.lit(entry["lang"]).alias("lang"), F.col(entry["column"]).cast("string").alias("content"))
        out = part if out is None else out.unionByName(part)
    if limit is None or out is None:
        return out
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("dataset", "content"), "dataset", "content"))
    return out.withColumn("_p", place).where(F.col("_p") <= limit).drop("_p")


HIDDEN = r"(?is)<(?:script|style)\b[^>]*(?:>|\z).*?(?:</(?:script|style)\s*>|\z)|<!--.*?(?:-->|\z)"
TAG = r"<[A-Za-z!/?][^>]*(?:>|\z)"
LINK = r"""(?i)<a\b[^<>]*?\bhref=["']?([^"'\s<>]+)"""
TITLE = r"(?is)<title[^>]*(?:>|\z)(.*?)(?:</title>|\z)"


def page_text(html) -> Column:
    """Visible text of a page: tags, scripts and styles go, common entities are decoded, blanks collapse.

    A script, style, comment or tag that is never closed ends with the page, so that no start is scanned twice.
    """
    t = F.regexp_replace(F.coalesce(c(html), F.lit("")), HIDDEN, " ")
    t = F.regexp_replace(t, TAG, " ")
    for name in ("nbsp", "lt", "gt", "quot", "amp"):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(_html.unescape(f"&{name};").replace("\xa0", " ")))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def page_links(html) -> Column:
    return F.regexp_extract_all(F.coalesce(c(html), F.lit("")), F.lit(LINK), F.lit(1))


def page_title(html) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(c(html), F.lit("")), TITLE, 1), r"\s+", " "))
