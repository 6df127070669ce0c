"""Joins, set operations and deduplication of tables, with the order that a shuffled engine needs made explicit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import c, contains_any
from textloom.session import packed

SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Marks a table for broadcast if it has at most `rows` rows; a larger one is left to the shuffle joins."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default=None, out: str | None = None) -> DataFrame:
    """Left look-up of one value with a default; of repeated keys the last by value order is never silently multiplied."""
    one = table.groupBy(key).agg(F.max(value).alias("_value"))
    met = df.join(small(one), key, "left")
    return met.withColumn(out or value, F.coalesce(F.col("_value"), F.lit(default)) if default is not None else F.col("_value")).drop("_value")


def last_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last by `order`; one aggregate, no sort of the group."""
    rest = [x for x in df.columns if x not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def first_by_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Of rows with equal keys (null equals null) the first by `order`; keep-first deduplication."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def dedup_subset(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """Keep-first deduplication on the columns of `subset` that exist, else on all columns."""
    keys = [x for x in subset if x in df.columns] or df.columns
    return first_by_key(df, keys, order)


def union_ragged(*frames: DataFrame) -> DataFrame:
    """Row union by name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_anti")


def merge_layers(*layers: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of aggregates on common keys."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.join(layer, keys, "full_outer")
    return out


def top_k_members(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows whose value is one of the k most frequent (ties by value); the list has k rows, so its join is broadcast."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), column).limit(k)
    return df.join(F.broadcast(top.select(column)), column, "left_semi")


def group_size_at_least(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of groups of at least n rows, by a combined count and a semi-join: a hot group is never sorted in one task."""
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(*keys)
    return df.join(small(large), keys, "left_semi")


def set_difference(a: DataFrame, b: DataFrame, exclude: list[str] | None = None) -> dict[str, DataFrame]:
    """common, only_a and only_b of two one-column tables, without the excluded values."""
    drop = (lambda df: df.where(~F.col(df.columns[0]).isin(exclude))) if exclude else (lambda df: df)
    return {"common": drop(a.intersect(b)), "only_a": drop(a.subtract(b)), "only_b": drop(b.subtract(a))}


def keyword_filter(df: DataFrame, keywords: list[str], text_col: str = "text", case_sensitive: bool = False) -> DataFrame:
    return df.where(contains_any(text_col, keywords, case_sensitive))


def keyword_regex_filter(df: DataFrame, keywords: list[str], text_col: str = "text", most: int = 300) -> DataFrame:
    """Distinct texts of at most `most` characters with a keyword in any case."""
    pattern = "(?iu)" + "|".join(re.escape(k) for k in keywords)
    return df.select(text_col).where(F.col(text_col).rlike(pattern) & (F.char_length(text_col) <= most)).distinct()


def contains_join(docs: DataFrame, vocabulary: DataFrame, text_col: str, term_col: str, rows: int = SMALL_ROWS) -> DataFrame:
    """Every (document, term) with the lower-cased term in the lower-cased text.

    A vocabulary of at most `rows` rows is broadcast. A larger one meets the distinct stretches of each text that are as
    long as one of its terms, by an equi-join. Null texts and terms match nothing.
    """
    if vocabulary.limit(rows + 1).count() <= rows:
        return docs.join(F.broadcast(vocabulary), F.lower(c(text_col)).contains(F.lower(c(term_col))))
    terms = vocabulary.select(packed(vocabulary).alias("_term"), F.lower(c(term_col)).alias("_key"))
    lengths = [r["n"] for r in terms.where("_key is not null").select(F.char_length("_key").alias("n")).distinct().collect()]  # as many as the longest term has characters
    low = F.lower(c(text_col))
    stretches = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - n + 1, F.lit(1))), lambda i: F.substr(low, i, F.lit(n)))
    pieces = docs.where(F.col(text_col).isNotNull()).select(packed(docs).alias("_row"), F.explode(F.array_distinct(F.concat(*[stretches(n) for n in lengths]))).alias("_key"))
    return pieces.join(terms, "_key").select("_row.*", "_term.*")


def oversample(df: DataFrame, positive: Column, times: int = 10, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Positive rows `times` times, others once, in a seeded order given by the column `shuffle`."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(positive, times).otherwise(1))))
    return copies.withColumn("shuffle", F.xxhash64(F.lit(seed), id_col, "copy"))


def flags(df: DataFrame, all_of: list[str] | None = None, any_of: list[str] | None = None) -> DataFrame:
    """Rows whose 0/1 columns are 1: all of the first list, and one of the second."""
    keep = F.lit(True)
    for x in all_of or []:
        keep = keep & F.coalesce(F.col(x) == 1, F.lit(False))
    hit = F.lit(not any_of)
    for x in any_of or []:
        hit = hit | F.coalesce(F.col(x) == 1, F.lit(False))
    return df.where(keep & hit)


def equals_any_case(column: str, *values: str) -> Column:
    return F.coalesce(F.lower(F.trim(column)).isin([v.lower() for v in values]), F.lit(False))


def product_rows(subjects: DataFrame, predicates: DataFrame, subject: str = "subject", predicate: str = "predicate") -> DataFrame:
    """Every subject with every predicate and their sentence: the product is the result, and the smaller side is broadcast if a count allows it."""
    rows = subjects.select(*subjects.columns).crossJoin(small(predicates.where(F.col(predicate).isNotNull()).select(predicate)))
    return rows.withColumn("text", F.concat_ws(" ", subject, predicate))


def translate_names(df: DataFrame, names: str, static: dict[str, str], cache: DataFrame | None = None, translate=None, out: str = "translated") -> DataFrame:
    """A name's translation: the fixed list, then the cache (key, value), then itself if it is ASCII (in title case), then
    the plug-in `translate(DataFrame of distinct key) -> (key, value)`, else itself."""
    fixed = F.create_map(*[F.lit(x) for k, v in static.items() for x in (k.lower(), v)]) if static else F.create_map().cast("map<string,string>")
    rows = df.withColumn("_key", F.lower(F.trim(names)))
    ascii_only = F.col("_key").rlike(r"^[\x00-\x7F]*$")
    known = cache.select(F.lower("key").alias("_key"), F.col("value").alias("_cached")) if cache is not None else None
    if translate is not None:
        todo = rows.where(~ascii_only & fixed[F.col("_key")].isNull()).select(F.col("_key").alias("key")).distinct()
        if known is not None:
            todo = todo.join(known.withColumnRenamed("_key", "key"), "key", "left_anti")
        asked = translate(todo).select(F.lower("key").alias("_key"), F.col("value").alias("_cached"))
        known = asked if known is None else known.unionByName(asked)
    if known is not None:
        rows = rows.join(small(known.groupBy("_key").agg(F.max("_cached").alias("_cached"))), "_key", "left")
    else:
        rows = rows.withColumn("_cached", F.lit(None).cast("string"))
    value = F.coalesce(fixed[F.col("_key")], F.col("_cached"), F.when(ascii_only, F.initcap(F.trim(names))), F.col(names))
    return rows.withColumn(out, value).drop("_key", "_cached")
