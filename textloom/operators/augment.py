"""Text augmentation: seeded punctuation insertion, quality gates for translated texts, and a stop rule for generation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.vectors import cosine
from textloom.operators.similarity import redundancy

MARKS = {"en": ".,!?;:", "zh": "，。！？；：、", "ja": "、。！？・"}  # marks that may be inserted, by language


def insert_punctuation(df: DataFrame, low: float = 0.1, high: float = 0.2, seed: int = 42, least: int = 1, text: str = "text", lang: str = "lang", id_col: str = "doc_id", out: str = "augmented", count: tuple[int, int] | None = None) -> DataFrame:
    """Inserts max(least, int(characters * U(low, high))) marks (or a number from `count`) at random places.

    The draw is seeded by seed and id, so a row's result doesn't depend on partitions or retries. Texts under five
    characters stay as they are when `count` is given.
    """

    @F.pandas_udf("string")
    def insert(texts: pd.Series, langs: pd.Series, ids: pd.Series) -> pd.Series:
        done = []
        for t, code, i in zip(texts, langs, ids, strict=True):
            t = t or ""
            rng = np.random.default_rng(xxhash.xxh3_64_intdigest(f"{seed}:{i}".encode()))
            if not t or (count and len(t) < 5):
                done.append(t)
                continue
            n = int(rng.integers(count[0], count[1] + 1)) if count else max(least, int(len(t) * rng.uniform(low, high)))
            marks = MARKS.get("ja" if code == "jp" else code, MARKS["en"])
            chars = list(t)
            for at in sorted(rng.integers(0, len(t) + 1, n).tolist(), reverse=True):
                chars.insert(at, marks[int(rng.integers(len(marks)))])
            done.append("".join(chars))
        return pd.Series(done)

    return df.withColumn(out, insert(F.col(text), F.col(lang), F.col(id_col).cast("string")))


def back_translate(df: DataFrame, translate: Callable[[DataFrame, str, str], DataFrame], paths: list[list[str]], embed: Callable[[DataFrame, str], DataFrame], threshold: float = 0.8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of each translation path that changed the text and stayed near it: text, group_id, augment_method, similarity.

    `translate(df, column, language)` and `embed(df, column)` (adding `embedding`) are plug-ins; the gate, the unions
    and the deduplication are native.
    """
    own = embed(df, text).withColumnRenamed("embedding", "_own")
    parts = []
    for path in paths:
        moved = own.withColumn("_moved", F.col(text))
        for language in path:
            moved = translate(moved, "_moved", language)
        near = embed(moved, "_moved").withColumn("similarity", cosine("_own", "embedding"))
        parts.append(near.where((F.col("similarity") >= threshold) & (F.trim("_moved") != F.trim(text))).select(F.col(id_col).alias("group_id"), F.col("_moved").alias("text"), F.lit("-".join(path)).alias("augment_method"), F.bround("similarity", 6).alias("similarity")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    best = F.max_by(F.struct("augment_method", "similarity"), F.struct("similarity", "augment_method"))
    return out.groupBy("group_id", "text").agg(best.alias("b")).select("group_id", "text", "b.*")


def merge_augmented(df: DataFrame, augmented: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Original rows (augment_method `original`) and their augmented ones with the labels of the original."""
    labels = df.drop("text")
    rows = augmented.join(labels, augmented["group_id"] == labels[id_col]).drop(id_col)
    return df.withColumn("group_id", F.col(id_col)).withColumn("augment_method", F.lit("original")).drop(id_col).unionByName(rows, allowMissingColumns=True)


def generate_until_redundant(spark, generate: Callable[[int], DataFrame], embed: Callable[[DataFrame, str], DataFrame], most: int, limit: float = 0.3, threshold: float = 0.9, id_col: str = "doc_id") -> tuple[DataFrame | None, list[float]]:
    """Asks for batches until a batch's redundancy against the pool exceeds the limit; the first batch counts 0."""
    pool, shares = None, []
    for k in range(most):
        batch = embed(generate(k), "text")
        share = 0.0 if pool is None else redundancy(batch, pool, id_col, id_col, threshold).first()["share"]
        shares.append(share)
        if share > limit:
            break
        pool = batch if pool is None else pool.unionByName(batch)
    return pool, shares
