"""From raw documents to token ids: language filter, exact and near deduplication, source mixing, SentencePiece encoding."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.exact_dedup import drop_copies
from textloom.llm.language_id import language_filter
from textloom.llm.ngram_join import drop_near_copies
from textloom.llm.sentence_pieces import sentencepiece_encode
from textloom.llm.source_mix import Mix, mix_rows
from textloom.session import checkpoint_dir, remove, table

#: Each document at most once, and four fifths of the tokens, so that large sources give way to small ones.
MIX = Mix(entropy=0.5, repetition=1.0, budget=0.8)
PIECES = "piece_bpe_32k.model"
#: Words that an encoding worker keeps: the JVM beside it still holds what the four stages before have taken.
WORDS = 150_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that no language model accepts.

    Cases, of this and the next three stages: see language_filter(), drop_copies(), drop_near_copies() and
    mix_sources() on nulls, empty and long texts, ties, repeated rows and empty tables; all columns come back, whatever
    their names.
    """
    return language_filter(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the longest form of each text, of equally long ones that with the smallest id."""
    return drop_copies(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: that with the smallest id."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the mix takes; nothing is repeated, so only first epochs count."""
    return mix_rows(docs, MIX).where("epoch = 0").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: the columns and cases of sentencepiece_encode()."""
    import public_tokenizers

    return sentencepiece_encode(docs, str(public_tokenizers.path(PIECES)), words=WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", join_near_copies),
    ("source_mix", mix),
    ("sentencepiece", encode),
]

#: Character models and token ids are beyond SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet in the shared folder and read again.

    A stage's folder is removed when the next one has been written; the last one is the result's and stays.
    """
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
