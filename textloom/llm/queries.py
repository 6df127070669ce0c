"""The queries op1..op13 with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from textloom.llm import embedding_dedup as vectors
from textloom.llm import exact_dedup as copies
from textloom.llm import license_scan as licenses
from textloom.llm import line_dedup as lines
from textloom.llm import ngram_join as joins
from textloom.llm import phrases as mined
from textloom.llm import secret_scan as secrets
from textloom.llm import source_mix as mixes
from textloom.llm import top_k_search as searches
from textloom.llm.embedding_dedup import embedding_dedup
from textloom.llm.exact_dedup import exact_dedup
from textloom.llm.language_id import language_id
from textloom.llm.license_scan import license_scan
from textloom.llm.line_dedup import page_line_dedup
from textloom.llm.ngram_join import ngram_join
from textloom.llm.phrases import collocations
from textloom.llm.secret_scan import secret_scan
from textloom.llm.sentence_pieces import sentencepiece_encode
from textloom.llm.source_mix import mix_sources
from textloom.llm.token_counts import token_counts
from textloom.llm.top_k_search import exact_top_k
from textloom.llm.whitening import whiten
from textloom.session import spread, table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_encode(spread(table(spark, sf_dir, "documents")), vocabulary("piece_bpe_32k.model"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spread(table(spark, sf_dir, "documents")), wrapped=True)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spread(table(spark, sf_dir, "documents")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_line_dedup(spread(table(spark, sf_dir, "pages")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spread(table(spark, sf_dir, "documents")), vocabulary("word_bpe_49k.json"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spread(table(spark, sf_dir, "documents")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spread(table(spark, sf_dir, "documents")))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spread(table(spark, sf_dir, "embeddings")), "vec_id % 100 = 0")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spread(table(spark, sf_dir, "embeddings")))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spread(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; the others are tested against brute force, a library or held-out accuracy."""
    return {"op2_license_scan": licenses.sql(), "op10_secret_scan": secrets.sql(), "op11_topk_search": searches.SQL, "op13_phrases": mined.SQL, "op4_exact_dedup": copies.SQL, "op5_source_mix": mixes.sql(), "op6_line_dedup": lines.SQL, "op8_ngram_join": joins.SQL, "op9_embedding_dedup": vectors.SQL}
