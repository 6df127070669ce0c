"""The three layers: who is named, how, and on which axis. Each is a function of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import classification_key, language_code, named_count, preview
from textloom.operators.aggregates import exploded_counts, ranked_map, topic_summary
from textloom.operators.match import OTHER, Rules, capitalised_entities, entity_row, expressions, frame_of, gazetteer_entities, merge_entities
from textloom.operators.similarity import project

NOISE_TOPIC = -1


def prepare(docs: DataFrame, lang: str | None = None, most: int | None = None) -> DataFrame:
    """Canonical language codes, one filter for all layers, and an optional cap in document order."""
    rows = docs.withColumn("lang", language_code("lang"))
    rows = rows.where(F.col("lang") == language_code(F.lit(lang))) if lang and lang != "auto" else rows
    return rows.orderBy("doc_id").limit(most) if most else rows


def document_stats(docs: DataFrame) -> dict:
    row = docs.agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("topic") != NOISE_TOPIC, F.col("topic"))).alias("topics")).first()
    langs = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    return {"total_documents": row["n"], "topic_count": row["topics"], "language_counts": langs}


def who_entities(docs: DataFrame, gazetteer: list[tuple[str, str]], aliases: dict[str, str] | None = None, pronouns: list[str] | None = None, noise: list[str] | None = None, enrich: Callable[[DataFrame], DataFrame] | None = None, least: int = 2) -> DataFrame:
    """Adds details (array of text, label, source), targets and llm_enriched.

    `enrich` (a plug-in that adds the column `more`) is asked only for rows with fewer than `least` entities.
    """
    raw = F.concat(capitalised_entities("text", "lang"), gazetteer_entities(gazetteer, "text", "lang")) if gazetteer else capitalised_entities("text", "lang")
    found = docs.withColumn("_raw", raw).withColumn("details", entity_row("_raw", "lang", aliases, pronouns, noise)).drop("_raw")
    if enrich is None:
        out = found.withColumn("llm_enriched", F.lit(False))
    else:
        few = enrich(found.where(F.size("details") < least))
        added = few.withColumn("_all", merge_entities("details", F.coalesce("more", F.array().cast("array<struct<text:string,label:string,source:string>>"))))
        few = added.withColumn("llm_enriched", F.size("_all") > F.size("details")).withColumn("details", F.col("_all")).select(*found.columns, "llm_enriched")
        out = found.where(F.size("details") >= least).withColumn("llm_enriched", F.lit(False)).unionByName(few)
    return out.withColumn("targets", F.transform("details", lambda d: d["text"]))


def who_summary(entities: DataFrame, top: int = 10) -> DataFrame:
    return topic_summary(entities, top=top)


def who_targets(entities: DataFrame, top: int = 20) -> DataFrame:
    """(topic, lang, targets, target_counts): the most frequent targets, first seen first on ties; noise left out."""
    rows = entities.where(F.col("topic") != NOISE_TOPIC)
    ranked = ranked_map(exploded_counts(rows, ["topic", "lang"], "targets", "doc_id", top), ["topic", "lang"])
    keys = rows.select("topic", "lang").distinct()
    return keys.join(ranked, ["topic", "lang"], "left").select("topic", "lang", F.coalesce("items", F.array().cast("array<string>")).alias("targets"), F.coalesce("item_counts", F.create_map().cast("map<string,bigint>")).alias("target_counts"))


def topic_vocabulary(summary: DataFrame, top: int = 5, least: int = 2) -> DataFrame:
    """(topic, terms): the first `top` targets of each topic, lower-cased, of at least `least` characters."""
    names = F.transform(F.slice("top_targets", 1, top), lambda x: F.lower(named_count(x)["name"]))
    return summary.select("topic", F.array_distinct(F.filter(names, lambda n: F.char_length(n) >= least)).alias("terms"))


def how_labels(docs: DataFrame, vocabulary: DataFrame, rules: Rules, classify: Callable[[DataFrame], DataFrame] | None = None, cache: DataFrame | None = None) -> DataFrame:
    """Expressions with classification_key and frame_type.

    Labels come from the cache (key, value) where it has the key, else from `classify` (a plug-in from distinct keys to
    (classification_key, frame_type)), else from the rules.
    """
    raw = expressions(docs, vocabulary, rules)
    keyed = raw.withColumn("classification_key", classification_key("predicate", "context", "lang", "target"))
    keyed = keyed.withColumn("_rule", frame_of("predicate", "context", "target", "lang", rules))
    known = None
    if cache is not None:
        known = cache.select(F.col("key").alias("classification_key"), F.col("value").alias("_known"))
    if classify is not None:
        todo = keyed.where(F.col("_rule") != "noise").dropDuplicates(["classification_key"]).select("classification_key", "predicate", "context", "lang", "target")
        if known is not None:
            todo = todo.join(known, "classification_key", "left_anti")
        asked = classify(todo).select("classification_key", F.col("frame_type").alias("_known"))
        known = asked if known is None else known.unionByName(asked)
    if known is not None:
        keyed = keyed.join(known.groupBy("classification_key").agg(F.max("_known").alias("_known")), "classification_key", "left")
    label = F.coalesce("_known", "_rule", F.lit(OTHER)) if known is not None else F.col("_rule")
    return keyed.withColumn("frame_type", label).drop("_rule", "_known")


def instances(labelled: DataFrame) -> DataFrame:
    """Distinct classification inputs, the first of each key by document and place."""
    first = F.min_by(F.struct("predicate", "context", "lang", "target"), F.struct("doc_id", "ord"))
    return labelled.groupBy("classification_key").agg(first.alias("i")).select("classification_key", "i.*")


def why_bias(docs: DataFrame, axes: DataFrame, vector: str = "embedding") -> DataFrame:
    """doc_id, topic, lang, text_preview and one bias column per axis; noise left out."""
    rows = project(docs.where(F.col("topic") != NOISE_TOPIC), axes, vector)
    bias = [x for x in rows.columns if x.startswith("bias_")]
    return rows.select("doc_id", "topic", "lang", preview("text", 80).alias("text_preview"), *bias)
