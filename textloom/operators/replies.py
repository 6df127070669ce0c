"""What language models answer: parsed by Spark's own expressions, asked for in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import bind, c
from textloom.operators.match import ENTITY, FRAMES, OTHER, Rules, frame_of

BATCH = 40  # inputs of a prompt


def reply_map(reply: Column | str) -> Column:
    """The first object without an object inside, as a map of texts; null if there is none or it is malformed."""
    body = F.regexp_extract(c(reply), r"(?s)\{[^{}]+\}", 0)
    return F.from_json(F.nullif(body, F.lit("")), "map<string,string>")


def reply_entities(reply: Column | str) -> Column:
    """Entities (text, category) of the first list of a reply; none if it is missing or malformed."""
    body = F.regexp_extract(c(reply), r"(?s)\[.*?\]", 0)
    listed = F.from_json(F.nullif(body, F.lit("")), "array<struct<text:string,category:string>>")
    named = F.transform(F.filter(listed, lambda e: e["text"].isNotNull()), lambda e: F.struct(F.trim(e["text"]).alias("text"), F.coalesce(e["category"], F.lit("Unknown")).alias("label"), F.lit("llm").alias("source")))
    return F.coalesce(named, F.array().cast(ENTITY))


def in_batches(rows: DataFrame, model: Callable[[], Callable[[list[dict]], str]], key: str, columns: list[str], size: int = BATCH) -> DataFrame:
    """(key, place, reply): each task asks for its rows in batches of `size`, numbered from 1; a batch that fails has a null reply.

    `model` is a factory that is called once per task; what it makes gets a list of rows and answers with a text.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, waiting = model(), []

        def answer(items: list[dict]) -> pd.DataFrame:
            try:
                reply = ask([{k: v for k, v in x.items() if k != "_key"} for x in items])
            except Exception:  # noqa: BLE001  a model's failure must not lose rows
                reply = None
            return pd.DataFrame({key: [x["_key"] for x in items], "place": range(1, len(items) + 1), "reply": [reply] * len(items)})

        for batch in batches:
            for own, values in zip(batch[key], batch[columns].to_dict("records"), strict=True):
                waiting.append(values | {"_key": own})
                if len(waiting) == size:
                    yield answer(waiting)
                    waiting = []
        if waiting:
            yield answer(waiting)

    return rows.select(*dict.fromkeys([key, *columns])).mapInPandas(run, f"`{key}` {kind}, place int, reply string")


def classify_in_batches(todo: DataFrame, model: Callable[[], Callable[[list[dict]], str]], rules: Rules, frames: tuple[str, ...] = FRAMES, size: int = BATCH) -> DataFrame:
    """(classification_key, frame_type) of distinct inputs: the `classify` of how_labels().

    A reply is an object from the number of an input to its frame; a frame that isn't listed, or a number that is
    missing, is `other`. Inputs of a batch without such an object are labelled by the rules. What was labelled goes
    into the cache, so a run that is repeated asks for the rest only.
    """
    inputs = ["predicate", "context", "lang", "target"]
    asked = in_batches(todo, model, "classification_key", inputs, size).withColumn("_map", reply_map("reply"))
    said = F.element_at("_map", F.col("place").cast("string"))
    known = F.when(F.col("_map").isNotNull(), F.when(said.isin(*frames), said).otherwise(OTHER))
    met = todo.join(asked.select("classification_key", known.alias("_said")), "classification_key")
    return met.select("classification_key", F.coalesce("_said", frame_of("predicate", "context", "target", "lang", rules)).alias("frame_type"))


def numbered_prompt(items: list[dict], head: str = "") -> str:
    """A prompt that lists inputs from 1."""
    lines = [f"{i}. {' | '.join(f'{k}: {v}' for k, v in x.items() if v)}" for i, x in enumerate(items, 1)]
    return "\n".join([head, *lines] if head else lines)


def with_replies(rows: DataFrame, reply: Column | str) -> DataFrame:
    """Adds `more`, the entities of a reply: what the `enrich` of who_entities() returns."""
    return rows.withColumn("more", bind(reply_entities(reply), lambda x: x))
