"""One run of all layers over one source, with checkpoints in Parquet, and its command line."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.match import Rules
from textloom.operators.plugins import hashed_embedding
from textloom.operators.statistics import anova
from textloom.plans.export import Result, axis_columns, export
from textloom.plans.stages import document_stats, how_labels, prepare, topic_vocabulary, who_entities, who_summary, who_targets, why_bias
from textloom.sinks.writers import run_id
from textloom.sources.readers import first_existing, load_config, read_csv

DEFAULTS = {
    "input": "documents.csv", "output": "out", "lang": "auto", "work": None, "strict": False, "viz_only": False,
    "stages": {"who": True, "how": True, "why": True}, "who": {"top_n": 10, "min_entities": 2, "gazetteer": None}, "how": {"rules": None, "max_rows": None}, "why": {"axes": None, "max_docs": None}, "export": {"formats": ["jsonl", "csv", "markdown"]},
}


@dataclass
class Inputs:
    """Data and plug-ins of a run; everything has an offline default."""

    gazetteer: list[tuple[str, str]] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    rules: Rules = field(default_factory=Rules)
    axes: DataFrame | None = None  # axis, vec
    enrich: object = None
    classify: object = None
    embed: object = None  # DataFrame -> DataFrame with `embedding`


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents from Parquet or CSV with doc_id, text, lang, topic; a missing doc_id is the row's hash, a missing topic 0."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path, strings=True)
    if "doc_id" not in df.columns:
        df = df.withColumn("doc_id", F.xxhash64(*df.columns))
    if "topic" not in df.columns:
        df = df.withColumn("topic", F.lit(0))
    lang = F.col("lang") if "lang" in df.columns else F.lit("en")
    return df.select(F.col("doc_id").cast("long"), F.col("text"), lang.alias("lang"), F.col("topic").cast("double").cast("int").alias("topic"), *[x for x in ("embedding",) if x in df.columns])


def run(spark: SparkSession, docs: DataFrame, inputs: Inputs, config: dict | None = None) -> Result:
    """Runs the layers that the configuration asks for. A failing layer is recorded and the run goes on, unless strict.

    With `work`, each layer is written there and read again; a layer that is skipped is read from there if it exists
    (and named `*_cached`).
    """
    cfg = load_config("", config, DEFAULTS)
    docs = prepare(docs, cfg["lang"])
    result = Result(run_id=run_id(), input_path=str(cfg["input"]), stats=document_stats(docs))
    summary: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        if not cfg["work"]:
            return df
        path = f"{cfg['work']}/{name}.parquet"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def who() -> DataFrame:
        entities = keep("who_entities", who_entities(docs, inputs.gazetteer, inputs.aliases, enrich=inputs.enrich, least=cfg["who"]["min_entities"]))
        summary["who"] = keep("who_summary", who_summary(entities, cfg["who"]["top_n"]))
        return keep("who", who_targets(entities))

    def how() -> DataFrame:
        topics = summary.get("who") if "who" in summary else spark.read.parquet(f"{cfg['work']}/who_summary.parquet") if cfg["work"] else who_summary(who_entities(docs, inputs.gazetteer, inputs.aliases))
        rows = prepare(docs, None, cfg["how"]["max_rows"])
        return keep("how", how_labels(rows, topic_vocabulary(topics), inputs.rules, inputs.classify))

    def why() -> DataFrame:
        rows = prepare(docs, None, cfg["why"]["max_docs"])
        rows = inputs.embed(rows) if inputs.embed else rows if "embedding" in rows.columns else rows.withColumn("embedding", hashed_embedding("text"))
        if inputs.axes is None:
            raise ValueError("no axis vectors")
        return keep("why", why_bias(rows, inputs.axes))

    for name, stage in (("who", who), ("how", how), ("why", why)):
        cached = first_existing(spark, [f"{cfg['work']}/{name}.parquet"]) if cfg["work"] else None
        try:
            if cfg["stages"].get(name, True) and not cfg["viz_only"]:
                setattr(result, name, stage())
                result.stages_run.append(name)
            elif cached:
                setattr(result, name, spark.read.parquet(cached))
                result.stages_run.append(f"{name}_cached")
        except Exception as error:
            if cfg["strict"]:
                raise
            result.errors.append({"stage": name, "error": str(error)[:200]})
    if result.why is not None:
        result.anova = anova(result.why, axis_columns(result.why), "lang")
    return result


def arguments(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="textloom", description="Who is named, how, and on which axis: one run over a table of documents.")
    p.add_argument("--input")
    p.add_argument("--output")
    p.add_argument("--work")
    p.add_argument("--lang", choices=["zh", "en", "ja", "auto"])
    p.add_argument("--config")
    which = p.add_mutually_exclusive_group()
    which.add_argument("--only", nargs="+", choices=["who", "how", "why"])
    which.add_argument("--skip", nargs="+", choices=["who", "how", "why"])
    p.add_argument("--viz-only", action="store_true", default=None)
    p.add_argument("--strict", action="store_true", default=None)
    p.add_argument("--max-rows", type=int)
    p.add_argument("--max-docs", type=int)
    p.add_argument("--top-n", type=int)
    p.add_argument("--min-entities", type=int)
    p.add_argument("--gazetteer")
    p.add_argument("--rules")
    p.add_argument("--axes", help="Parquet table axis, vec")
    return p.parse_args(args)


def configuration(ns: argparse.Namespace) -> dict:
    """Command line over file over defaults."""
    over = {k: v for k, v in {"input": ns.input, "output": ns.output, "work": ns.work, "lang": ns.lang, "viz_only": ns.viz_only, "strict": ns.strict}.items() if v is not None}
    if ns.only or ns.skip:
        over["stages"] = {s: (s in ns.only if ns.only else s not in ns.skip) for s in ("who", "how", "why")}
    over["who"] = {"top_n": ns.top_n, "min_entities": ns.min_entities, "gazetteer": ns.gazetteer}
    over["how"] = {"max_rows": ns.max_rows, "rules": ns.rules}
    over["why"] = {"max_docs": ns.max_docs, "axes": ns.axes}
    return load_config(ns.config or "", over, DEFAULTS)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit codes: 0 done, 1 no input, 2 a layer failed in strict mode, 3 anything else, 130 interrupted."""
    from textloom.session import local_session
    from textloom.sources.lexicons import load_gazetteer, load_rules

    cfg = configuration(arguments(sys.argv[1:] if args is None else args))
    try:
        spark = spark or local_session("*")
        if not first_existing(spark, [cfg["input"]]):
            print(f"no input: {cfg['input']}", file=sys.stderr)
            return 1
        inputs = Inputs()
        if cfg["who"]["gazetteer"] and os.path.exists(cfg["who"]["gazetteer"]):
            inputs.gazetteer, inputs.aliases = load_gazetteer(cfg["who"]["gazetteer"])
        if cfg["how"]["rules"]:
            inputs.rules = load_rules(cfg["how"]["rules"])
        if cfg["why"]["axes"]:
            inputs.axes = spark.read.parquet(cfg["why"]["axes"])
        try:
            result = run(spark, read_documents(spark, cfg["input"]), inputs, cfg)
        except Exception as error:  # noqa: BLE001
            print(f"failed: {error}", file=sys.stderr)
            return 2 if cfg["strict"] else 3
        for path in export(result, cfg["output"], tuple(cfg["export"]["formats"])):
            print(path)
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as error:  # noqa: BLE001
        print(f"failed: {error}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
