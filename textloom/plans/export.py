"""Merging and exporting the layers: JSON lines per document, tables, summary, metadata and a Markdown report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.aggregates import dominant, language_axis_summary, means, modal, shares_within
from textloom.operators.statistics import axis_long_table, pearson_matrix
from textloom.operators.tables import small, top_k_members
from textloom.sinks.writers import markdown_table, put_file, write_csv_file, write_json, write_jsonl


@dataclass
class Result:
    """What a run has; a layer that did not run is None."""

    who: DataFrame | None = None  # topic, lang, targets, target_counts
    how: DataFrame | None = None  # doc_id, topic, lang, text, target, predicate, frame_type, layer
    why: DataFrame | None = None  # doc_id, topic, lang, bias_*
    anova: DataFrame | None = None
    stats: dict = field(default_factory=dict)
    stages_run: list[str] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)
    run_id: str = "run"
    input_path: str = ""


def axis_columns(why: DataFrame | None) -> list[str]:
    return [x for x in why.columns if x.startswith("bias_")] if why is not None else []


def bias_map(why: DataFrame):
    names = [F.lit(x.removeprefix("bias_")) for x in axis_columns(why)]
    return F.map_filter(F.map_from_arrays(F.array(*names), F.array(*[F.col(x).cast("double") for x in axis_columns(why)])), lambda k, v: v.isNotNull())


def merged_documents(r: Result) -> DataFrame:
    """One row per labelled expression: text (200 characters), topic, lang, who (five targets), how, why. Noise is left out."""
    how = r.how.where(F.col("frame_type") != "noise")
    rows = how.select("doc_id", F.substring("text", 1, 200).alias("text"), "topic", "lang", F.struct("predicate", "target", "frame_type", "layer").alias("how"))
    none = F.array().cast("array<string>")
    if r.who is not None:
        rows = rows.join(small(r.who.select("topic", "lang", F.slice("targets", 1, 5).alias("_who"))), ["topic", "lang"], "left")
    else:
        rows = rows.withColumn("_who", none)
    empty = F.create_map().cast("map<string,double>")
    if r.why is not None:
        rows = rows.join(r.why.select("doc_id", bias_map(r.why).alias("_why")), "doc_id", "left")
    else:
        rows = rows.withColumn("_why", empty)
    return rows.select("text", "topic", "lang", F.coalesce("_who", none).alias("who"), "how", F.coalesce("_why", empty).alias("why"))


def summary_rows(r: Result) -> DataFrame:
    """One row per (topic, lang) of any layer: top targets, dominant frame and frames, mean of each axis over the records."""
    keys = ["topic", "lang"]
    parts = []
    if r.who is not None:
        parts.append(r.who.select(*keys, F.array_join(F.slice("targets", 1, 5), "; ").alias("who_top_targets")))
    if r.how is not None:
        named = dominant(r.how.where(F.col("frame_type") != "noise"), keys, "frame_type", "doc_id", "how_dominant_frame")
        parts.append(named.withColumnRenamed("rows", "how_frame_count"))
    if r.why is not None:
        parts.append(r.why.groupBy(*keys).agg(*[F.bround(F.sum(x) / F.count("*"), 4).alias(f"why_{x.removeprefix('bias_')}_mean") for x in axis_columns(r.why)]))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "full_outer")
    fill = {k: v for k, v in {"who_top_targets": "", "how_dominant_frame": "", "how_frame_count": 0}.items() if k in out.columns}
    return out.na.fill(fill).orderBy(*keys)


def how_summary(how: DataFrame) -> DataFrame:
    """(lang, topic, target, frame_type): count, modal verb, percentage within the language. Noise is left out."""
    rows = how.where(F.col("frame_type") != "noise")
    keys = ["lang", "topic", "target", "frame_type"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("count")).join(modal(rows, keys, "verb", "top_verb"), keys, "left")
    total = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    return counts.join(small(total), "lang").select(*keys, "count", "top_verb", F.bround(F.col("count") * 100.0 / F.col("_n"), 2).alias("pct_in_lang"))


def who_rows(who: DataFrame) -> DataFrame:
    return who.select("topic", "lang", F.explode("target_counts").alias("target", "count"))


def axis_means(why: DataFrame) -> dict:
    row = why.agg(*[F.bround(F.avg(x), 4).alias(x.removeprefix("bias_")) for x in axis_columns(why)]).first()
    return row.asDict() if row else {}


def frame_counts(how: DataFrame) -> dict:
    return {r["frame_type"]: r["count"] for r in how.where(F.col("frame_type") != "noise").groupBy("frame_type").count().collect()}


def chart_tables(r: Result, top: int = 30) -> dict[str, DataFrame]:
    """The tables behind the charts of a run, by name: small, and in the shape that a chart needs. Drawing is left to other programs."""
    out: dict[str, DataFrame] = {}
    if r.who is not None:
        out["who_targets"] = who_rows(r.who)
    if r.how is not None:
        rows = r.how.where(F.col("frame_type") != "noise")
        out["how_frame_by_topic"] = shares_within(rows, ["topic"], "frame_type")
        out["how_frame_by_language"] = shares_within(rows, ["lang"], "frame_type")
        out["how_target_by_frame"] = top_k_members(rows, "target", top).groupBy("target", "frame_type").agg(F.count("*").alias("count"))
        out["how_hierarchy"] = rows.rollup("lang", "topic", "frame_type").agg(F.count("*").alias("count"))
        out["how_verbs"] = rows.groupBy("frame_type", "verb").agg(F.count("*").alias("count"))
    if r.why is not None:
        axes = axis_columns(r.why)
        out["why_axis_by_language"] = axis_long_table(r.why, axes, "lang")
        out["why_axis_by_topic"] = means(r.why, ["topic"], axes)
        out["why_correlation"] = pearson_matrix(r.why, axes)
        out["why_language_summary"] = language_axis_summary(r.why, axes)
    return out


def meta(r: Result) -> dict:
    out = {"run_timestamp": r.run_id, "input_path": r.input_path, "stages_run": r.stages_run, "errors": [{**e, "error": str(e.get("error"))[:200]} for e in r.errors], **r.stats}
    out["who_topic_count"] = r.who.count() if r.who is not None else 0
    out["how_frame_counts"] = frame_counts(r.how) if r.how is not None else {}
    out["how_record_count"] = sum(out["how_frame_counts"].values())
    out["why_record_count"] = r.why.count() if r.why is not None else 0
    out["why_axis_means"] = axis_means(r.why) if r.why is not None else {}
    out["why_anova"] = [x.asDict() for x in r.anova.collect()] if r.anova is not None else []
    return out


def export(r: Result, folder: str, formats: tuple[str, ...] = ("jsonl", "csv", "markdown")) -> list[str]:
    """Writes the asked formats (`charts`: the tables behind charts) and returns the paths; a layer that did not run is skipped."""
    at = lambda name: f"{folder}/{r.run_id}_{name}"
    files = []
    if "jsonl" in formats:
        if r.how is not None:
            files.append(write_jsonl(merged_documents(r), at("pipeline_results.jsonl")))
        files.append(write_json(meta(r), at("pipeline_meta.json")))
    if "csv" in formats:
        if r.who is not None:
            files.append(write_csv_file(who_rows(r.who), at("who_targets.csv"), order=["topic", "lang", F.desc("count"), "target"]))
        if r.how is not None:
            files.append(write_csv_file(r.how.where(F.col("frame_type") != "noise"), at("how_expressions.csv"), order=["doc_id", "ord"] if "ord" in r.how.columns else ["doc_id"]))
        if r.why is not None:
            files.append(write_csv_file(r.why, at("why_bias_matrix.csv"), order=["doc_id"]))
        if any(x is not None for x in (r.who, r.how, r.why)):
            files.append(write_csv_file(summary_rows(r), at("pipeline_summary.csv")))
    if "charts" in formats:
        files += [write_csv_file(df, at(f"chart_{name}.csv"), order=df.columns) for name, df in chart_tables(r).items()]
    if "markdown" in formats:
        files.append(put_file(at("report.md"), report(r)))
    return files


def report(r: Result) -> str:
    m = meta(r)
    lines = [f"# Report {r.run_id}", "", f"Documents: {m.get('total_documents', 0)}; topics: {m.get('topic_count', 0)}; languages: {m.get('language_counts', {})}", ""]
    lines += ["## WHO", "", markdown_table([x.asDict() for x in r.who.orderBy("topic", "lang").limit(1000).collect()], ["topic", "lang", "targets"]) if r.who is not None else "_not run_\n"]
    lines += ["## HOW", ""]
    if r.how is not None:
        pct = shares_within(r.how.where(F.col("frame_type") != "noise"), ["lang"], "frame_type").orderBy("lang", F.desc("count"), "frame_type")
        lines.append(markdown_table([x.asDict() for x in pct.limit(1000).collect()]))
    else:
        lines.append("_not run_\n")
    lines += ["## WHY", "", markdown_table([{"axis": k, "mean": v} for k, v in m["why_axis_means"].items()]) if r.why is not None else "_not run_\n"]
    if r.anova is not None:
        lines.append(markdown_table([{k: x[k] for k in ("axis", "f_stat", "p_value", "eta_squared", "significant")} for x in r.anova.collect()]))
    if r.errors:
        lines += ["## Errors", "", markdown_table(m["errors"])]
    return "\n".join(lines)
