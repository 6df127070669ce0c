"""Grouped counts, shares, pivots, profiles and rankings. Every ranking has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from textloom.functions.text import count_label
from textloom.operators.quantiles import exact_quantiles
from textloom.operators.tables import small
from textloom.session import cut


def r6(x: Column) -> Column:
    """Half-even rounding to six places."""
    return F.bround(x, 6)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """count and share of each value; the total comes from the counts."""
    counts = df.groupBy(column).agg(F.count("*").alias("count"))
    return counts.withColumn("share", r6(F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0)))))


def shares_within(df: DataFrame, group: list[str], value: str, count: str = "count", out: str = "pct") -> DataFrame:
    """count of (group, value) and its percentage of the group."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias(count))
    total = F.sum(count).over(Window.partitionBy(*group))
    return counts.withColumn(out, r6(F.col(count) * 100.0 / total))


def pivot_fixed(df: DataFrame, rows: list[str], column: str, values: list[str], measure: Column, fill=0) -> DataFrame:
    """Pivot with a fixed list of columns, missing ones filled: the plan needs no job to find them."""
    return df.groupBy(*rows).pivot(column, values).agg(measure).na.fill(fill)


def exploded_counts(df: DataFrame, keys: list[str], array: str, order: str, top: int | None = 20, item: str = "target") -> DataFrame:
    """(keys, item, count, place) of the items of an array column; ties go to the item first seen by (`order`, position).

    With `top` and a numeric order, one hash aggregate finds counts and first rows (no rows are sorted), and positions are
    looked up only for the items that these two may place among the first.
    """
    if top and isinstance(df.schema[order].dataType, NumericType):
        return _first_items(df, keys, array, order, top, item)
    items = df.select(*keys, F.col(order).alias("_ord"), F.posexplode(array).alias("_pos", item))
    counts = items.groupBy(*keys, item).agg(F.count("*").alias("count"), F.min(F.struct("_ord", "_pos")).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "_first", item))
    out = counts.withColumn("place", place).drop("_first")
    return out.where(F.col("place") <= top) if top else out


def _first_items(df: DataFrame, keys: list[str], array: str, order: str, top: int, item: str) -> DataFrame:
    items = df.select(*keys, F.col(order).alias("_ord"), F.explode(array).alias(item))
    counts = items.groupBy(*keys, item).agg(F.count("*").alias("count"), F.min("_ord").alias("_ord"))
    chance = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "_ord"))
    best = cut(counts.withColumn("_r", chance).where(F.col("_r") <= top).drop("_r"))
    # keys, items and orders may be null, which equal null here
    rows = df.select(F.struct(*keys).alias("_k"), F.col(order).alias("_o"), F.col(array).alias("_a"))
    wanted = best.select(F.struct(*keys).alias("_bk"), F.col("_ord").alias("_bo")).distinct()
    seen = rows.join(small(wanted), F.col("_k").eqNullSafe(F.col("_bk")) & F.col("_o").eqNullSafe(F.col("_bo"))).select("_k", "_o", F.posexplode("_a").alias("_pos", "_item"))
    first = seen.join(small(best.select(F.struct(*keys).alias("_bk"), F.col("_ord").alias("_bo"), F.col(item).alias("_bi"))), F.col("_k").eqNullSafe(F.col("_bk")) & F.col("_o").eqNullSafe(F.col("_bo")) & F.col("_item").eqNullSafe(F.col("_bi")))
    first = first.groupBy("_k", "_item").agg(F.min("_pos").alias("_pos"))
    met = best.join(first, F.struct(*keys).eqNullSafe(F.col("_k")) & F.col(item).eqNullSafe(F.col("_item")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "_ord", "_pos", item))
    return met.withColumn("place", place).where(F.col("place") <= top).select(*keys, item, "count", "place")


def ranked_map(counts: DataFrame, keys: list[str], item: str = "target") -> DataFrame:
    """(keys, items, item_counts) from the rows of exploded_counts(): list by place and map."""
    packed = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", item, "count"))).alias("_all"))
    entries = F.transform("_all", lambda x: F.struct(x[item], x["count"]))
    return packed.select(*keys, F.transform("_all", lambda x: x[item]).alias("items"), F.map_from_entries(entries).alias("item_counts"))


def topic_summary(df: DataFrame, topic: str = "topic", targets: str = "targets", detail: str = "details", order: str = "doc_id", top: int = 10) -> DataFrame:
    """Per topic: size, the top targets as name(n), the five most frequent categories, distinct targets, enriched rows."""
    rows = df.where(F.col(topic) != -1)
    base = rows.groupBy(topic).agg(F.count("*").alias("topic_size"), F.sum(F.coalesce(F.col("llm_enriched").cast("int"), F.lit(0))).cast("long").alias("llm_enriched_rows") if "llm_enriched" in df.columns else F.lit(0).cast("long").alias("llm_enriched_rows"))
    names = exploded_counts(rows, [topic], targets, order, None)
    listed = names.where(F.col("place") <= top).groupBy(topic).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", count_label("target", "count").alias("label")))), lambda x: x["label"]).alias("top_targets"))
    unique = names.groupBy(topic).agg(F.count("*").alias("unique_targets"))
    labels = rows.withColumn("_labels", F.transform(detail, lambda d: d["label"]))
    kinds = ranked_map(exploded_counts(labels, [topic], "_labels", order, 5, "category"), [topic], "category").select(topic, F.col("item_counts").alias("target_categories"))
    out = base.join(listed, topic, "left").join(unique, topic, "left").join(kinds, topic, "left")
    return out.select(topic, "topic_size", F.coalesce("top_targets", F.array().cast("array<string>")).alias("top_targets"), F.coalesce("target_categories", F.create_map().cast("map<string,bigint>")).alias("target_categories"), F.coalesce("unique_targets", F.lit(0)).alias("unique_targets"), "llm_enriched_rows")


def dominant(df: DataFrame, keys: list[str], value: str, order: str, out: str = "dominant") -> DataFrame:
    """The most frequent value of each group and the group's rows; ties go to the value first seen."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("f"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias(out), F.sum("_n").alias("rows"))


def modal(df: DataFrame, keys: list[str], value: str, out: str = "mode") -> DataFrame:
    """Smallest of the most frequent values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias(out))


def melt(df: DataFrame, keys: list[str], axes: list[str], name: str = "axis", value: str = "value") -> DataFrame:
    return df.unpivot(keys, axes, name, value)


def means(df: DataFrame, keys: list[str], columns: list[str], suffix: str = "_mean", digits: int = 6) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.bround(F.avg(x), digits).alias(f"{x}{suffix}") for x in columns])


def lowest_axis(df: DataFrame, axes: list[str], name: str = "dominant_axis", value: str = "dominant_value") -> DataFrame:
    """Per row the axis with the smallest value; ties go to the first axis. Nulls don't count."""
    entries = F.filter(F.array(*[F.struct(F.col(a).cast("double").alias("v"), F.lit(i).alias("o"), F.lit(a).alias("a")) for i, a in enumerate(axes)]), lambda s: s["v"].isNotNull())
    best = F.array_min(entries)
    return df.withColumn(name, best["a"]).withColumn(value, best["v"])


def language_axis_summary(df: DataFrame, axes: list[str], lang: str = "lang", topic: str = "topic") -> DataFrame:
    """Per language and axis: n, mean, population sd, standard error, 95 % interval, median, quartiles, salience (mean
    less the language's mean of means), rank by salience, and the topic with the lowest mean."""
    long = melt(df.select(lang, topic, *axes), [lang, topic], axes)
    stats = long.groupBy(lang, "axis").agg(
        F.count("value").alias("n"), F.avg("value").alias("_m"), F.stddev_pop("value").alias("_sd"), F.stddev_samp("value").alias("_ss"),
    )
    marks = exact_quantiles(long, [lang, "axis"], "value", {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    stats = stats.join(marks.select(F.col(lang).alias("_lang"), F.col("axis").alias("_axis"), "_q1", "_q2", "_q3"), F.col(lang).eqNullSafe(F.col("_lang")) & (F.col("axis") == F.col("_axis")), "left")
    by_topic = long.groupBy(lang, "axis", topic).agg(F.avg("value").alias("_t"))
    least = by_topic.groupBy(lang, "axis").agg(F.min_by(topic, F.struct(F.bround("_t", 9), topic)).alias("most_negative_topic"))
    order = F.create_map(*[F.lit(x) for i, a in enumerate(axes) for x in (a, i)])
    salience = F.col("_m") - F.avg("_m").over(Window.partitionBy(lang))
    stats = stats.withColumn("_se", F.try_divide(F.col("_ss"), F.sqrt("n"))).withColumn("_sal", salience)
    stats = stats.withColumn("rank", F.row_number().over(Window.partitionBy(lang).orderBy(F.bround("_sal", 9), order[F.col("axis")])))
    return stats.join(least, [lang, "axis"]).select(
        lang, "axis", "n", r6(F.col("_m")).alias("mean"), r6(F.col("_sd")).alias("sd"), r6(F.col("_se")).alias("se"), r6(F.col("_m") - 1.96 * F.col("_se")).alias("ci_low"), r6(F.col("_m") + 1.96 * F.col("_se")).alias("ci_high"),
        r6(F.col("_q2")).alias("median"), r6(F.col("_q1")).alias("q25"), r6(F.col("_q3")).alias("q75"), r6(F.col("_sal")).alias("salience"), "rank", "most_negative_topic",
    )


def topic_purity(df: DataFrame, topic: str = "topic", lang: str = "lang", pure: float = 0.9) -> DataFrame:
    """Per topic: rows, Shannon entropy (nats) of its language shares, the largest share, and whether it is pure."""
    counts = df.where(F.col(topic) != -1).groupBy(topic, lang).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(topic))
    parts = counts.withColumn("p", share)
    return parts.groupBy(topic).agg(F.sum("n").alias("rows"), r6(F.sum(-F.col("p") * F.log("p"))).alias("entropy"), r6(F.max("p")).alias("top_share"), (F.max("p") > pure).alias("pure"))


def cluster_quality(df: DataFrame, topic: str = "topic", lang: str = "lang", pure: float = 0.9) -> DataFrame:
    """One row: topics, pure and mixed topics, share of noise rows, share of mixed topics."""
    noise = df.agg(r6(F.avg((F.col(topic) == -1).cast("double"))).alias("noise_ratio"))
    kinds = topic_purity(df, topic, lang, pure).agg(F.count("*").alias("topics"), F.count_if("pure").alias("pure_topics"))
    kinds = kinds.select("topics", "pure_topics", (F.col("topics") - F.col("pure_topics")).alias("mixed_topics"), r6(F.try_divide(F.col("topics") - F.col("pure_topics"), F.col("topics"))).alias("mixed_ratio"))
    return noise.join(kinds)


def keyword_distribution(docs: DataFrame, keywords: list[str], text_col: str = "text", case_sensitive: bool = False) -> DataFrame:
    """Per keyword: documents that contain it, their share of all rows and of all matches, in percent; absent ones with 0."""
    from textloom.functions.text import hit_words

    spark = docs.sparkSession
    hits = docs.select(F.explode(hit_words(text_col, keywords, case_sensitive)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("count"))
    total = docs.agg(F.count("*").alias("_rows"))
    listed = spark.createDataFrame([(k,) for k in keywords], "keyword string")
    full = F.broadcast(listed).join(hits, "keyword", "left").select("keyword", F.coalesce("count", F.lit(0)).alias("count"))
    everything = Window.partitionBy(F.lit(0))
    return full.join(F.broadcast(total)).select("keyword", "count", r6(F.try_divide(F.col("count") * 100.0, F.col("_rows"))).alias("row_pct"), r6(F.coalesce(F.try_divide(F.col("count") * 100.0, F.sum("count").over(everything)), F.lit(0.0))).alias("match_pct"))
