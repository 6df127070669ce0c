"""Dictionaries, rules, keyword lists and stop words."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import c
from textloom.operators.match import FRAMES, Rules

# Axis names of the public dictionaries. Fixed values.
AXES = ("harm", "fairness", "loyalty", "authority", "sanctity", "realistic_threat", "symbolic_threat")
FOUNDATION_AXIS = {"care": "harm", "harm": "harm", "fairness": "fairness", "fair": "fairness", "loyalty": "loyalty", "ingroup": "loyalty", "loya": "loyalty", "authority": "authority", "auth": "authority", "sanctity": "sanctity", "purity": "sanctity", "sanc": "sanctity", "realistic_threat": "realistic_threat", "symbolic_threat": "symbolic_threat", "realistic": "realistic_threat", "symbolic": "symbolic_threat"}
POLARITY = {"virtue": "pos", "vice": "neg", "pos": "pos", "neg": "neg"}


def whole_text(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(path, content) of small files, decoded with replacement."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", encoding).alias("content"))


def read_keywords(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """(lang, keyword) of a JSON object {language: [keyword, ...]}; blanks go, repeats count once."""
    parsed = F.from_json("content", "map<string,array<string>>")
    rows = whole_text(spark, path).select(F.explode(parsed).alias("lang", "words")).select("lang", F.explode(F.transform("words", lambda w: F.trim(w))).alias("keyword"))
    rows = rows.where("keyword <> ''").distinct()
    return rows.where(F.col("lang") == lang) if lang else rows


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """word of a file with one word per line; lines that start with # are remarks."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> '' and not startswith(word, '#')").distinct()


def read_liwc(spark: SparkSession, path: str) -> DataFrame:
    """(word, category, ord) of a LIWC dictionary: a section of `id<TAB>name` between two % and then `word<TAB>id...`.

    CR and LF both end lines. Words keep a trailing wildcard; ids without a name are skipped.
    """
    parts = whole_text(spark, path).select(F.split("content", "%").alias("p")).where(F.size("p") >= 3)
    lines = lambda i: F.posexplode(F.split(F.col("p")[i], r"[\r\n]+"))
    names = parts.select(lines(1).alias("_o", "line")).where(F.col("line").contains("\t"))
    names = names.select(F.trim(F.split_part("line", F.lit("\t"), F.lit(1))).alias("id"), F.trim(F.regexp_replace("line", r"^[^\t]*\t", "")).alias("category"))
    words = parts.select(lines(2).alias("ord", "line")).select("ord", F.split(F.trim("line"), "\t").alias("f"))
    words = words.select("ord", F.trim(F.col("f")[0]).alias("word"), F.posexplode(F.slice("f", 2, 1000)).alias("at", "id")).where("word <> ''")
    return words.withColumn("id", F.trim("id")).join(F.broadcast(names), "id").select("word", "category", F.struct("ord", "at").alias("ord"))


def dotted_axes(entries: DataFrame) -> DataFrame:
    """(axis, polarity, word, ord) of categories such as care.virtue."""
    return _mapped(entries, F.lower(F.substring_index("category", ".", 1)), F.lower(F.substring_index("category", ".", -1)), F.col("category").contains("."))


def joined_axes(entries: DataFrame) -> DataFrame:
    """(axis, polarity, word, ord) of categories such as HarmVirtue; others (a general class) are skipped."""
    return _mapped(entries, F.lower(F.regexp_extract("category", "^(.*)(Virtue|Vice)$", 1)), F.lower(F.regexp_extract("category", "^(.*)(Virtue|Vice)$", 2)), F.col("category").rlike("(Virtue|Vice)$"))


def _mapped(entries: DataFrame, foundation: Column, polarity: Column, valid: Column) -> DataFrame:
    axis = F.create_map(*[F.lit(x) for kv in FOUNDATION_AXIS.items() for x in kv])
    sign = F.create_map(*[F.lit(x) for kv in POLARITY.items() for x in kv])
    return entries.where(valid).select(axis[foundation].alias("axis"), sign[polarity].alias("polarity"), "word", "ord").where("axis is not null and polarity is not null")


def read_lexicon_csv(spark: SparkSession, path: str) -> DataFrame:
    """(axis, polarity, word, ord) of a table word, foundation, polarity (virtue or vice)."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).withColumn("_ord", F.monotonically_increasing_id())
    return _mapped(rows.select(F.trim("word").alias("word"), F.lower(F.trim("foundation")).alias("f"), F.lower(F.trim("polarity")).alias("p"), F.struct(F.col("_ord").cast("int").alias("ord"), F.lit(0).alias("at")).alias("ord")), F.col("f"), F.col("p"), F.lit(True))


def infer_polarity(word: Column | str, negative: list[str], prefixes: list[str]) -> Column:
    """neg for a listed word or one that starts with a negative prefix and goes on, else pos."""
    w = c(word)
    prefixed = F.lit(False)
    for p in prefixes:
        prefixed = prefixed | (w.startswith(p) & (F.char_length(w) > len(p)))
    return F.when(w.isin(negative or ["\0"]) | prefixed, "neg").otherwise("pos")


def merge_lexicons(*parts: DataFrame) -> DataFrame:
    """(axis, polarity, word, ord): the parts in order; words of two or more characters, one per form without wildcard."""
    ranked = None
    for rank, part in enumerate(parts):
        one = part.select("axis", "polarity", F.trim("word").alias("word"), F.struct(F.lit(rank).alias("rank"), F.col("ord.ord").cast("int").alias("ord"), F.col("ord.at").cast("int").alias("at")).alias("ord"))
        ranked = one if ranked is None else ranked.union(one)
    stem = F.trim(F.regexp_replace("word", r"\*+$", ""))
    rows = ranked.withColumn("_stem", stem).where((F.char_length("word") >= 2) & (F.col("_stem") != ""))
    place = F.row_number().over(Window.partitionBy("axis", "polarity", "_stem").orderBy("ord"))
    return rows.withColumn("_p", place).where("_p = 1").select("axis", "polarity", "word", "ord")


def load_rules(path: str) -> Rules:
    """Rules from a JSON file: frames {name: [words]} (known frames first, in their order), noise, stop, actions {lang: pattern}."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    frames = data.get("frames", {})
    ordered = {k: frames[k] for k in FRAMES if k in frames} | {k: v for k, v in frames.items() if k not in FRAMES}
    return Rules(ordered, data.get("noise", []), data.get("stop", []), data.get("actions", {}))


def load_gazetteer(path: str) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """((term, category) list, alias map) from a JSON file {categories: {name: [terms]}, aliases: {form: name}}."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return [(t, k) for k, terms in data.get("categories", {}).items() for t in terms], data.get("aliases", {})
