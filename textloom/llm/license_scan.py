"""License scan: phrases, and an exact set-similarity join of text blocks with license templates. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import bind
from textloom.session import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The letters of WORD in a lower-cased text, said positively: Java tests such a class several times faster.
LETTER = r"[0-9a-z\x{80}-\x{10FFFF}]"
# Phrases and their labels. Fixed by the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Sentences of notices, in the words of WORD; a block that holds at least CONTAINMENT of a template's words gets its label.
TEMPLATES = (
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "released under the gpl version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "licensed under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
CONTAINMENT = 0.8
SPAN = max(len(text.split()) for _, text in TEMPLATES)  # words after its first line that a wrapped block reaches


def templates_of(templates=TEMPLATES) -> list[tuple[int, str, list[str]]]:
    return [(i, label, list(dict.fromkeys(text.split()))) for i, (label, text) in enumerate(templates)]


def least_overlap(size: int, containment: float = CONTAINMENT) -> int:
    """Words of a template of `size` words that a block must hold."""
    return math.ceil(containment * size - 1e-9)


def any_word(words: list[str]) -> str:
    """A pattern of whole words, its alternatives merged by their common heads, so that a place is tried once per letter."""
    tree: dict = {}
    for w in words:
        node = tree
        for letter in w:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        parts = [letter + pattern(child) for letter, child in sorted(node.items()) if letter]
        if not parts:
            return ""
        return f"(?:{'|'.join(parts + [''] * ('' in node))})" if len(parts) > 1 or "" in node else parts[0]

    return f"(?<!{LETTER}){pattern(tree)}(?!{LETTER})"


def word_frequencies(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the templates occurs in all texts; the result is as long as the vocabulary."""
    words = texts.select(F.explode(F.regexp_extract_all("t", F.lit(any_word(vocabulary)), F.lit(0))).alias("word"))
    return {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}


def template_blocks(texts: DataFrame, spark: SparkSession, templates=TEMPLATES, containment: float = CONTAINMENT, wrapped: bool = False) -> DataFrame:
    """(key, label, overlap share) of every block that holds at least `containment` of a template's distinct words.

    A block is a line or, if `wrapped`, a line and the SPAN words after it, so that a notice as long as the longest
    template lies whole in one block wherever its lines are broken; lines without words do not count.

    texts: key, t (lower-cased). Words get ranks by their frequency in the whole corpus, rarest first. Of a template
    that needs `a` of its n words, a block must hold one of the n - a + 1 rarest (prefix filter), and of the block's
    words that occur in templates, the match lies among the first m - a + 1; blocks with fewer than `a` such words go
    (length filter), and so do matches after which too few words are left in either (positional filter). The rest is
    verified by intersection. Prefix words are an index of a few dozen rows, so its side of the join is broadcast.
    """
    wanted = templates_of(templates)
    vocabulary = sorted({w for _, _, words in wanted for w in words})
    counts = word_frequencies(texts, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    index, whole, rare = [], [], set()
    for i, label, words in wanted:
        ranks, need = sorted(rank[w] for w in words), least_overlap(len(words), containment)
        whole.append((i, label, ranks, need))
        index += [(r, i, p, len(words), need) for p, r in enumerate(ranks[: len(words) - need + 1])]
    order = sorted(rank, key=rank.get)
    rare = {order[r] for r, *_ in index}
    probe = any_word(sorted(rare))
    places = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    least = min(need for *_, need in whole)
    if wrapped:
        numbered = F.transform(F.split("t", "\n"), lambda x: F.transform(F.regexp_extract_all(x, F.lit(LETTER + "+"), F.lit(0)), lambda w: F.coalesce(places[w], F.lit(-1))))
        prefixed = F.array(*[F.lit(rank[w]) for w in sorted(rare)])
        fit = lambda r: F.when((F.size(r) >= least) & F.arrays_overlap(r, prefixed), r)
        windows = F.filter(bind(F.filter(numbered, lambda x: F.size(x) > 0), lambda x: _windows(x, fit)), lambda r: r.isNotNull())
        blocks = texts.where(F.col("t").rlike(probe)).select("key", F.posexplode(windows).alias("block", "ranks"))
    else:
        lines = texts.where(F.col("t").rlike(probe)).select("key", F.posexplode(F.split("t", "\n")).alias("block", "line")).where(F.col("line").rlike(probe))
        ranks = F.filter(F.transform(F.array_distinct(F.regexp_extract_all("line", F.lit(LETTER + "+"), F.lit(0))), lambda w: places[w]), lambda r: r.isNotNull())
        blocks = lines.select("key", "block", F.array_sort(ranks).alias("ranks")).where(F.size("ranks") >= least)
    probes = blocks.select("key", "block", "ranks", F.posexplode("ranks").alias("at", "rank"))
    prefix = spark.createDataFrame(index, "rank int, template int, place int, words int, need int")
    met = probes.join(F.broadcast(prefix), "rank")
    own = F.size("ranks")
    met = met.where((own >= F.col("need")) & (F.col("at") <= own - F.col("need")) & (1 + F.least(F.col("words") - 1 - F.col("place"), own - 1 - F.col("at")) >= F.col("need")))
    pairs = met.select("key", "block", "ranks", "template").join(F.broadcast(spark.createDataFrame(whole, "template int, label string, all array<int>, need int")), "template")
    shared = F.size(F.array_intersect("ranks", "all"))
    return pairs.where(shared >= F.col("need")).select("key", "label", (shared / F.size("all")).alias("share"))


def _windows(lines: Column, fit) -> Column:
    """The sorted ranks in each line and the SPAN words after it, from the lines' words as ranks, -1 for others; null
    at once where fit() is, as a long text has many."""

    def of_heads(heads: Column) -> Column:
        after = lambda i: F.slice(F.flatten(F.slice(heads, i + 2, SPAN)), 1, SPAN)
        return F.transform(lines, lambda x, i: bind(F.array_sort(F.array_distinct(F.filter(F.concat(x, after(i)), lambda r: r >= 0))), fit))

    return bind(F.transform(lines, lambda x: F.slice(x, 1, SPAN)), of_heads)


def phrase_starts(words: Column, phrase: str) -> Column:
    """Word places at which a phrase's words stand one after the other."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            found = found & (F.get(words, i + k) == p)
        return found

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, wrapped: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. No Python.

    n_base counts all places of the phrases, first_word and last_word are their smallest and largest start in words from
    0 (null without one). labels adds the labels of template_blocks(); blocks are lines, or go on over the lines after if `wrapped`. score is 1 with a phrase, else
    the largest containment found, else 0. The blocks found are grouped by their text's digest before they meet the
    documents, so copies of one text cost one lookup row.

    Cases: null text = empty text = no words; a null id is returned as it is; repeated rows are scanned each; a label
    found twice is listed once; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    rows = rows.withColumn("key", F.sha2("t", 256))
    some = "|".join(GAP.join(p.split()) for p in PHRASES)
    hit = (F.col("t").contains("license") | F.col("t").contains("cc")) & F.col("t").rlike(some)
    words = F.when(hit, F.regexp_extract_all("t", F.lit(LETTER + "+"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    based = rows.select("doc_id", "key", F.regexp_count("t", F.lit(LETTER + "+")).cast("long").alias("n_words"), words.alias("words"))
    starts = F.flatten(F.array(*[_labelled(phrase_starts(F.col("words"), p), label) for p, label in PHRASES.items()]))
    based = based.select("doc_id", "key", "n_words", starts.alias("base"))
    based = based.select("doc_id", "key", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.at").cast("long").alias("first_word"), F.array_max("base.at").cast("long").alias("last_word"), F.array_distinct("base.label").alias("own"))
    found = template_blocks(rows.select("key", "t"), docs.sparkSession, containment=containment, wrapped=wrapped).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    found = cut(found)  # so that the join's sides are plain exchanges, of which a hot text can be split
    out = based.join(found, "key", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("own"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def sql(containment: float = CONTAINMENT) -> str:
    """DuckDB SQL of license_scan(wrapped=True): every line, with the SPAN words after it, against every template."""
    places = " || ".join(
        f"list_transform(list_filter(range(1, greatest(len(words) - {len(p.split()) - 2}, 1)), lambda i: {' AND '.join(f'words[i + {k}] = {w!r}' for k, w in enumerate(p.split()))}), lambda i: {{'at': i - 1, 'label': {label!r}}})"
        for p, label in PHRASES.items()
    )
    rows = ", ".join(f"({label!r}, {words!r}, {least_overlap(len(words), containment)})" for _, label, words in templates_of())
    return rf"""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS words FROM t),
b AS (SELECT doc_id, t, len(words) AS n_words, CASE WHEN contains(t, 'license') OR contains(t, 'cc') THEN {places} ELSE [] END AS base FROM w),
templates(label, words, need) AS (VALUES {rows}),
worded AS (SELECT DISTINCT t, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_extract_all(x, '{WORD}')), lambda x: len(x) > 0) AS own FROM b),
lines AS (SELECT DISTINCT t, list_distinct(list_concat(own[i], flatten(own[i + 1:i + {SPAN}])[1:{SPAN}])) AS words FROM (SELECT t, own, unnest(range(1, len(own) + 1)) AS i FROM worded)),
near AS (SELECT l.t, p.label, len(list_intersect(l.words, p.words)) AS shared, p.need, len(p.words) AS size FROM lines l, templates p WHERE len(l.words) >= p.need),
found AS (SELECT t, list_distinct(list(label)) AS more, max(shared / size) AS share FROM near WHERE shared >= need GROUP BY t)
SELECT doc_id, n_words, len(base) AS n_base, list_min(list_transform(base, lambda x: x.at)) AS first_word, list_max(list_transform(base, lambda x: x.at)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(base, lambda x: x.label), coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM b LEFT JOIN found USING (t)
"""
