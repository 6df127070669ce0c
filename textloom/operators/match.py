"""Entities and expressions: dictionary matching, entity cleaning, window extraction and ordered frame rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import EDGE, bind, c, contains_any, language_code, normalise, tokens
from textloom.operators.tables import first_by_key

ENTITY = "array<struct<text:string,label:string,source:string>>"

# Frames in the order in which rules are tried, and the two labels beside them. Fixed values.
FRAMES = (
    "cognitive_manipulation",
    "moral_accusation",
    "dehumanization",
    "sexual_abuse_frame",
    "economic_exploitation",
    "political_interference",
    "institutional_rot",
    "social_exclusion",
    "rhetorical_attack",
)
OTHER, NOISE = "other", "noise"

# Verb and sentence forms that no entity has. Fixed values.
JA_VERB = "して|した|している|しまくり|なって|グルに|になった|してる|やってる|ぐずぐず|ズブズブ"
JA_SENTENCE = ".{5,}[がはをにでもとへよりから].{3,}[るたいすくけれてじゃ]$"
ZH_VERB = "[不没被让把给就也都还只]?.{0,2}[住来去起下上过着了把被让]"


@dataclass
class Rules:
    """Word lists of a study; they are data, read by sources.lexicons.load_rules()."""

    frames: dict[str, list[str]] = field(default_factory=dict)
    noise: list[str] = field(default_factory=list)
    stop: list[str] = field(default_factory=list)
    actions: dict[str, str] = field(default_factory=dict)


def gazetteer_entities(gazetteer: list[tuple[str, str]], text: Column | str, lang: Column | str) -> Column:
    """Entities of a dictionary: the longest terms first over the whole text, no overlaps, in a text's own spelling.

    English terms match whole words, others anywhere. A term of two categories has the first one. No built-in matches
    globally longest-first (a regular expression takes the leftmost), so this runs on Arrow batches. One pass of an
    automaton, built once per task, finds all places of all terms.
    """
    order = sorted(((t.lower(), k) for t, k in gazetteer if t), key=lambda x: -len(x[0]))

    @F.pandas_udf(ENTITY)
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        find = _finder(order)
        for texts, langs in batches:
            yield pd.Series([find(t or "", g == "en") for t, g in zip(texts, langs, strict=True)])

    return match(c(text), language_code(lang))


def _finder(order: list[tuple[str, str]]) -> Callable[[str, bool], list[dict]]:
    """find(text, whole words only) over terms in order of precedence."""
    import ahocorasick

    terms: dict[str, tuple[int, str]] = {}
    for i, (term, label) in enumerate(order):
        terms.setdefault(term, (i, label))
    automaton = ahocorasick.Automaton()
    for term, (i, label) in terms.items():
        automaton.add_word(term, (i, term, label))
    if terms:
        automaton.make_automaton()
    inside = re.compile(r"\w")

    def bounded(low: str, s: int, e: int) -> bool:
        """\\b at both ends."""
        sides = [(low[s - 1 : s], low[s]), (low[e - 1], low[e : e + 1])]
        return all(bool(inside.match(a)) != bool(inside.match(b)) for a, b in sides)

    def find(text: str, words: bool) -> list[dict]:
        low = text.lower()
        places: dict[int, tuple[str, str, list[int]]] = {}
        for end, (i, term, label) in automaton.iter(low) if terms else ():
            start = end + 1 - len(term)
            if not words or bounded(low, start, end + 1):
                places.setdefault(i, (term, label, []))[2].append(start)
        taken, found = bytearray(len(low)), []
        for i in sorted(places):
            term, label, starts = places[i]
            n, free = len(term), 0
            for s in starts:
                if s < free:  # a term's own places don't overlap, whether they count or not
                    continue
                free = s + n
                if not any(taken[s : s + n]):
                    taken[s : s + n] = b"\1" * n
                    found.append({"text": text[s : s + n].strip(), "label": label, "source": "gazetteer"})
        return found

    return find


def capitalised_entities(text: Column | str, lang: Column | str) -> Column:
    """Offline stand-in for a name recogniser: runs of capitalised words of English texts' first 1,000 characters, 2 to 30 long."""
    found = F.regexp_extract_all(F.substring(F.coalesce(c(text), F.lit("")), 1, 1000), F.lit(r"(?<![\p{L}\d])\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)*"), F.lit(0))
    sized = F.filter(found, lambda x: F.char_length(x).between(2, 30))
    made = F.transform(sized, lambda x: F.struct(x.alias("text"), F.lit("NAME").alias("label"), F.lit("ner").alias("source")))
    return F.when(language_code(lang) == "en", made).otherwise(F.array().cast(ENTITY))


def clean_entity(text: Column, lang: Column | str, pronouns: list[str], noise: list[str]) -> Column:
    """An entity without edge punctuation; null where it is too short or long, a pronoun or noise, or reads as a clause."""
    code = language_code(lang)
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, f"^{EDGE}", ""), f"{EDGE}$", ""))
    n = F.char_length(bare)
    low = F.lower(bare)
    bad = ~n.between(2, F.when(code.isin("zh", "ja"), 15).otherwise(40)) | low.isin([x.lower() for x in [*pronouns, *noise]] or [""])
    bad = bad | ((code == "ja") & (bare.rlike(JA_VERB) | bare.rlike(JA_SENTENCE)))
    bad = bad | ((code == "zh") & ((bare.contains("的") & (n > 8)) | (bare.rlike(ZH_VERB) & (n > 6))))
    return F.when(~bad, bare)


def entity_row(entities: Column | str, lang: Column | str, aliases: dict[str, str] | None = None, pronouns: list[str] | None = None, noise: list[str] | None = None) -> Column:
    """Entities of a row cleaned, aliased and deduplicated.

    An entity is skipped if its cleaned form was seen; what is remembered is the alias (so an alias can pass twice by
    different forms). Then the longest stay, and one goes if it contains a kept one or is contained in it.
    """
    alias = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k.lower(), v)]) if aliases else None
    cleaned = F.transform(c(entities), lambda e: F.struct(clean_entity(e["text"], lang, pronouns or [], noise or []).alias("text"), e["label"].alias("label"), e["source"].alias("source")))
    named = lambda t: F.coalesce(alias[F.lower(t)], t) if alias is not None else t
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(ENTITY).alias("kept"))

    def take(state: Column, e: Column) -> Column:
        name = named(e["text"])
        new = F.struct(F.concat(state["seen"], F.array(F.lower(name))).alias("seen"), F.concat(state["kept"], F.array(F.struct(name.alias("text"), e["label"].alias("label"), e["source"].alias("source")))).alias("kept"))
        return F.when(e["text"].isNull() | F.array_contains(state["seen"], F.lower(e["text"])), state).otherwise(new)

    return dedup_entities(F.aggregate(cleaned, start, take, lambda s: s["kept"]))


def dedup_entities(entities: Column | str) -> Column:
    """Keeps an entity if no kept one contains it or lies in it, in any case, from the longest on (stable)."""
    ordered = F.transform(F.array_sort(F.transform(c(entities), lambda e, i: F.struct((-F.char_length(e["text"])).alias("n"), i.alias("i"), e.alias("e")))), lambda x: x["e"])

    def take(kept: Column, e: Column) -> Column:
        low = F.lower(e["text"])
        clash = F.exists(kept, lambda k: F.lower(k["text"]).contains(low) | low.contains(F.lower(k["text"])))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(F.struct(e["text"].alias("text"), e["label"].alias("label"), e["source"].alias("source")))))

    return F.aggregate(ordered, F.array().cast(ENTITY), take)


def merge_entities(own: Column | str, more: Column | str) -> Column:
    """Appends those of `more` whose text is absent (in any case) from `own`."""
    return F.concat(c(own), F.filter(c(more), lambda m: ~F.exists(c(own), lambda e: F.lower(e["text"]) == F.lower(m["text"]))))


def window_expressions(text: Column | str, lang: Column | str, vocabulary: Column | str, actions: dict[str, str], reach: int = 8, before: int = 30, length: int = 150) -> Column:
    """Expressions near a target: for each vocabulary term in the text and each token that contains it or lies in it, the
    action words of the window of `reach` tokens to both sides (each word once per term, where it first stands), with
    the text from `before` characters ahead of the term's first place. What a row needs is computed once and bound."""
    t, code = F.coalesce(c(text), F.lit("")), language_code(lang)
    none = r"(?!)"
    pattern = F.when(code == "zh", F.lit(actions.get("zh", none))).when(code == "ja", F.lit(actions.get("ja", none))).otherwise(F.lit(actions.get("en", none)))
    row = F.struct(t.alias("text"), F.lower(t).alias("low"), F.transform(tokens(t, lang), lambda w: F.lower(w)).alias("words"), pattern.alias("pattern"), c(vocabulary).alias("terms"))

    def of_row(r: Column) -> Column:
        words = r["words"]
        near = lambda w, target: w.contains(target) | target.contains(w)

        def verbs(i: Column) -> Column:
            window = F.array_join(F.slice(words, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach + 1), " ")
            return F.regexp_extract_all(window, r["pattern"], F.lit(0))

        def of_present(present: Column) -> Column:
            places = F.filter(F.transform(words, lambda w, i: F.when(F.exists(present, lambda t: near(w, t)), i)), lambda i: i.isNotNull())
            found = F.transform(places, lambda i: F.struct(F.get(words, i).alias("word"), verbs(i).alias("verbs")))

            def of_target(found: Column, target: Column) -> Column:
                context = F.substr(r["text"], F.greatest(F.instr(r["low"], target) - before, F.lit(1)), F.lit(length))
                own = F.array_distinct(F.flatten(F.transform(F.filter(found, lambda x: near(x["word"], target)), lambda x: x["verbs"])))
                return bind(context, lambda k: F.transform(own, lambda w: F.struct(F.lit("window").alias("layer"), target.alias("target"), w.alias("verb"), w.alias("predicate"), F.lit("unknown").alias("role"), k.alias("context"))))

            return bind(found, lambda f: F.flatten(F.transform(present, lambda t: of_target(f, t))))

        return bind(F.filter(r["terms"], lambda v: r["low"].contains(v)), of_present)

    return bind(row, of_row)


def expressions(docs: DataFrame, vocabulary: DataFrame, rules: Rules, topic: str = "topic", doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document, target and action word; a dependency-parsed row beats a window row, then the first stays.

    vocabulary: topic, terms. It has one row per topic and is broadcast if a count shows that it is small. A column
    `svo` (array of the same structs) may hold a parser's rows.
    """
    from textloom.operators.tables import small

    rows = docs.where(F.col(topic) != -1).join(small(vocabulary.select(topic, "terms")), topic)
    found = window_expressions(text, lang, "terms", rules.actions)
    found = F.concat(F.col("svo"), found) if "svo" in docs.columns else found
    flat = rows.select(doc, topic, F.col(lang), text, F.posexplode(found).alias("ord", "e")).withColumn(lang, language_code(lang)).select(doc, topic, lang, text, "ord", "e.*")
    first = first_by_key(flat, [doc, "target", "verb"], [F.when(F.col("layer") == "svo", 0).otherwise(1), "ord"])
    return first


def frame_signal(text: Column, rules: Rules) -> Column:
    return contains_any(text, [k for words in rules.frames.values() for k in words], True)


def is_neutral(predicate: Column | str, context: Column | str, target: Column | str, rules: Rules) -> Column:
    """Whether a predicate says nothing: empty, a very short word, or noise without a frame's word anywhere near."""
    p = F.lower(normalise(predicate))
    near = F.concat_ws(" | ", F.lower(normalise(context, 220)), F.lower(normalise(target)))
    quiet = set(rules.noise) | set(rules.stop)
    english = F.regexp_extract_all(p, F.lit("[a-z']+"), F.lit(0))
    listed = F.array(*[F.lit(w) for w in sorted(quiet)]).cast("array<string>")
    dull = p.isin(rules.noise or ["\0"]) | ((F.size(english) > 0) & F.forall(english, lambda w: F.array_contains(listed, w)))
    return (
        F.when(p == "", True)
        .when(p.rlike("^[a-z']+$") & (F.char_length(p) <= 2), True)
        .when((F.char_length(p) == 1) & ~p.rlike("[a-z]"), True)
        .when(frame_signal(p, rules) | frame_signal(near, rules), False)
        .otherwise(dull)
    )


def frame_of(predicate: Column | str, context: Column | str, target: Column | str, lang: Column | str, rules: Rules, word_boundary: bool = False) -> Column:
    """noise, or the first frame in declared order with a word in `predicate | target | context | lang`, or other."""
    joined = F.concat_ws(" | ", F.lower(normalise(predicate)), F.lower(normalise(target)), F.lower(normalise(context, 220)), F.lower(normalise(lang)))
    out = F.when(is_neutral(predicate, context, target, rules), NOISE)
    for frame, words in rules.frames.items():
        if words:
            hit = joined.rlike("|".join(rf"\b{re.escape(w)}\b" for w in words)) if word_boundary else contains_any(joined, words, True)
            out = out.when(hit, frame)
    return out.otherwise(OTHER)


def relabel_other(labelled: DataFrame, relabel: DataFrame, key: str = "classification_key") -> DataFrame:
    """Rows of `other` take the label of a (key, frame_type) table where it has one."""
    new = relabel.groupBy(key).agg(F.max("frame_type").alias("_new"))
    return labelled.join(new, key, "left").withColumn("frame_type", F.when(F.col("frame_type") == OTHER, F.coalesce("_new", F.lit(OTHER))).otherwise(F.col("frame_type"))).drop("_new")


def clean_candidates(df: DataFrame, threshold: float = 0.8, fragments: list[str] | None = None, seed: str = "seed_word", word: str = "candidate_word", similarity: str = "similarity", lang: str = "language") -> DataFrame:
    """Candidate words that are like their seed but not a form of it, one row per fingerprint: the most similar first."""
    from textloom.functions.text import fingerprint

    w, s = F.trim(F.col(word)), F.trim(F.col(seed))
    fw, fs, code = fingerprint(w, lang), fingerprint(s, lang), language_code(lang)
    keep = (F.col(similarity) >= threshold) & (fw != fs) & (F.char_length(fw) >= F.when(code == "en", 3).otherwise(2)) & ~fs.contains(fw) & ~fw.contains(fs) & ~w.rlike(r"(?U)^[0-9\W_]+$")
    keep = keep & ((code != "en") | ((F.char_length(w) >= 4) & ~F.lower(w).isin(fragments or ["\0"])))
    kept = df.withColumn(word, w).withColumn(seed, s).where(F.coalesce(keep, F.lit(False))).withColumn("_print", fw)
    return first_by_key(kept, [lang, seed, "_print"], [F.desc(similarity), word]).drop("_print")
