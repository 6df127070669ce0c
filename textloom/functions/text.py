"""Column builders for cleaning, formatting, parsing and matching text. All run inside Spark's own expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, fixed values: Han, kana, full-width digits, and the long-vowel mark.
HAN = r"\x{4e00}-\x{9fff}"
KANA = r"\x{3040}-\x{30ff}"
WIDE_DIGITS = r"\x{ff10}-\x{ff19}"
BLANK = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]"
# Verbal endings that a fingerprint drops, and the words of yes and no labels. Fixed values.
JA_ENDING = "(る|た|ない|ます|じ|て|の)$"
YES = ("是", "yes", "y", "true", "1", "1.0")
NO = ("否", "no", "n", "false", "0", "0.0")
EDGE = r"[\s.,;:!?、。，；：！？「」『』（）()\[\]【】…]+"


def c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, although the body uses it in lambdas many times."""
    return F.transform(F.array(value), body)[0]


def squeeze(text: Column | str) -> Column:
    """Runs of white space (Unicode) become a space; ends are trimmed."""
    return F.trim(F.regexp_replace(c(text), f"{BLANK}+", " "))


def normalise(text: Column | str, length: int | None = None) -> Column:
    """squeeze() with null as empty, cut to a number of characters."""
    out = squeeze(F.coalesce(c(text), F.lit("")))
    return F.substring(out, 1, length) if length else out


def unlinked(text: Column | str) -> Column:
    """Links become a space; only texts that have one are searched. Null is empty."""
    out = F.coalesce(c(text), F.lit(""))
    return F.when(F.contains(out, F.lit("://")), F.regexp_replace(out, r"https?://\S+", " ")).otherwise(out)


def clean_zh(text: Column | str) -> Column:
    """Chinese: links go, Han, letters and digits of ASCII stay; null is empty."""
    return F.trim(F.regexp_replace(unlinked(text), rf"[^a-zA-Z0-9{HAN}]+", " "))  # a run at a time, blanks with the rest


def clean_ja(text: Column | str) -> Column:
    """Japanese: links go, kana, Han, full-width digits, letters and digits of ASCII stay; null is empty."""
    return F.trim(F.regexp_replace(unlinked(text), rf"[^a-zA-Z0-9{KANA}{HAN}{WIDE_DIGITS}ー]+", " "))


def clean_en(text: Column | str) -> Column:
    """English: zero-width spaces, links and mail addresses go; lower case; letters, digits, ' and - stay; null is empty."""
    out = F.replace(F.coalesce(c(text), F.lit("")), F.lit("\u200b"), F.lit(" "))
    out = F.regexp_replace(out, r"https?://\S+|www\.\S+", " ")
    out = F.regexp_replace(out, r"\S+@\S+", " ")
    return squeeze(F.regexp_replace(F.lower(out), r"[^A-Za-z0-9'\- ]+", " "))


def clean(text: Column | str, lang: Column | str) -> Column:
    """The cleaner of each row's language; English for any other."""
    code = language_code(lang)
    return F.when(code == "zh", clean_zh(text)).when(code == "ja", clean_ja(text)).otherwise(clean_en(text))


def strip_list_marker(text: Column | str) -> Column:
    """Numbers, dots, dashes, stars and blanks before the text of a list item."""
    return F.regexp_replace(c(text), r"^[\d.\-*\s]+", "")


def language_code(lang: Column | str) -> Column:
    """Lower-cased code; jp is ja."""
    low = F.lower(F.trim(c(lang)))
    return F.when(low.isin("ja", "jp"), "ja").otherwise(low)


def guess_language(text: Column | str) -> Column:
    """ja with more than three kana, else zh with over 30 % Han, else en."""
    t = F.coalesce(c(text), F.lit(""))
    share = F.regexp_count(t, F.lit(f"[{HAN}]")) / F.greatest(F.char_length(t), F.lit(1))
    return F.when(F.regexp_count(t, F.lit(f"[{KANA}]")) > 3, "ja").when(share > 0.3, "zh").otherwise("en")


def label_strict(value: Column | str) -> Column:
    """1, 0 or null for labels such as yes/no, true/false, 1/0 and their Chinese forms."""
    low = F.lower(F.trim(c(value).cast("string")))
    return F.when(low.isin(*YES), 1).when(low.isin(*NO), 0)


def label_lenient(value: Column | str) -> Column:
    """label_strict(), then a number cut to an integer, then 0."""
    number = c(value).cast("string").try_cast("double").try_cast("int")
    return F.coalesce(label_strict(value), number, F.lit(0))


def fingerprint(word: Column | str, lang: Column | str) -> Column:
    """Lower case without blanks, signs and underscores; Japanese words of over two characters lose a verbal ending."""
    out = F.regexp_replace(F.lower(F.coalesce(c(word), F.lit(""))), r"(?U)[\s\W_]+", "")
    bare = F.regexp_replace(out, JA_ENDING, "")
    return F.when((language_code(lang) == "ja") & (F.char_length(out) > 2), bare).otherwise(out)


def record_id(*parts: Column | str) -> Column:
    """SHA-1 of the parts joined by ||; a null part is empty."""
    return F.sha1(F.concat_ws("||", *[F.coalesce(c(p).cast("string"), F.lit("")) for p in parts]))


def classification_key(predicate: Column | str, context: Column | str, lang: Column | str, target: Column | str) -> Column:
    """JSON of the normalised parts in the order of their names: context 220, lang, predicate 120, target 80 characters."""
    return F.to_json(
        F.struct(normalise(context, 220).alias("context"), F.lower(normalise(lang)).alias("lang"), normalise(predicate, 120).alias("predicate"), F.lower(normalise(target, 80)).alias("target"))
    )


def preview(text: Column | str, length: int) -> Column:
    return F.substring(c(text), 1, length)


def short_label(text: Column | str, length: int = 28) -> Column:
    """The text, or its head with an ellipsis where it is longer."""
    t = c(text)
    return F.when(F.char_length(t) <= length, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, length - 1)), F.lit("…")))


def entity_list(value: Column | str) -> Column:
    """Entities of a printed list ('a', \"b\") or of a comma list; blanks and empty ones go."""
    text = F.trim(F.coalesce(c(value), F.lit("")))
    quoted = F.regexp_extract_all(text, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    inner = F.transform(quoted, lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.char_length(q) - 2), r"\\(.)", "$1"))
    listed = F.when(F.size(quoted) > 0, inner).otherwise(F.split(F.regexp_replace(text, r"^\[|\]$", ""), ","))
    values = F.when(text.startswith("["), listed).otherwise(F.split(text, ","))
    return F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")


def named_count(value: Column | str) -> Column:
    """struct(name, count) of `name(count)`; null for anything else."""
    name, count = F.regexp_extract(c(value), r"^(.*)\((\d+)\)$", 1), F.regexp_extract(c(value), r"^(.*)\((\d+)\)$", 2)
    return F.when(count != "", F.struct(F.trim(name).alias("name"), F.try_to_number(count, F.lit("999999999999999999")).cast("long").alias("count")))


def count_label(name: Column | str, count: Column | str) -> Column:
    return F.format_string("%s(%d)", c(name), c(count))


def hit_words(text: Column | str, keywords: list[str], case_sensitive: bool = False) -> Column:
    """Array of the keywords that a text contains, in the order of the list."""
    t = F.coalesce(c(text), F.lit(""))
    t = t if case_sensitive else F.lower(t)
    words = F.array(*[F.lit(k) for k in keywords]).cast("array<string>")
    return F.filter(words, lambda k: t.contains(k if case_sensitive else F.lower(k)))


def contains_any(text: Column | str, keywords: list[str], case_sensitive: bool = False) -> Column:
    """Whether a text contains a keyword, as one compiled alternation; false for null."""
    if not keywords:
        return F.lit(False)
    pattern = "|".join(re.escape(k) if re.escape(k) == k else r"\Q" + k.replace(r"\E", r"\E\\E\Q") + r"\E" for k in sorted(set(keywords), key=lambda k: (-len(k), k)))
    return F.coalesce(c(text), F.lit("")).rlike(pattern if case_sensitive else f"(?iu){pattern}")


def length_between(text: Column | str, least: int = 0, most: int = 300) -> Column:
    return F.char_length(c(text)).between(least, most)


def tokens(text: Column | str, lang: Column | str) -> Column:
    """Offline tokens: lower-cased word runs for en and others, runs of Han or kana and of letters for zh and ja."""
    code, t = language_code(lang), F.coalesce(c(text), F.lit(""))
    zh = F.regexp_extract_all(t, F.lit(rf"[{HAN}]+|[a-zA-Z]+"), F.lit(0))
    ja = F.regexp_extract_all(t, F.lit(rf"[{KANA}{HAN}]+|[a-zA-Z]+"), F.lit(0))
    return F.when(code == "zh", zh).when(code == "ja", ja).otherwise(F.regexp_extract_all(F.lower(t), F.lit("[a-zA-Z']+"), F.lit(0)))


def dictionary_tokens(text: Column | str, words: list[str], lang: str | None = None) -> Column:
    """Tokens by a word list, for scripts without blanks: from the left the longest word of the list that fits, else one letter or digit of its own.

    For zh and ja, letters of ASCII stay together; other signs go. Null is no token.
    """
    listed = [re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)) if w]
    alone = {"zh": rf"[{HAN}]|[a-zA-Z]+", "ja": rf"[{KANA}{HAN}]|[a-zA-Z]+"}.get(lang or "", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
    return F.regexp_extract_all(F.coalesce(c(text), F.lit("")), F.lit("|".join([*listed, alone])), F.lit(0))


def without(words: Column | str, stop: list[str], digits: bool = True) -> Column:
    """Drops stop words and (by default) numbers, and keeps repeats."""
    banned = F.array(*[F.lit(s) for s in stop]).cast("array<string>")
    return F.filter(c(words), lambda w: ~F.array_contains(banned, w) & (~w.rlike("^[0-9]+$") if digits else F.lit(True)))


def title_case(text: Column | str) -> Column:
    return F.initcap(c(text))


def p_value(p: float) -> str:
    """A p-value as reports show it; values below the smallest double as a bound."""
    if p is None or p != p:
        return "nan"
    return "<4.941e-324" if p == 0 else f"{p:.3e}"


def stars(p: Column | str) -> Column:
    return F.when(c(p) < 0.001, "***").when(c(p) < 0.01, "**").when(c(p) < 0.05, "*").otherwise("ns")
