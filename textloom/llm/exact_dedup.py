"""Exact deduplication by full content, safe under hot groups. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import cut, packed

BLANKS = r"[\x20\x09-\x0D]+"
SALTS = 64


def normalised(text: Column) -> Column:
    """Deletes space, tab, line feed, vertical tab, form feed and carriage return; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


_STEP = "20000000000000000000"  # over the count of 64-bit integers, so that length and id share one number


def _rank(chars: Column, doc_id: Column) -> Column:
    """One fixed-width number that orders rows by most characters, then smallest id; a missing id comes last."""
    low = F.coalesce(F.lit("9223372036854775808").cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (chars.cast("decimal(10,0)") * F.lit(_STEP).cast("decimal(20,0)") + low).cast("decimal(38,0)")


def _best_id(best: Column) -> Column:
    """The id in a number made by _rank()."""
    low = best % F.lit(_STEP).cast("decimal(20,0)")
    return F.when(low > 0, F.lit("9223372036854775808").cast("decimal(20,0)") - low).cast("long")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their normalised texts are identical. Three combining stages, each grouping by the digest AND
    the whole normalised text, so equal digests of different texts never merge: within a task (the partial
    aggregate), per salt (pmod of the id's hash), and over the salts' winners. A hot group reaches the last stage
    with one row per salt and task. Rows then look their winner up by the digest (32 bytes a row; the side of the winners
    has each digest once, so that adaptive execution splits a hot digest over tasks); a digest that stands for several
    texts is looked up by the text as well.

    Cases: null text = empty text; texts of blanks only form the group of the empty text; ties on length go to the
    smallest id; repeated rows (same id) are separate members, all kept if their id wins; a null id comes last on ties,
    a group whose winner has no id has keep_id null and keeps its rows without id; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    digest = digest or (lambda norm: F.sha2(norm, 256))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("doc_id", normalised(F.col("_text")).alias("norm"), F.char_length("_text").alias("chars"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).withColumn("digest", digest(F.col("norm")))

    salted = rows.groupBy("salt", "digest", "norm").agg(F.max(_rank(F.col("chars"), F.col("doc_id"))).alias("best"), F.count("*").alias("n"))
    whole = salted.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    keep = _best_id(F.col("best"))
    winners = whole.select("digest", keep.alias("keep_id"), "group_size")
    counted = cut(winners.groupBy("digest").agg(F.count("*").alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")))
    mixed = counted.where("texts > 1").select("digest")
    slim = rows.select("doc_id", "digest")
    found = slim.join(counted.where("texts = 1"), "digest").select("doc_id", "digest", "keep_id", "group_size")
    if not mixed.isEmpty():
        full = whole.join(mixed, "digest", "left_semi").select("digest", "norm", keep.alias("keep_id"), "group_size")
        texts = rows.join(mixed, "digest", "left_semi").join(full, ["digest", "norm"])
        found = found.union(texts.select("doc_id", "digest", "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that exact_dedup() keeps, with all their columns: one row for each group of equal texts.

    Cases: null, empty and blank texts are one group, of which one row stays; ties on length go to the smallest id, a
    null id comes last; of repeated rows (same id, equal text) any one stays; an empty table gives no rows; columns may
    have any name.
    """
    winners = exact_dedup(docs, id_col, text_col, salts).where("kept")
    known, unnamed = F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull()
    winners = winners.select(known.alias("id"), unnamed.alias("none"), F.col("text_sha256").alias("sha")).distinct()
    own = F.col(id_col).cast("long")
    keyed = docs.select(packed(docs).alias("row"), F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("none"), F.sha2(normalised(F.col(text_col)), 256).alias("sha"))
    # repeated rows meet in the same place, so that dropping them needs no shuffle of its own
    return keyed.join(winners, ["id", "none", "sha"], "left_semi").dropDuplicates(["id", "none", "sha"]).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
