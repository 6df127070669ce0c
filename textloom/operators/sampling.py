"""Seeded samples, splits and folds. The order of a sample is a digest of seed and id: the same rows for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.tables import small

BUCKETS = 1 << 16  # stretches of the order, by the first four hexadecimal digits of a draw


def draw(id_col: str, seed: int) -> Column:
    """A row's place in the order of a seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def bucket(draws: Column | str) -> Column:
    return F.conv(F.substring(draws, 1, 4), 16, 10).cast("int")


def sample_k(df: DataFrame, k: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Exactly min(k, rows) rows; a top-k, not a sort of the table."""
    return df.orderBy(draw(id_col, seed), id_col).limit(k)


def sample_per_group(df: DataFrame, group: str, k: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Up to k rows of each group; Spark keeps k per task and group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(draw(id_col, seed), id_col))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def split(df: DataFrame, strata: list[str], share: float = 0.1, seed: int = 42, id_col: str = "doc_id", out: str = "split") -> DataFrame:
    """`val` for round(share * rows) rows of each stratum, the first in the seed's order, else `train`.

    The order is cut into BUCKETS whose counts are summed up; whole buckets go to one side, and only the rows of the
    bucket in which a stratum's share ends are ranked, so no task sorts a stratum. A stratum of one row stays in training.
    """
    rows = df.withColumn("_draw", draw(id_col, seed)).withColumn("_bucket", bucket("_draw"))
    counts = rows.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*strata)
    upto = F.sum("_n").over(by.orderBy("_bucket"))
    plan = counts.withColumn("_upto", upto).withColumn("_want", F.bround(F.sum("_n").over(by) * F.lit(share)).cast("long"))
    ends = plan.where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
    ends = ends.select(*strata, F.col("_bucket").alias("_end"), (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_left"))
    met = rows.alias("r").join(small(ends).alias("p"), [F.col(f"r.{x}").eqNullSafe(F.col(f"p.{x}")) for x in strata], "left")
    met = met.select("r.*", "p._end", "p._left")
    sure = met.where("_end is null or _bucket <> _end").withColumn(out, F.when(F.col("_bucket") < F.col("_end"), "val").otherwise("train"))
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("_draw", id_col))
    edge = met.where("_bucket = _end").withColumn(out, F.when(place <= F.col("_left"), "val").otherwise("train"))
    return sure.union(edge).select(*df.columns, out)


def group_split(df: DataFrame, labels: list[str], group: str = "group_id", share: float = 0.1, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """split() in which rows of one group go together: a group has the smallest mode of each label; rows without a group are split by themselves."""
    grouped = df.where(F.col(group).isNotNull() & (F.col(group).cast("string") != ""))
    single = df.where(F.col(group).isNull() | (F.col(group).cast("string") == ""))
    modes = grouped.groupBy(group).agg(*[F.mode(x, deterministic=True).alias(x) for x in labels])
    parts = split(modes, labels, share, seed, group)
    together = grouped.join(parts.select(group, "split"), group).select(*df.columns, "split")
    return together.unionByName(split(single, labels, share, seed, id_col))


def folds(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = "doc_id", out: str = "fold") -> DataFrame:
    """Shuffled folds of nearly equal size by the hash of the id; no shuffle of the rows."""
    return df.withColumn(out, F.pmod(F.xxhash64(F.lit(seed), F.lit("fold"), F.col(id_col)), F.lit(k)).cast("int"))


def exact_folds(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = "doc_id", out: str = "fold") -> DataFrame:
    """Folds whose sizes differ by one row at most: equal stretches of the seed's order, the first ones a row longer.

    Buckets that lie in one fold go there whole; only those of the k - 1 places where a fold ends are ranked.
    """
    rows = df.withColumn("_draw", draw(id_col, seed)).withColumn("_bucket", bucket("_draw"))
    n = df.count()
    size, longer = divmod(n, k)

    def fold(place: Column) -> Column:
        short = (place - longer * (size + 1)) / F.lit(float(max(size, 1))) + longer
        return F.floor(F.when(place < longer * (size + 1), place / F.lit(float(size + 1))).otherwise(short)).cast("int")

    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))  # at most BUCKETS rows
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_bucket")) - F.col("_n")
    plan = counts.withColumn("_before", before).select("_bucket", "_before", fold(F.col("_before")).alias("_first"), fold(F.col("_before") + F.col("_n") - 1).alias("_last"))
    met = rows.join(F.broadcast(plan), "_bucket")
    sure = met.where("_first = _last").withColumn(out, F.col("_first"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_draw", id_col))
    edge = met.where("_first <> _last").withColumn(out, fold(F.col("_before") + place - 1))
    return sure.union(edge).select(*df.columns, out)


def annotation_sample(evaluated: DataFrame, n: int = 4000, models: int | None = None, keywords: list[str] | None = None, seed: int = 42, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows to annotate with sampling_strategy_tag.

    Uncertain rows (votes conflict, or mean probability in [0.4, 0.6]) and unanimous rows below 0.5, one per text, come
    first; if fewer than n, the rest is taken half from unanimous positives of 0.8 and more, half from unanimous
    negatives (with a keyword, if given), none of which was drawn before.
    """
    from textloom.functions.text import contains_any
    from textloom.operators.tables import first_by_key

    unanimous = ~F.col("conflict")
    all_for = F.col("vote_for") == (F.lit(models) if models else F.col("vote_for") + F.col("vote_against"))
    uncertain = F.col("conflict") | F.col("avg_prob").between(0.4, 0.6)
    pool = first_by_key(evaluated.where(uncertain | (unanimous & (F.col("avg_prob") < 0.5))), [text], [F.when(uncertain, 0).otherwise(1), id_col])
    first = sample_k(pool, n, seed, id_col).withColumn("sampling_strategy_tag", F.lit("uncertain_or_low_confidence"))
    need = n - first.count()
    if need <= 0:
        return first
    rest = evaluated.join(first.select(id_col), id_col, "left_anti")
    high = sample_k(rest.where(all_for & (F.col("avg_prob") >= 0.8)), (need + 1) // 2, seed, id_col).withColumn("sampling_strategy_tag", F.lit("consistent_hate_high_conf"))
    low = rest.where(F.col("vote_for") == 0)
    low = low.where(contains_any(text, keywords, True)) if keywords else low
    return first.unionByName(high).unionByName(sample_k(low, need // 2, seed, id_col).withColumn("sampling_strategy_tag", F.lit("consistent_non_hate")))
