"""Exact quantiles of groups of any size, by narrowing ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.graph import anew
from textloom.operators.tables import small
from textloom.session import cut

BUCKETS = 1024  # of a range in one pass
LOCAL = 50_000  # values of a range that one task ranks


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], local: int = LOCAL, buckets: int = BUCKETS) -> DataFrame:
    """One row per group: `by` and for each name in `shares` the quantile at that share, between two values by linear interpolation.

    A quantile lies between the values of two ranks. Each pass cuts the range in which a rank lies into equal buckets,
    counts the values of each (combined before the shuffle), and goes on with the bucket of the rank, from its least to
    its largest value. A bucket of one value, however often, is done; one of at most `local` values is ranked. So no
    task holds a group, and a rank is found in a few passes whatever the group's size.

    Values that are null, NaN or infinite don't count; a group without any has null quantiles; null groups are groups; an
    empty table gives no rows.
    """
    v = F.col(value).cast("double")
    rows = cut(df.select(F.struct(*by).alias("g"), F.when(F.abs(v) < float("inf"), v).alias("v")))
    groups = cut(rows.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(float(p))).alias("at")) for name, p in shares.items()]))
    places = cut(groups.select("g", "n", "low", "high", asked.alias("q")).select("g", "n", "low", "high", "q.*"))
    ends = F.explode(F.array(F.floor("at"), F.least(F.floor("at") + 1, F.col("n") - 1)))
    open_ = cut(places.where("n > 0").select("g", ends.alias("rank"), "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("held")).distinct())
    done: list[DataFrame] = []
    ready: list[DataFrame] = []
    while not open_.isEmpty():
        done.append(open_.where("low = high").select("g", "rank", F.col("low").alias("v")))
        ready.append(open_.where((F.col("low") < F.col("high")) & (F.col("held") <= local)))
        wide = open_.where((F.col("low") < F.col("high")) & (F.col("held") > local))
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves: a range may exceed what a double holds
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1))
        met = _within(rows, wide).withColumn("bucket", bucket)
        counts = met.groupBy("g", "rank", "before", "bucket").agg(F.count("*").alias("held"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.col("before") + F.sum("held").over(Window.partitionBy("g", "rank").orderBy("bucket"))
        found = counts.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("held")))
        open_ = anew(found.select("g", "rank", "low", "high", (F.col("upto") - F.col("held")).alias("before"), "held"))
    for part in ready:
        place = F.col("before") + F.row_number().over(Window.partitionBy("g", "rank").orderBy("v")) - 1
        done.append(_within(rows, part).withColumn("_place", place).where("_place = rank").select("g", "rank", "v"))
    if not done:
        return places.groupBy("g").agg(*[F.lit(None).cast("double").alias(name) for name in shares]).select("g.*", *shares)
    known = done[0]
    for part in done[1:]:
        known = known.union(part)
    known = cut(known)
    met = places.withColumns({"rank": F.floor("at"), "next": F.least(F.floor("at") + 1, F.col("n") - 1)})
    met = met.join(known.withColumnRenamed("v", "_low"), ["g", "rank"], "left").join(known.select("g", F.col("rank").alias("next"), F.col("v").alias("_high")), ["g", "next"], "left")
    exact = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("at") - F.floor("at"))
    return met.groupBy("g").agg(*[_one(F.when(F.col("name") == name, exact), name) for name in shares]).select("g.*", *shares)


def _one(value: Column, name: str) -> Column:
    return F.max(value).alias(name)


def _within(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The values of each range of (g, rank, low, high, before, held); ranges are few beside the rows and broadcast if a count shows it."""
    met = rows.join(small(ranges.withColumnRenamed("g", "_g")), F.col("g") == F.col("_g"))
    return met.where(F.col("v").between(F.col("low"), F.col("high"))).drop("_g")
