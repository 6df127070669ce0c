"""Joins that no hot key slows, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut

HOT = 256  # rows of a key that are never split
SHARE = 1000  # a key with more than this part of all rows is


def meet(rows: DataFrame, known: DataFrame, key: str, size: str, total: int, by: list[str] | None = None) -> DataFrame:
    """Inner join of `rows` with `known`, which has one row per key and in `size` about how many rows the key has.

    Keys of more than max(HOT, total / SHARE) rows are split: their rows are dealt over as many salts as that limit
    goes into their size (by a hash of the columns `by`, or of all), and their row of `known` is repeated for each salt.
    All sizes sum to `total`, so there are at most SHARE such keys, which is the bound of the one table that is
    broadcast (key and number of salts). Where there is none, the join is a plain one. `known` is read twice, so it should be written already.
    """
    limit = max(HOT, total // SHARE)
    salts = F.ceil(F.col(size) / F.lit(float(limit))).cast("int")
    hot = known.where(F.col(size) > limit).select(key, salts.alias("_salts"))
    if hot.isEmpty():
        return rows.join(known.drop(size), key)
    rest = [F.col(c) for c in by or rows.columns if c != key]
    salted = rows.join(F.broadcast(hot), key, "left")
    salted = salted.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*rest), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    spread = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(size) > limit, salts - 1).otherwise(0)))).drop(size)
    return salted.join(spread, [key, "_salt"]).drop("_salt")


def anew(df: DataFrame) -> DataFrame:
    """Writes a table like cut(), without what the optimizer has derived of it.

    A cut keeps the constraints of its columns and its estimated size. In a loop they feed on themselves: renamed columns
    multiply the constraints, and each join multiplies the sizes, which become numbers of millions of digits and fill the
    driver. The same rows as a new data frame know neither.
    """
    written, session = cut(df)._jdf, df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(written.queryExecution().toRdd(), written.schema(), False), session)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al., 2014): every round re-hangs neighbours below the smallest
    one it knows, so the rounds grow with the logarithm of the longest path. A node of many edges is dealt over tasks
    by meet(). Only two numbers per round reach the driver. Null ends and self loops are ignored; an empty input gives
    an empty output.
    """
    pairs = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"), F.col(u).alias("_u"), F.col(v).alias("_v"))
    current = anew(pairs.where("_u is not null and _v is not null and a <> b").select("a", "b").distinct())
    mark = _mark(current)
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = anew(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = meet(both, low, "a", "n", 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = anew(large.distinct())
        least = anew(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = meet(large, least, "a", "n", 2 * mark[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = anew(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        after = _mark(current)
        if after == mark:
            break
        mark = after
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _mark(pairs: DataFrame) -> tuple:
    """Row count and an order-free checksum of the edge set."""
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
