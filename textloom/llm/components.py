"""The block plan for all-pairs work inside a component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.graph import meet
from textloom.session import cut


def deal(members: DataFrame, block: int, weight: str, most: int) -> DataFrame:
    """Adds n_blocks and own_block: the blocks into which a member's component is dealt, and which of them it is in.

    `members` has (node, component) and no payload yet. A component has as many blocks as keep each at about `block`
    members and `most` of the summed column `weight`, so that a task's memory is bounded by both. The sizes come from an
    aggregate that is combined before the shuffle, and a hot component's rows meet them by meet().
    """
    sizes = cut(members.groupBy("component").agg(F.count("*").alias("_n"), F.sum(weight).alias("_w")))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    blocks = F.greatest(F.ceil(F.col("_n") / F.lit(float(block))), F.ceil(F.col("_w") / F.lit(float(most))), F.lit(1)).cast("int")
    met = meet(members, sizes.select("component", "_n", blocks.alias("n_blocks")), "component", "_n", total)
    return met.withColumn("own_block", F.pmod(F.xxhash64("node"), F.col("n_blocks").cast("long")).cast("int"))


def block_pairs(dealt: DataFrame) -> DataFrame:
    """One row for each pair of blocks that compares a member: bi <= bj, and side (0: row of block bi, 1: of block bj)."""
    sent = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rest: list[Column | str] = [c for c in dealt.columns if c != "own_block"]
    return sent.select(*rest, F.least("own_block", "_o").alias("bi"), F.greatest("own_block", "_o").alias("bj"), (F.col("own_block") > F.col("_o")).cast("int").alias("side"))
