"""Votes of several classifiers per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.aggregates import r6
from textloom.operators.statistics import binary_entropy


def evaluate(df: DataFrame, votes: str = "votes") -> DataFrame:
    """Adds model_votes, avg_prob, avg_p_pos, entropy, conflict, vote_for, vote_against from array<struct(model,label,prob)>.

    avg_prob is the mean of the models' own confidence; avg_p_pos turns it into the probability of label 1 first.
    """
    n = F.size(votes)
    total = lambda f: F.aggregate(F.transform(votes, f), F.lit(0.0), lambda s, x: s + x)
    mean = F.coalesce(F.try_divide(total(lambda v: v["prob"].cast("double")), n), F.lit(0.0))
    positive = F.coalesce(F.try_divide(total(lambda v: F.when(v["label"] == 1, v["prob"].cast("double")).otherwise(1 - v["prob"].cast("double"))), n), F.lit(0.0))
    up = F.size(F.filter(votes, lambda v: v["label"] == 1))
    out = df.withColumn("vote_for", up).withColumn("vote_against", n - up).withColumn("avg_prob", mean).withColumn("avg_p_pos", r6(positive))
    out = out.withColumn("model_votes", F.concat_ws("/", F.col("vote_for").cast("string"), F.col("vote_against").cast("string")))
    return out.withColumn("entropy", r6(binary_entropy("avg_prob"))).withColumn("avg_prob", r6(F.col("avg_prob"))).withColumn("conflict", (F.col("vote_for") > 0) & (F.col("vote_against") > 0))
