"""Vector similarity, axes and clusters, and string similarity joins."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, MinHashLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from textloom.functions.vectors import cosine, dot, mean_vector, minus, norm, squared_distance, sum_vector, unit
from textloom.operators.aggregates import r6
from textloom.operators.neighbours import BLOCK, nearest, vectors_of
from textloom.operators.overlap import near_copies
from textloom.operators.quantiles import exact_quantiles
from textloom.operators.tables import small


def dim_of(df: DataFrame, vector: str) -> int:
    row = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    return row[0] if row else 0


def top_k_cosine(seeds: DataFrame, pool: DataFrame, k: int, seed_id: str, pool_id: str, vector: str = "embedding", seed_vector: str | None = None, block: int = BLOCK) -> DataFrame:
    """(seed, pool, cosine, place): the k most similar pool rows of each seed, ties by pool id; see nearest().

    Seeds of one id are one seed. Rows without an id, or whose vector is null, has holes or another length than the
    seeds', take no part; the cosine with a zero vector is 0.
    """
    sv = seed_vector or vector
    dim = dim_of(seeds, sv)
    queries = vectors_of(seeds, seed_id, sv, dim).dropDuplicates(["id"])
    found = nearest(queries, vectors_of(pool, pool_id, vector, dim), k, block=block)
    return found.select("seed", "pool", (-F.col("far")).alias("cosine"), "place")


def max_cosine(new: DataFrame, pool: DataFrame, new_id: str, pool_id: str, vector: str = "embedding") -> DataFrame:
    """(new_id, max_cosine): similarity of each new row to its nearest pool row."""
    return top_k_cosine(new, pool, 1, new_id, pool_id, vector).select(F.col("seed").alias(new_id), F.col("cosine").alias("max_cosine"))


def redundancy(new: DataFrame, pool: DataFrame, new_id: str, pool_id: str, threshold: float = 0.9, vector: str = "embedding") -> DataFrame:
    """Share of new rows whose nearest pool row lies above the threshold; 0 for an empty pool."""
    total = new.count()
    near = max_cosine(new, pool, new_id, pool_id, vector).agg(F.count_if(F.col("max_cosine") > threshold).alias("redundant"))
    return near.select("redundant", r6(F.col("redundant") / F.lit(float(max(total, 1)))).alias("share"))


def mean_similarity(df: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """Mean off-diagonal cosine from the sum of the unit vectors: one aggregate, no pairs."""
    dim = dim_of(df, vector)
    sums = df.where(norm(vector) > 0).withColumn("_u", unit(vector)).groupBy(*(by or [])).agg(sum_vector("_u", dim).alias("_s"), F.count("*").alias("n"))
    n = F.col("n")
    return sums.select(*(by or []), "n", r6(F.try_divide(dot("_s", "_s") - n, (n * (n - 1)).cast("double"))).alias("mean_cosine"))


def group_alignment(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean cosine over the pairs of each group, then over groups; single rows have no pairs."""
    return mean_similarity(df, vector, [group]).where("n > 1").agg(F.count("*").alias("groups"), r6(F.avg("mean_cosine")).alias("alignment"))


def precision_at_k(df: DataFrame, k: int, id_col: str, label: str, vector: str = "embedding") -> DataFrame:
    """Mean share of equal labels among each row's k nearest others (itself left out by id)."""
    near = top_k_cosine(df, df, k + 1, id_col, id_col, vector).where("seed <> pool")
    place = F.row_number().over(Window.partitionBy("seed").orderBy("place"))
    near = near.withColumn("place", place).where(F.col("place") <= k)
    labels = df.select(F.col(id_col).alias("_i"), F.col(label).alias("_l"))
    met = near.join(labels.select(F.col("_i").alias("seed"), F.col("_l").alias("own")), "seed").join(labels.select(F.col("_i").alias("pool"), F.col("_l").alias("other")), "pool")
    hits = met.groupBy("seed").agg(F.avg((F.col("own") == F.col("other")).cast("double")).alias("p"))
    return hits.agg(r6(F.avg("p")).alias("precision"))


def cluster_scores(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz of a clustering, from centroids and distances to them."""
    dim = dim_of(df, vector)
    centroids = df.groupBy(label).agg(mean_vector(vector, dim).alias("c"), F.count("*").alias("n"))
    spread = df.join(F.broadcast(centroids) if centroids.limit(10_001).count() <= 10_000 else centroids, label)
    d2 = squared_distance(vector, "c")
    stats = spread.groupBy(label).agg(F.first("c").alias("c"), F.first("n").alias("n"), F.avg(F.sqrt(d2)).alias("s"), F.sum(d2).alias("w")).collect()
    g = df.agg(mean_vector(vector, dim).alias("m")).first()["m"]
    k, n = len(stats), sum(r["n"] for r in stats)
    c = np.array([r["c"] for r in stats])
    s = np.array([r["s"] for r in stats])
    between = sum(r["n"] * float(((np.array(r["c"]) - np.array(g)) ** 2).sum()) for r in stats)
    within = sum(r["w"] for r in stats)
    dist = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
    np.fill_diagonal(dist, np.inf)
    db = float(((s[:, None] + s[None]) / dist).max(axis=1).mean()) if k > 1 else 0.0
    ch = between / (k - 1) / (within / (n - k)) if k > 1 and within > 0 and n > k else 0.0
    return df.sparkSession.createDataFrame([(k, n, db, float(ch))], "clusters long, rows long, davies_bouldin double, calinski_harabasz double")


def silhouette(df: DataFrame, label: str, vector: str, metric: str = "cosine") -> float:
    """Mean silhouette by Spark ML's evaluator (cosine or squared Euclidean distance to cluster means)."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    ready = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.dense_rank().over(Window.orderBy(label)).cast("double").alias("prediction")) if df.schema[label].dataType.typeName() == "string" else df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure="cosine" if metric == "cosine" else "squaredEuclidean").evaluate(ready)


def centre_by(df: DataFrame, by: str, vector: str, out: str = "centred") -> DataFrame:
    """Subtracts each group's mean vector and scales to length 1."""
    means = df.groupBy(by).agg(mean_vector(vector, dim_of(df, vector)).alias("_m"))
    met = df.join(F.broadcast(means) if means.limit(10_001).count() <= 10_000 else means, by)
    return met.withColumn(out, unit(minus(vector, "_m"), 1e-12)).drop("_m")


def representatives(df: DataFrame, group: str, id_col: str, vector: str, k: int = 3) -> DataFrame:
    """The k rows nearest (by cosine) to each group's centroid, ties by id."""
    centroids = df.groupBy(group).agg(mean_vector(vector, dim_of(df, vector)).alias("_c"))
    met = df.join(F.broadcast(centroids) if centroids.limit(10_001).count() <= 10_000 else centroids, group).withColumn("cosine", r6(cosine(vector, "_c")))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("cosine"), id_col))
    return met.select(group, id_col, "cosine", place.alias("place")).where(F.col("place") <= k)


def axis_vectors(words: DataFrame, axis: str = "axis", polarity: str = "polarity", vector: str = "embedding") -> DataFrame:
    """(axis, vec): mean of the unit vectors of `pos` words less that of `neg` words; not scaled."""
    dim = dim_of(words, vector)
    rows = words.withColumn("_u", unit(vector, 1e-12))
    side = lambda p: rows.where(F.col(polarity) == p).groupBy(axis).agg(mean_vector("_u", dim).alias(p))
    return side("pos").join(side("neg"), axis).select(axis, minus("pos", "neg").alias("vec"))


def project(docs: DataFrame, axes: DataFrame, vector: str = "embedding", axis: str = "axis", prefix: str = "bias_") -> DataFrame:
    """Adds one column per axis: the product of the unit document and the unit axis. Axes are few; they become literals."""
    out = docs.withColumn("_u", unit(vector, 1e-12))
    for r in axes.orderBy(axis).collect():
        v = np.array(r["vec"], dtype=float)
        v = v / (np.linalg.norm(v) + 1e-12)
        out = out.withColumn(f"{prefix}{r[axis]}", r6(dot("_u", F.array(*[F.lit(float(x)) for x in v]))))
    return out.drop("_u")


def kmeans(df: DataFrame, k: int, vector: str, seed: int = 42, out: str = "cluster") -> DataFrame:
    """Seeded k-means by Spark ML; adds the cluster and the distance to its centre."""
    rows = df.withColumn("_f", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol=out).fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in model.clusterCenters()])
    return model.transform(rows).withColumn("distance", F.sqrt(squared_distance(vector, F.get(centres, F.col(out))))).drop("_f")


def drop_outliers(clustered: DataFrame, percentile: float = 0.95, cluster: str = "cluster") -> DataFrame:
    """Rows within the percentile of their cluster's distances."""
    limits = exact_quantiles(clustered, [cluster], "distance", {"_limit": percentile})
    return clustered.join(small(limits), cluster).where("distance <= _limit").drop("_limit")


def closest_to_centre(clustered: DataFrame, n: int, id_col: str, cluster: str = "cluster") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(cluster).orderBy("distance", id_col))
    return clustered.withColumn("place", place).where(F.col("place") <= n)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of matching characters, which no built-in gives."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_above(threshold: float):
    """A column function: whether difflib's ratio exceeds the threshold; its upper bounds are tried first."""

    @F.pandas_udf("boolean")
    def above(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            m = difflib.SequenceMatcher(None, x or "", y or "")
            out.append(m.quick_ratio() > threshold and m.ratio() > threshold)
        return pd.Series(out, dtype="bool")

    return above


def leaks(val: DataFrame, train: DataFrame, val_id: str, train_id: str, text: str = "text", threshold: float = 0.85, blocking: bool = True, exact: bool = True, near: bool = True) -> DataFrame:
    """(val_id, kind): validation rows that are in the training rows exactly (`exact`) or nearly (`fuzzy`, if `near`).

    Candidates share a MinHash bucket of character 4-grams (`blocking`, which loses pairs whose edits are spread), or
    are all pairs that the bounds of near_copies() leave, which loses none. The ratio itself is difflib's.
    """
    v, t = val.select(F.col(val_id).alias("_v"), F.col(text).alias("a")), train.select(F.col(train_id).alias("_t"), F.col(text).alias("b"))
    same = v.join(t.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("_v")
    found = same.select(F.col("_v").alias(val_id), F.lit("exact").alias("kind"))
    if not near:
        return found
    rest = v.join(same, "_v", "left_anti")
    if blocking:
        pairs = minhash_pairs(rest.select(F.col("_v").alias("id"), F.col("a").alias("x")), t.select(F.col("_t").alias("id"), F.col("b").alias("x")))
        pairs = pairs.select(F.col("left").alias("_v"), F.col("lx").alias("a"), F.col("rx").alias("b"))
        like = pairs.where(2 * F.least(F.char_length("a"), F.char_length("b")) > threshold * (F.char_length("a") + F.char_length("b")))
        like = like.where(ratio_above(threshold)("a", "b")).select("_v").distinct()
    else:
        like = near_copies(rest, t, "_v", "_t", threshold=threshold, others=False, text="a", train_text="b", once=True).select(F.col("held").alias("_v")).distinct()
    like = like.select(F.col("_v").alias(val_id), F.lit("fuzzy").alias("kind"))
    return found.union(like) if exact else like


def minhash_pairs(left: DataFrame, right: DataFrame, tables: int = 20, distance: float = 0.6) -> DataFrame:
    """Pairs of (id, x) rows whose character 4-grams meet in a MinHash table."""
    size = F.greatest(F.char_length("x") - 3, F.lit(1))
    grams = lambda df: df.withColumn("g", F.array_distinct(F.transform(F.sequence(F.lit(1), size), lambda i: F.substr("x", i, F.lit(4)))))
    tf = HashingTF(inputCol="g", outputCol="f", numFeatures=1 << 18, binary=True)
    lsh = MinHashLSH(inputCol="f", outputCol="h", numHashTables=tables, seed=7)
    a, b = tf.transform(grams(left.where(F.char_length("x") > 0))), tf.transform(grams(right.where(F.char_length("x") > 0)))
    model = lsh.fit(b)
    found = model.approxSimilarityJoin(a, b, distance, "d")
    return found.select(F.col("datasetA.id").alias("left"), F.col("datasetA.x").alias("lx"), F.col("datasetB.id").alias("right"), F.col("datasetB.x").alias("rx"), "d")


def leak_verdict(val: DataFrame, found: DataFrame, limit: float = 0.05) -> DataFrame:
    """rows, exact and fuzzy shares, and whether their sum exceeds the limit."""
    n = val.count()
    share = lambda kind: r6(F.count_if(F.col("kind") == kind) / F.lit(float(max(n, 1))))
    return found.agg(share("exact").alias("exact_rate"), share("fuzzy").alias("fuzzy_rate")).select(F.lit(n).alias("rows"), "exact_rate", "fuzzy_rate", (F.col("exact_rate") + F.col("fuzzy_rate") > limit).alias("leaking"))


def bisecting_topics(df: DataFrame, k: int, vector: str, components: int = 8, least: int = 10, seed: int = 42, out: str = "topic") -> DataFrame:
    """Topics from vectors: PCA, then bisecting k-means; clusters under `least` rows become noise (-1).

    Stands in for density clustering, which has no distributed form here; where a topic column exists, use that.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import PCA

    rows = df.withColumn("_f", array_to_vector(F.col(vector).cast("array<double>")))
    dim = dim_of(df, vector)
    if components < dim:
        rows = PCA(k=components, inputCol="_f", outputCol="_p").fit(rows).transform(rows)
    else:
        rows = rows.withColumn("_p", F.col("_f"))
    placed = BisectingKMeans(k=k, seed=seed, featuresCol="_p", predictionCol=out).fit(rows).transform(rows).drop("_f", "_p")
    sizes = placed.groupBy(out).agg(F.count("*").alias("_n"))
    return placed.join(small(sizes), out).withColumn(out, F.when(F.col("_n") < least, -1).otherwise(F.col(out))).select(*df.columns, out)


def word_topics(docs: DataFrame, k: int, tokens: str = "tokens", min_df: int = 2, size: int = 20_000, seed: int = 42, out: str = "topic") -> tuple[DataFrame, DataFrame]:
    """(documents with their strongest LDA topic, topic words): topics from words alone."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    counter = CountVectorizer(inputCol=tokens, outputCol="_c", minDF=min_df, vocabSize=size).fit(docs)
    rows = counter.transform(docs)
    model = LDA(k=k, seed=seed, featuresCol="_c", topicDistributionCol="_d", maxIter=10).fit(rows)
    placed = model.transform(rows).withColumn("_a", vector_to_array("_d")).withColumn(out, (F.array_position("_a", F.array_max("_a")) - 1).cast("int"))
    vocabulary = F.array(*[F.lit(w) for w in counter.vocabulary])
    words = model.describeTopics(10).select(F.col("topic").alias(out), F.transform("termIndices", lambda i: F.get(vocabulary, i)).alias("words"))
    return placed.select(*docs.columns, out), words
