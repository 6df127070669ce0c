"""Group comparisons, correlations, principal components and classifier metrics. Moments come from Spark, tails from the driver."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.distributions import f_tail, t_tail
from textloom.functions.text import c, p_value
from textloom.operators.aggregates import r6


def z_scores(df: DataFrame, columns: list[str], by: str, suffix: str = "_z") -> DataFrame:
    """Population z-scores within groups, 0 where the deviation is below 1e-12; the moments are joined, not windowed."""
    moments = df.groupBy(by).agg(*[f(x).alias(f"_{n}_{x}") for x in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    met = df.join(F.broadcast(moments) if moments.limit(10_001).count() <= 10_000 else moments, by)
    return met.select(*df.columns, *[r6(F.when(F.col(f"_s_{x}") < 1e-12, 0.0).otherwise((F.col(x) - F.col(f"_m_{x}")) / F.col(f"_s_{x}"))).alias(f"{x}{suffix}") for x in columns])


def group_moments(df: DataFrame, axes: list[str], by: str) -> DataFrame:
    """One row per axis and group: n, mean, population and sample variance. One pass with partial aggregates."""
    return df.select(by, *axes).unpivot([by], axes, "axis", "value").groupBy("axis", by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var_pop"), F.var_samp("value").alias("var_samp"))


def anova(df: DataFrame, axes: list[str], by: str, least: int = 10) -> DataFrame:
    """Per axis: F, p (text), eta squared, stars, and the Welch p of each pair of groups; axes with a group under `least` rows are left out."""
    moments: dict[str, dict] = {}
    for r in group_moments(df, axes, by).collect():
        moments.setdefault(r["axis"], {})[r[by]] = r
    rows = []
    for axis in axes:
        groups = {k: v for k, v in sorted(moments.get(axis, {}).items(), key=lambda kv: str(kv[0])) if k is not None}
        if len(groups) < 2 or any(g["n"] < least for g in groups.values()):
            continue
        n = sum(g["n"] for g in groups.values())
        mean = sum(g["n"] * g["mean"] for g in groups.values()) / n
        between = sum(g["n"] * (g["mean"] - mean) ** 2 for g in groups.values())
        within = sum(g["n"] * g["var_pop"] for g in groups.values())
        d1, d2 = len(groups) - 1, n - len(groups)
        f = (between / d1) / (within / d2) if within > 0 else float("inf")
        p = f_tail(f, d1, d2)
        eta = between / (between + within) if between + within > 0 else 0.0
        welch = {f"{a}-{b}": p_value(welch_p(groups[a], groups[b])) for a, b in combinations(groups, 2)}
        star = "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "ns"
        rows.append((axis, float(f), p_value(p), float(eta), star, {str(k): float(g["mean"]) for k, g in groups.items()}, {str(k): math.sqrt(g["var_pop"]) for k, g in groups.items()}, {str(k): g["n"] for k, g in groups.items()}, welch))
    return df.sparkSession.createDataFrame(rows, "axis string, f_stat double, p_value string, eta_squared double, significant string, mean map<string,double>, std map<string,double>, n map<string,bigint>, welch map<string,string>")


def welch_p(a, b) -> float:
    """Two-sided p of Welch's t-test from n, mean and sample variance."""
    va, vb = (a["var_samp"] or 0.0) / a["n"], (b["var_samp"] or 0.0) / b["n"]
    if va + vb == 0:
        return 1.0 if a["mean"] == b["mean"] else 0.0
    t = (a["mean"] - b["mean"]) / math.sqrt(va + vb)
    df = (va + vb) ** 2 / ((va**2 / (a["n"] - 1) if va else 0) + (vb**2 / (b["n"] - 1) if vb else 0))
    return t_tail(t, df)


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) of every pair of columns, null correlations as 0; all in one aggregate."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[F.coalesce(F.corr(a, b), F.lit(0.0)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r6(F.col(f"`{i}`")).alias("r")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def mean_off_diagonal(matrix: DataFrame) -> DataFrame:
    return matrix.where("x <> y").agg(r6(F.avg("r")).alias("mean_r"))


def principal_components(df: DataFrame, columns: list[str], k: int = 2) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(df with pc1..pck, loadings, explained shares).

    The covariance of the columns is one aggregate; its eigenvectors are found on the driver (as many numbers as
    columns squared) and rows are projected by expressions. Columns are centred; each component's largest loading is
    positive, which fixes its sign.
    """
    d = len(columns)
    parts = [F.avg(x).alias(f"m{i}") for i, x in enumerate(columns)] + [F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    row = df.agg(*parts).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(d)])
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1, 1)
    explained = values / values.sum() if values.sum() > 0 else np.zeros(d)
    out = df
    for j in range(k):
        out = out.withColumn(f"pc{j + 1}", sum(((F.col(x) - float(mean[i])) * float(vectors[i, j]) for i, x in enumerate(columns)), F.lit(0.0)))
    return out, vectors[:, :k], explained[:k]


def binary_entropy(p: Column | str) -> Column:
    x = c(p)
    return F.when((x <= 0) | (x >= 1), 0.0).otherwise(-x * F.log2(x) - (1 - x) * F.log2(1 - x))


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1 of 0/1 columns; a division by zero counts 0."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    sums = df.groupBy(*(by or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    part = lambda a, b: r6(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return sums.select(*(by or []), "tp", "fp", "fn", "tn", part(tp + tn, tp + fp + fn + tn).alias("accuracy"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))


def threshold_sweep(df: DataFrame, truth: str, prob: str, steps: int = 95, low: float = 0.01, high: float = 0.95) -> DataFrame:
    """threshold, f1 for each of `steps` thresholds: the rows are counted once by the highest threshold that they reach."""
    width = (high - low) / (steps - 1)
    at = F.array(*[F.lit(low + i * width) for i in range(steps)])
    reached = F.size(F.filter(at, lambda t: F.col(prob) >= t))
    bins = df.where(F.col(truth).isNotNull() & F.col(prob).isNotNull()).groupBy(reached.alias("k")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count("*").alias("all"))
    every = df.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("step"))
    total = bins.agg(F.sum("pos").alias("positives"))
    met = F.broadcast(every).join(bins, F.col("k") >= F.col("step"), "left").groupBy("step").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("all"), F.lit(0)).alias("said")).join(F.broadcast(total))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("said") + F.col("positives")), F.lit(0.0))
    return met.select(r6(F.lit(low) + (F.col("step") - 1) * width).alias("threshold"), r6(f1).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the best F1, the lowest on ties; 0.5 if none is above 0."""
    best = sweep.where("f1 > 0").agg(F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1").alias("f"), (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"), F.coalesce("b.f1", F.lit(0.0)).alias("f1"))


def fold_summary(df: DataFrame, column: str) -> DataFrame:
    return df.agg(r6(F.avg(column)).alias("mean"), r6(F.stddev_pop(column)).alias("sd"), F.count(column).alias("folds"))


def row_share(df: DataFrame, rows: list[str], value: str) -> DataFrame:
    """share of each value within its row group."""
    counts = df.groupBy(*rows, value).agg(F.count("*").alias("count"))
    return counts.withColumn("share", r6(F.col("count") / F.sum("count").over(Window.partitionBy(*rows))))


def sample_size(population: int, margin: float = 0.03, z: float = 1.96, p: float = 0.5, cap: int | None = None) -> int:
    """Sample size with finite-population correction, never above the population (nor the cap)."""
    n0 = z * z * p * (1 - p) / margin**2
    n = math.ceil(n0 / (1 + (n0 - 1) / population)) if population else 0
    return min(n, population, cap or population)


def focal_loss(logit: Column | str, target: Column | str, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Focal loss of a binary logit: alpha_t (1 - p_t)^gamma times the cross-entropy, which is computed without overflow."""
    x, y = c(logit).cast("double"), c(target).cast("double")
    bce = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return (y * alpha + (1 - y) * (1 - alpha)) * F.pow(1 - F.exp(-bce), F.lit(gamma)) * bce


def vote_rule(label: Column | str, score: Column | str, positive: list[str]) -> Column:
    """struct(label, prob) of a model's named label and score: 1 if the name is a positive one; prob is the score of that label."""
    named = F.lower(F.trim(c(label))).isin([p.lower() for p in positive])
    return F.struct(F.coalesce(named, F.lit(False)).cast("int").alias("label"), F.coalesce(c(score).cast("double"), F.lit(0.0)).alias("prob"))


def axis_long_table(df: DataFrame, axes: list[str], by: str) -> DataFrame:
    """by, axis, mean, sample sd, n: the rows behind a chart of means with errors."""
    m = group_moments(df, axes, by)
    return m.select(by, "axis", r6(F.col("mean")).alias("mean"), r6(F.sqrt("var_samp")).alias("sd"), "n")
