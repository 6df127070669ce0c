"""Mixing of sources to target weights: a temperature found by bisection, realised as budgeted block permutations. DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.graph import meet
from textloom.session import cut, packed

WORD = r"[^\x09-\x0D\x20]+"
STEPS = 20  # bisection steps
AT_ONCE = 5  # steps whose middles are evaluated in one pass
BLOCK = 512  # documents of a block of a permutation, about
BLOCKS = 4096  # blocks of a stretch
BROADCAST_ROWS = 100_000  # sources up to which their table is broadcast
BROADCAST_BYTES = 16 << 20  # and of their names
_RANGE = 16**15


@dataclass(frozen=True)
class Mix:
    """entropy: target as a share of the way from the sources' own entropy to the largest one. repetition: most often
    that a source may be repeated. budget: tokens of the mix as a share of all tokens. seed: of the permutations."""

    entropy: float = 0.5
    repetition: float = 2.0
    budget: float = 1.0
    seed: str = "mix"


def tokens_of(text: Column) -> Column:
    """Tokens that shares and budgets count: runs of characters that aren't blanks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def place_of(seed: str, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch's permutation: 60 bits of a digest of its id."""
    key = F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def find_exponent(sources: DataFrame, mix: Mix) -> tuple[float, float]:
    """(exponent, normaliser) of sources (source, tokens): weights are share^exponent / normaliser.

    Bisects the exponent in [0, 1] for the least one whose entropy is at most the target, and for the least one whose
    most repeated source stays within the limit; the larger of both holds. Both fall as the exponent grows. A pass
    over the table of sources evaluates the middles of AT_ONCE steps for all sources, so the table is never collected.
    """
    sources = sources.where("tokens > 0")
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return 1.0, 1.0
    share = F.col("tokens") / F.lit(float(total))
    own = sources.agg(F.sum(-share * F.log(share))).first()[0]
    target = own + mix.entropy * (math.log(n) - own)
    parts = 1 << AT_ONCE

    def passes(low: dict[str, float], width: float) -> dict[str, float]:
        grid = sorted({x for v in low.values() for x in (v + width * k / parts for k in range(parts + 1))})
        rows = sources.select(share.alias("q"), F.explode(F.array(*[F.lit(x) for x in grid])).alias("tau"))
        power = F.pow("q", "tau")
        found = rows.groupBy("tau").agg(F.sum(power).alias("z"), F.sum(power * F.col("tau") * F.log("q")).alias("s"), F.max(power / F.col("q")).alias("most"))
        at = {r["tau"]: (math.log(r["z"]) - r["s"] / r["z"], r["most"] / r["z"] * mix.budget) for r in found.collect()}
        fits = {"entropy": lambda x: at[x][0] <= target + 1e-12, "repetition": lambda x: at[x][1] <= mix.repetition + 1e-12}
        out = {}
        for what, v in low.items():
            points = [v + width * k / parts for k in range(parts + 1)]
            first = next((k for k, x in enumerate(points) if fits[what](x)), parts)
            out[what] = points[max(first - 1, 0)]
        return out

    low, width = {"entropy": 0.0, "repetition": 0.0}, 1.0
    for _ in range(STEPS // AT_ONCE):
        low, width = passes(low, width), width / parts
    tau = max(_least(sources, share, mix, target, what, v, width) for what, v in low.items())
    z = sources.agg(F.sum(F.pow(share, F.lit(tau)))).first()[0]
    return tau, z


def _least(sources: DataFrame, share: Column, mix: Mix, target: float, what: str, low: float, width: float) -> float:
    """low if it already fits (only 0 can), else the end of the last interval."""
    if low > 0:
        return low + width
    z, s, most = sources.select(share.alias("q")).agg(F.sum(F.pow("q", F.lit(low))), F.sum(F.pow("q", F.lit(low)) * low * F.log("q")), F.max(F.pow("q", F.lit(low)) / F.col("q"))).first()
    fits = math.log(z) - s / z <= target + 1e-12 if what == "entropy" else most / z * mix.budget <= mix.repetition + 1e-12
    return low if fits else low + width


def mix_plan(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per source: source, tokens, docs, weight, budget, full (whole epochs), rest (tokens of the last one), blocks, cut_place, cut_id.

    The last epoch takes the documents of its permutation that begin before `rest` tokens are full, so the one that
    crosses the budget comes along (a source of one document isn't lost): those up to (cut_place, cut_id), null if
    `rest` is 0. The cut is found in three steps, so that no task holds a source: the stretch of blocks, the block and
    the document where the running total reaches `rest`. Each step sums up what is combined per source: stretches of
    about BLOCK * BLOCKS documents, the blocks of one stretch, the documents of one block.
    """
    slim = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), tokens_of(F.col(text_col)).alias("n")))
    sources = cut(slim.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    tau, z = find_exponent(sources, mix)
    share = F.col("tokens") / F.lit(float(max(total, 1)))
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(tau)) / F.lit(z)).otherwise(0.0)
    plan = sources.select("source", "tokens", "docs", weight.alias("weight"))
    plan = plan.withColumn("budget", F.floor(F.col("weight") * F.lit(mix.budget * total)).cast("long"))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    plan = plan.withColumn("full", whole).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")).withColumn("blocks", F.ceil(F.col("docs") / F.lit(float(BLOCK))).cast("long"))

    placed = with_source(slim, plan.where("rest > 0").select("source", "full", "rest", "blocks", "docs"))
    placed = placed.withColumn("place", place_of(mix.seed, F.col("full"), F.col("doc_id"))).withColumn("block", block_of(F.col("place"), F.col("blocks")))
    sums = cut(placed.groupBy("source", "rest", "block").agg(F.sum("n").alias("n"))).withColumn("stretch", F.floor(F.col("block") / BLOCKS))
    stretches = sums.groupBy("source", "rest", "stretch").agg(F.sum("n").alias("n"))
    end = _end(stretches.withColumn("start", F.lit(0).cast("long")), "stretch")
    in_stretch = sums.join(small(end), ["source", "stretch"])
    end = cut(_end(in_stretch, "block"))
    near = placed.join(small(end), ["source", "block"]).withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    cuts = _end(near.withColumn("spot", F.struct("place", "id")), "spot")
    return plan.join(cuts, "source", "left").select(*plan.columns, F.col("spot.place").alias("cut_place"), F.col("spot.id").alias("cut_id"))


def _end(parts: DataFrame, order: str) -> DataFrame:
    """source, `order` and start of each source's first part (source, rest, start, n) with which the running total, ties included, reaches rest."""
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("source").orderBy(order))
    ended = parts.withColumn("upto", upto).where("upto >= rest")
    first = ended.groupBy("source").agg(F.min(F.struct(F.col(order).alias("at"), (F.col("upto") - F.col("n")).alias("start"))).alias("end"))
    return first.select("source", F.col("end.at").alias(order), F.col("end.start").alias("start"))


def block_of(place: Column, blocks: Column) -> Column:
    """The block of a place: equal stretches of the permutation."""
    return F.floor(place.cast("double") / float(_RANGE) * blocks).cast("long")


def small(table: DataFrame) -> DataFrame:
    """Broadcasts a table of sources if its rows and the bytes of their names show that it is small; else it joins as it is."""
    return F.broadcast(table) if _fits(table) else table


def _fits(table: DataFrame) -> bool:
    n, size = table.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(F.octet_length("source"))).first()
    return n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def with_source(rows: DataFrame, sources: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows (with a column source) beside their source's columns but `docs`, its number of documents: by a broadcast if the sources
    are few, else by meet(), which deals a hot source over tasks."""
    if _fits(sources):
        return rows.join(F.broadcast(sources.drop("docs")), "source")
    return meet(rows, sources, "source", "docs", sources.agg(F.sum("docs")).first()[0] or 0, by)


def mix_rows(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """mix_sources() with the kept columns (default: all) in one struct `row`, where no name can clash."""
    mix = mix or Mix()
    plan = cut(mix_plan(docs, mix, id_col, text_col, source_col))
    parts = plan.select("source", F.struct("weight", "full", "blocks", "cut_place", "cut_id").alias("_plan"), "docs")
    rows = docs.select(packed(docs.select(*keep) if keep else docs).alias("row"), F.struct(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), tokens_of(F.col(text_col)).alias("n")).alias("_doc"))
    met = with_source(rows.withColumn("source", F.col("_doc.source")), parts, ["_doc"])
    spot = place_of(mix.seed, F.col("_plan.full"), F.col("_doc.id"))
    key = F.coalesce("_doc.id", F.lit(-(2**63)).cast("long"))
    head = F.coalesce((spot < F.col("_plan.cut_place")) | ((spot == F.col("_plan.cut_place")) & (key <= F.col("_plan.cut_id"))), F.lit(False))
    epochs = F.concat(F.when(F.col("_plan.full") > 0, F.sequence(F.lit(0).cast("long"), F.col("_plan.full") - 1)).otherwise(F.array().cast("array<bigint>")), F.when(head, F.array("_plan.full")).otherwise(F.array().cast("array<bigint>")))
    out = met.select("row", "_doc", "_plan", F.explode(epochs).alias("_epoch")).withColumn("_place", place_of(mix.seed, F.col("_epoch"), F.col("_doc.id")))
    return out.select("row", F.col("_epoch").alias("epoch"), block_of(F.col("_place"), F.col("_plan.blocks")).alias("block"), F.col("_place").alias("place"), F.col("_doc.n").alias("n_tokens"), F.round("_plan.weight", 9).alias("weight"))


def mix_sources(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """One row per document and epoch of the mix: `keep` columns (default id and source), and epoch, block, place, n_tokens, weight.

    Sources get weights share^exponent (see find_exponent) and a budget of tokens each. A budget is met by whole epochs
    of the source and the head of one more, up to the document that crosses the budget; every epoch has its own
    permutation, by a digest of seed, epoch and id, in blocks. Ordering a source by (epoch, place) gives the
    permutation. A document's part in the last epoch is a comparison with the source's cut, so texts are neither
    shuffled nor sorted.

    Cases: a null source counts as ''; null text = empty text = 0 tokens, which cost nothing and come with an epoch if
    their place is before its end; a null id comes first among equal places; repeated rows share a place and come or go
    together; a source without tokens has weight 0 and gives no rows; an empty table gives no rows; a kept column whose
    name is that of an added one gets a trailing underscore; other columns are ignored, whatever their names.
    """
    added = ["epoch", "block", "place", "n_tokens", "weight"]
    out = mix_rows(docs, mix, id_col, text_col, source_col, keep or [id_col, source_col])
    named = [F.col("row").getField(c).alias(c + "_" * (c in added)) for c in out.schema["row"].dataType.names]
    return out.select(*named, *added)


def sql(mix: Mix | None = None, table: str = "documents") -> str:
    """DuckDB SQL of mix_sources(): the same bisection as a recursive query, the permutations as one window per source."""
    m = mix or Mix()
    place = lambda epoch: f"CAST('0x' || substr(md5('{m.seed}:' || CAST({epoch} AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)"
    return rf"""
WITH RECURSIVE slim AS (
  SELECT doc_id, source AS own, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+')) AS BIGINT) AS n FROM {table}),
sources AS (SELECT source, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS docs FROM slim GROUP BY source),
total AS (SELECT sum(tokens) AS t FROM sources),
shares AS (SELECT source, tokens / (SELECT CAST(t AS DOUBLE) FROM total) AS q FROM sources WHERE tokens > 0),
goal AS (SELECT sum(-q * ln(q)) + {m.entropy} * (ln(count(*)) - sum(-q * ln(q))) AS h FROM shares),
steps AS (
  SELECT 0 AS k, 0.0::DOUBLE AS el, 1.0::DOUBLE AS eh, 0.0::DOUBLE AS rl, 1.0::DOUBLE AS rh
  UNION ALL
  SELECT k + 1, CASE WHEN e THEN el ELSE (el + eh) / 2 END, CASE WHEN e THEN (el + eh) / 2 ELSE eh END, CASE WHEN r THEN rl ELSE (rl + rh) / 2 END, CASE WHEN r THEN (rl + rh) / 2 ELSE rh END
  FROM (SELECT *,
      (SELECT ln(sum(pow(q, (el + eh) / 2))) - sum(pow(q, (el + eh) / 2) * ((el + eh) / 2) * ln(q)) / sum(pow(q, (el + eh) / 2)) FROM shares) <= (SELECT h FROM goal) + 1e-12 AS e,
      (SELECT max(pow(q, (rl + rh) / 2) / q) / sum(pow(q, (rl + rh) / 2)) FROM shares) * {m.budget} <= {m.repetition} + 1e-12 AS r
    FROM steps WHERE k < {STEPS})),
ends AS (
  SELECT CASE WHEN (SELECT ln(count(*)) FROM shares) <= (SELECT h FROM goal) + 1e-12 THEN 0.0 ELSE eh END AS e,
    CASE WHEN (SELECT max(1 / q) / count(*) FROM shares) * {m.budget} <= {m.repetition} + 1e-12 THEN 0.0 ELSE rh END AS r
  FROM steps WHERE k = {STEPS}),
tau AS (SELECT greatest(e, r) AS x FROM ends),
weights AS (SELECT source, pow(q, (SELECT x FROM tau)) / (SELECT sum(pow(q, (SELECT x FROM tau))) FROM shares) AS w FROM shares),
budgets AS (
  SELECT source, tokens, docs, coalesce(w, 0.0) AS weight, CAST(floor(coalesce(w, 0.0) * ({m.budget} * (SELECT t FROM total))) AS BIGINT) AS budget
  FROM sources LEFT JOIN weights USING (source)),
plan AS (
  SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS full, budget - (CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END) * tokens AS rest, CAST(ceil(docs / {BLOCK}.0) AS BIGINT) AS blocks
  FROM budgets),
placed AS (SELECT doc_id, own, n, source, weight, "full", rest, blocks, {place('"full"')} AS spot FROM slim JOIN plan USING (source)),
running AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY spot, coalesce(doc_id, -9223372036854775808)) - sum(n) OVER (PARTITION BY source, spot, doc_id) AS before FROM placed),
epochs AS (
  SELECT doc_id, own, n, source, weight, blocks, unnest(CASE WHEN before < rest THEN range(0, "full" + 1) ELSE range(0, "full") END) AS epoch FROM running),
spots AS (SELECT *, {place("epoch")} AS place FROM epochs)
SELECT doc_id, own AS source, CAST(epoch AS BIGINT) AS epoch, CAST(floor(CAST(place AS DOUBLE) / {float(_RANGE)!r} * blocks) AS BIGINT) AS block, place, n AS n_tokens, round(weight, 9) AS weight FROM spots
"""
