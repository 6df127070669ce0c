"""Queries of the engine's operators over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators import aggregates as A
from textloom.operators import cooccurrence as C
from textloom.operators import density as D
from textloom.operators import ensemble, match, replies, sampling, segment
from textloom.operators import similarity as V
from textloom.operators import statistics as S
from textloom.operators import tables as J
from textloom.operators.overlap import near_copies
from textloom.plans import export as X
from textloom.plans import stages
from textloom.sources import arrays, readers, shards
from textloom.streaming import incremental
from textloom.session import checkpoint_dir, cut, spread, table
from textloom.sinks import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Frame words that occur in the synthetic prose, in rule order; the study's own lists are read from files.
FRAME_WORDS = {"cognitive_manipulation": ["tionthe", "keitver"], "moral_accusation": ["erthe", "ciónque", "auxque"], "institutional_rot": ["inger", "ungen", "mente"]}
KEYWORDS = ["ción", "heit", "tionthe", "ement", "zzz absent"]
CORE = ["the", "que", "und", "les"]
AXES = ["bias_a0", "bias_a1", "bias_a2"]
LEAST_DF, LEAST_CO = 5, 3  # documents with a term, and with both terms of a pair, at any size of the table

TOPIC = "CASE WHEN doc_id % 8 = 7 THEN -1 ELSE CAST(doc_id % 8 AS INTEGER) END"
DOCS = f"d AS (SELECT *, {TOPIC} AS topic FROM documents)"
SQUEEZE = "trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g'))"
_FRAMED = " ".join(f"WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in ws)} THEN '{k}'" for k, ws in FRAME_WORDS.items())
FRAMED = f"{DOCS}, f AS (SELECT *, CASE {_FRAMED} ELSE 'other' END AS frame FROM d)"
TOKENS = f"{DOCS}, t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-zà-ÿß]+') AS tokens FROM d)"
BIAS = """
u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1e-12)) AS v FROM embeddings),
m AS (SELECT label, i, avg(v[i]) AS x FROM u, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i),
ax AS (SELECT CAST(p.label // 2 AS INTEGER) AS a, list(p.x - n.x ORDER BY p.i) AS v FROM m p JOIN m n ON n.label = p.label + 1 AND n.i = p.i WHERE p.label IN (0, 2, 4) GROUP BY 1),
an AS (SELECT a, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS v FROM ax),
b AS (SELECT d.doc_id, d.topic, d.lang, round_even(list_dot_product(u.v, a0.v), 6) AS bias_a0, round_even(list_dot_product(u.v, a1.v), 6) AS bias_a1, round_even(list_dot_product(u.v, a2.v), 6) AS bias_a2
  FROM u JOIN d ON d.doc_id = u.vec_id, (SELECT v FROM an WHERE a = 0) a0, (SELECT v FROM an WHERE a = 1) a1, (SELECT v FROM an WHERE a = 2) a2)"""
BIASED = f"WITH {DOCS}, {BIAS}"
MELTED = " UNION ALL ".join(f"SELECT doc_id, topic, lang, 'bias_a{k}' AS axis, {k} AS o, bias_a{k} AS value FROM b" for k in range(3))


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """documents with a topic: doc_id mod 8, 7 being noise."""
    return spread(table(spark, sf, "documents")).withColumn("topic", F.when(F.pmod("doc_id", F.lit(8)) == 7, -1).otherwise(F.pmod("doc_id", F.lit(8))).cast("int"))


def framed(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("text")
    case = None
    for name, words in FRAME_WORDS.items():
        hit = T.contains_any(low, words, True)
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return docs(spark, sf).withColumn("frame", case.otherwise(match.OTHER))


def tokenised(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", "lang", "topic", F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿß]+"), F.lit(0)).alias("tokens"))


def biased(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, topic, lang and three axes made from the label centroids of the embeddings."""
    e = table(spark, sf, "embeddings")
    words = e.where("label < 6").select(F.concat(F.lit("a"), F.floor(F.col("label") / 2).cast("string")).alias("axis"), F.when(F.col("label") % 2 == 0, "pos").otherwise("neg").alias("polarity"), "embedding")
    met = docs(spark, sf).join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return stages.project(met, V.axis_vectors(words)).select("doc_id", "topic", "lang", *AXES)


# -- counts, shares, pivots -------------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT lang, count(*) AS count, round_even(count(*) / sum(count(*)) OVER (), 6) AS share FROM d GROUP BY lang")
def lang_counts(spark, sf):
    return A.value_counts(docs(spark, sf), "lang")


@query(f"WITH {DOCS} SELECT lang, count(*) AS docs, count(DISTINCT topic) FILTER (topic <> -1) AS topics, count(*) FILTER (topic = -1) AS noise FROM d GROUP BY lang")
def topic_counts(spark, sf):
    real = F.when(F.col("topic") != -1, F.col("topic"))
    return docs(spark, sf).groupBy("lang").agg(F.count("*").alias("docs"), F.count_distinct(real).alias("topics"), F.count_if(F.col("topic") == -1).alias("noise"))


@query(f"WITH {FRAMED}, c AS (SELECT topic, frame, count(*) AS n FROM f GROUP BY ALL), p AS (SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY topic) AS pct FROM c) SELECT topic, {', '.join(f"round_even(coalesce(max(pct) FILTER (frame = '{k}'), 0.0), 6) AS {k}" for k in [*FRAME_WORDS, 'other'])} FROM p GROUP BY topic")
def frame_by_topic_pct(spark, sf):
    pct = A.shares_within(framed(spark, sf), ["topic"], "frame")
    return A.pivot_fixed(pct, ["topic"], "frame", [*FRAME_WORDS, "other"], F.max("pct"), 0.0)


@query(f"WITH {FRAMED} SELECT lang, frame, count(*) AS count, round_even(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY lang), 6) AS pct FROM f GROUP BY lang, frame")
def frame_by_lang_pct(spark, sf):
    return A.shares_within(framed(spark, sf), ["lang"], "frame")


@query(f"WITH {FRAMED}, top AS (SELECT source FROM f GROUP BY source ORDER BY count(*) DESC, source LIMIT 5) SELECT source, {', '.join(f"count(*) FILTER (frame = '{k}') AS {k}" for k in [*FRAME_WORDS, 'other'])} FROM f WHERE source IN (SELECT source FROM top) GROUP BY source")
def target_frame_matrix(spark, sf):
    return A.pivot_fixed(J.top_k_members(framed(spark, sf), "source", 5), ["source"], "frame", [*FRAME_WORDS, "other"], F.count(F.lit(1)), 0)


@query(f"WITH {FRAMED} SELECT lang, topic, frame, count(*) AS count FROM f WHERE topic <> -1 GROUP BY ROLLUP (lang, topic, frame)")
def frame_hierarchy(spark, sf):
    return framed(spark, sf).where("topic <> -1").rollup("lang", "topic", "frame").agg(F.count("*").alias("count"))


@query(f"WITH {FRAMED}, c AS (SELECT topic, lang, frame, count(*) AS n, min(doc_id) AS o FROM f WHERE topic <> -1 GROUP BY ALL) SELECT topic, lang, arg_min(frame, (-n, o, frame)) AS dominant, CAST(sum(n) AS BIGINT) AS rows FROM c GROUP BY topic, lang")
def dominant_frame(spark, sf):
    return A.dominant(framed(spark, sf).where("topic <> -1"), ["topic", "lang"], "frame", "doc_id")


@query(f"WITH {FRAMED}, c AS (SELECT lang, frame, source, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT lang, frame, arg_min(source, (-n, source)) AS top_source, CAST(sum(n) AS BIGINT) AS count FROM c GROUP BY ALL) SELECT *, round_even(count * 100.0 / sum(count) OVER (PARTITION BY lang), 6) AS pct_in_lang FROM t")
def modal_source(spark, sf):
    rows = framed(spark, sf)
    counts = A.shares_within(rows, ["lang"], "frame", "count", "pct_in_lang")
    return counts.join(A.modal(rows, ["lang", "frame"], "source", "top_source"), ["lang", "frame"])


@query(f"WITH {DOCS}, h AS (SELECT k.k AS keyword, count(*) FILTER (contains(lower(text), lower(k.k))) AS count, count(*) AS n FROM d, (SELECT unnest({KEYWORDS!r}) AS k) k GROUP BY 1) SELECT keyword, count, round_even(count * 100.0 / n, 6) AS row_pct, round_even(coalesce(count * 100.0 / nullif(sum(count) OVER (), 0), 0), 6) AS match_pct FROM h")
def keyword_distribution(spark, sf):
    return A.keyword_distribution(docs(spark, sf), KEYWORDS)


@query(f"WITH {DOCS}, c AS (SELECT topic, lang, count(*) AS n FROM d WHERE topic <> -1 GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY topic) AS p FROM c) SELECT topic, CAST(sum(n) AS BIGINT) AS rows, round_even(sum(-p * ln(p)), 6) AS entropy, round_even(max(p), 6) AS top_share, max(p) > 0.9 AS pure FROM p GROUP BY topic")
def topic_lang_entropy(spark, sf):
    return A.topic_purity(docs(spark, sf))


@query(f"WITH {DOCS}, c AS (SELECT topic, lang, count(*) AS n FROM d WHERE topic <> -1 GROUP BY ALL), p AS (SELECT topic, max(n) / sum(n) > 0.9 AS pure FROM c GROUP BY topic) SELECT (SELECT round_even(avg(CASE WHEN topic = -1 THEN 1.0 ELSE 0.0 END), 6) FROM d) AS noise_ratio, count(*) AS topics, count(*) FILTER (pure) AS pure_topics, count(*) FILTER (NOT pure) AS mixed_topics, round_even(count(*) FILTER (NOT pure) / count(*), 6) AS mixed_ratio FROM p")
def cluster_quality(spark, sf):
    return A.cluster_quality(docs(spark, sf))


@query(f"WITH {DOCS}, e AS (SELECT topic, lang, doc_id, unnest(string_split(text, ' ')) AS target, generate_subscripts(string_split(text, ' '), 1) AS pos FROM d WHERE topic <> -1), c AS (SELECT topic, lang, target, count(*) AS count, min((doc_id, pos)) AS f FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY topic, lang ORDER BY count DESC, f, target) AS place FROM c) SELECT topic, lang, target, count, place FROM r WHERE place <= 20")
def entity_frequency(spark, sf):
    rows = docs(spark, sf).where("topic <> -1").withColumn("words", F.split("text", " "))
    return A.exploded_counts(rows, ["topic", "lang"], "words", "doc_id", 20).withColumn("place", F.col("place").cast("long"))


# -- filters, cleaning, parsing ---------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT doc_id FROM d WHERE {' OR '.join(f"contains(lower(text), '{k}')" for k in KEYWORDS)}")
def keyword_any(spark, sf):
    return J.keyword_filter(docs(spark, sf), KEYWORDS).select("doc_id")


@query(f"WITH {DOCS} SELECT doc_id, array_to_string(list_filter({KEYWORDS!r}, lambda k: contains(lower(text), k)), ',') AS hits FROM d")
def hit_words(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.hit_words("text", KEYWORDS), ",").alias("hits"))


@query(f"WITH {DOCS} SELECT doc_id, length(text) AS n, text[1:80] AS preview FROM d WHERE length(text) BETWEEN 10 AND 250")
def length_band(spark, sf):
    return docs(spark, sf).where(T.length_between("text", 10, 250)).select("doc_id", F.char_length("text").alias("n"), T.preview("text", 80).alias("preview"))


@query(f"WITH {DOCS} SELECT doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(replace(text, chr(8203), ' '), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '\\S+@\\S+', ' ', 'g')), '[^A-Za-z0-9''\\- ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM d")
def clean_en(spark, sf):
    return docs(spark, sf).select("doc_id", T.clean_en("text").alias("cleaned"))


@query(f"WITH {DOCS} SELECT doc_id, sha1(concat_ws('||', source, lang, {SQUEEZE.format('text')}[1:120])) AS record_id FROM d")
def record_ids(spark, sf):
    return docs(spark, sf).select("doc_id", T.record_id("source", "lang", T.normalise("text", 120)).alias("record_id"))


@query(f"WITH {DOCS} SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^一-鿿]', '', 'g')) / greatest(length(text), 1) > 0.3 THEN 'zh' ELSE 'en' END AS guess, CASE WHEN lower(lang) = 'jp' THEN 'ja' ELSE lower(lang) END AS code FROM d")
def language_guess(spark, sf):
    return docs(spark, sf).select("doc_id", T.guess_language("text").alias("guess"), T.language_code("lang").alias("code"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 1 WHEN toxic = 0 THEN 0 END AS strict, coalesce(CASE WHEN quality IN (0, 1) THEN quality END, 0) AS lenient FROM labels")
def label_normalise(spark, sf):
    yes = F.when(F.col("toxic") == 1, " YES ").when(F.col("toxic") == 0, "no").otherwise("maybe")
    return table(spark, sf, "labels").select("doc_id", T.label_strict(yes).alias("strict"), T.label_lenient(F.col("quality").cast("string")).cast("long").alias("lenient"))


@query(f"WITH {DOCS} SELECT doc_id, source || '(' || n_chars || ')' AS label, source AS name, n_chars AS count FROM d")
def named_counts(spark, sf):
    label = T.count_label("source", "n_chars")
    parsed = T.named_count(label)
    return docs(spark, sf).select("doc_id", label.alias("label"), parsed["name"].alias("name"), parsed["count"].alias("count"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*(?:>|\\z)(.*?)(?:</title>|\\z)', 1), '\\s+', ' ', 'g')) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\\b[^<>]*?\\bhref=[\"'']?([^\"''\\s<>]+)', 1)) AS INTEGER) AS links FROM pages")
def page_fields(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", readers.page_title("html").alias("title"), F.size(readers.page_links("html")).alias("links"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS thread FROM conversations GROUP BY conv_id")
def threads(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))).alias("all"))
    return c.select("conv_id", "turns", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("thread"))


# -- joins, sets, deduplication ---------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT d.doc_id, coalesce(toxic, -9) AS toxic FROM d LEFT JOIN labels USING (doc_id)")
def label_join(spark, sf):
    return J.lookup(docs(spark, sf).select("doc_id"), table(spark, sf, "labels"), "doc_id", "toxic", -9)


@query(f"WITH {DOCS} SELECT lang, toxic, count(*) AS count, round_even(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY lang), 6) AS pct FROM d JOIN labels USING (doc_id) GROUP BY lang, toxic")
def label_share(spark, sf):
    return A.shares_within(docs(spark, sf).join(table(spark, sf, "labels"), "doc_id"), ["lang"], "toxic")


@query(f"WITH {DOCS} SELECT doc_id FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 0)")
def semi_label(spark, sf):
    return J.semi(docs(spark, sf), table(spark, sf, "labels").where("toxic = 1 and quality = 0"), "doc_id").select("doc_id")


@query(f"WITH {DOCS} SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_label(spark, sf):
    return J.anti(docs(spark, sf), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("SELECT DISTINCT text FROM documents")
def dedup_exact(spark, sf):
    return docs(spark, sf).select("text").distinct()


@query("SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def dedup_keep_first(spark, sf):
    return J.first_by_key(docs(spark, sf).select("text", "doc_id", "source"), ["text"], ["doc_id"])


@query("SELECT text, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY text")
def last_by_text(spark, sf):
    return J.last_by_key(docs(spark, sf).select("text", "doc_id", "source"), ["text"], ["doc_id"])


@query("SELECT doc_id, text, lang, CAST(NULL AS BIGINT) AS item_id FROM documents UNION ALL SELECT NULL, text, NULL, item_id FROM benchmark")
def union_ragged(spark, sf):
    return J.union_ragged(table(spark, sf, "documents").select("doc_id", "text", "lang"), table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), "text"))


@query(f"WITH {DOCS} SELECT doc_id, topic, lang FROM d WHERE (topic, lang) IN (SELECT (topic, lang) FROM d GROUP BY topic, lang HAVING count(*) >= 10)")
def group_size_filter(spark, sf):
    return J.group_size_at_least(docs(spark, sf), ["topic", "lang"], 10).select("doc_id", "topic", "lang")


@query(f"WITH {FRAMED}, a AS (SELECT topic, lang, count(*) AS docs FROM d WHERE topic < 4 GROUP BY ALL), b AS (SELECT topic, lang, count(*) AS framed FROM f WHERE frame <> 'other' GROUP BY ALL), c AS (SELECT topic, lang, sum(toxic) AS toxic FROM d JOIN labels USING (doc_id) GROUP BY ALL) SELECT topic, lang, coalesce(docs, 0) AS docs, coalesce(framed, 0) AS framed, CAST(coalesce(toxic, 0) AS BIGINT) AS toxic FROM a FULL JOIN b USING (topic, lang) FULL JOIN c USING (topic, lang)")
def layer_merge(spark, sf):
    rows = framed(spark, sf)
    a = rows.where("topic < 4").groupBy("topic", "lang").agg(F.count("*").alias("docs"))
    b = rows.where("frame <> 'other'").groupBy("topic", "lang").agg(F.count("*").alias("framed"))
    c = rows.join(table(spark, sf, "labels"), "doc_id").groupBy("topic", "lang").agg(F.sum("toxic").alias("toxic"))
    return J.merge_layers(a, b, c, keys=["topic", "lang"]).na.fill(0)


@query(f"WITH {TOKENS}, x AS (SELECT lang, unnest(tokens) AS term FROM t), top AS (SELECT lang, term FROM x WHERE lang IN ('en', 'fr') GROUP BY lang, term QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) <= 50), e AS (SELECT term FROM top WHERE lang = 'en'), f AS (SELECT term FROM top WHERE lang = 'fr') SELECT term, 'common' AS side FROM e WHERE term IN (FROM f) AND term <> 'the' UNION ALL SELECT term, 'only_a' FROM e WHERE term NOT IN (FROM f) AND term <> 'the' UNION ALL SELECT term, 'only_b' FROM f WHERE term NOT IN (FROM e) AND term <> 'the'")
def term_set_ops(spark, sf):
    counts = tokenised(spark, sf).where("lang in ('en', 'fr')").select("lang", F.explode("tokens").alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))
    top = counts.withColumn("p", place).where("p <= 50")
    sides = J.set_difference(top.where("lang = 'en'").select("term"), top.where("lang = 'fr'").select("term"), ["the"])
    return J.union_ragged(*[df.withColumn("side", F.lit(k)) for k, df in sides.items()])


# -- terms and pairs --------------------------------------------------------------------------------------------------


@query(f"WITH {TOKENS}, a AS (SELECT term, count(*) AS tf FROM (SELECT unnest(tokens) AS term FROM t) GROUP BY term), b AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM t) GROUP BY term) SELECT term, tf, df FROM a JOIN b USING (term)")
def term_frequencies(spark, sf):
    return C.term_frequencies(tokenised(spark, sf))


@query(f"WITH {TOKENS}, g AS (SELECT unnest(list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: array_to_string(tokens[i:i + 1], ' ')), list_transform(range(1, greatest(len(tokens) - 1, 1)), lambda i: array_to_string(tokens[i:i + 2], ' ')))) AS ngram FROM t), c AS (SELECT ngram, count(*) AS count FROM g GROUP BY ngram) SELECT ngram, CAST(len(string_split(ngram, ' ')) AS INTEGER) AS n, count FROM c WHERE count >= 10 AND NOT (len(list_filter(string_split(ngram, ' '), lambda w: NOT list_contains({CORE!r}, w))) = 0)")
def ngram_counts(spark, sf):
    return C.ngram_counts(tokenised(spark, sf), stop=CORE, least=10)


_SETS = f"{TOKENS}, n AS (SELECT count(*) AS n FROM t), s0 AS (SELECT doc_id, unnest(list_distinct(tokens)) AS term FROM t), df AS (SELECT term, count(*) AS df FROM s0 GROUP BY term HAVING count(*) >= {LEAST_DF}), s AS (SELECT doc_id, term FROM s0 JOIN df USING (term))"
_PAIRS = f"{_SETS}, co AS (SELECT x.term AS a, y.term AS b, count(*) AS co FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY ALL HAVING count(*) >= {LEAST_CO}), p AS (SELECT a, b, co, da.df AS df_a, db.df AS df_b, (SELECT n FROM n) AS n_docs FROM co JOIN df da ON da.term = a JOIN df db ON db.term = b)"


@query(f"WITH {_PAIRS} SELECT a, b, co, df_a, df_b, n_docs FROM p")
def cooc_pairs(spark, sf):
    return C.document_pairs(tokenised(spark, sf), LEAST_DF, min_co=LEAST_CO)


@query(f"WITH {_PAIRS} SELECT a, b, co, df_a, df_b, round_even(ln(n_docs * co / CAST(df_a * df_b AS DOUBLE) + 1e-12), 6) AS pmi, round_even((co - df_a * df_b / CAST(n_docs AS DOUBLE)) / sqrt(co), 6) AS tscore, round_even(df_a * df_b / CAST(n_docs AS DOUBLE), 6) AS e FROM p")
def pmi_tscore(spark, sf):
    return C.document_scores(C.document_pairs(tokenised(spark, sf), LEAST_DF, min_co=LEAST_CO))


_CORE = f"{_SETS}, q AS (SELECT x.term AS core, y.term AS term, count(*) AS co FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.term <> y.term WHERE list_contains({CORE!r}, x.term) GROUP BY ALL HAVING count(*) >= {LEAST_CO}), r AS (SELECT core, q.term, co, round_even(ln((SELECT n FROM n) * co / CAST(a.df * b.df AS DOUBLE) + 1e-12), 6) AS pmi, round_even((co - a.df * b.df / CAST((SELECT n FROM n) AS DOUBLE)) / sqrt(co), 6) AS tscore FROM q JOIN df a ON a.term = core JOIN df b ON b.term = q.term), z AS (SELECT *, coalesce((pmi - min(pmi) OVER ()) / nullif(max(pmi) OVER () - min(pmi) OVER (), 0), 0) AS pn, coalesce((tscore - min(tscore) OVER ()) / nullif(max(tscore) OVER () - min(tscore) OVER (), 0), 0) AS tn FROM r), y AS (SELECT core, term, co, pmi, tscore, round_even(pn, 6) AS pmi_norm, round_even(tn, 6) AS tscore_norm, round_even(0.5 * pn + 0.5 * tn, 6) AS score FROM z)"


@query(f"WITH {_CORE} SELECT *, CAST(row_number() OVER (PARTITION BY core ORDER BY score DESC, term) AS INTEGER) AS place FROM y QUALIFY row_number() OVER (PARTITION BY core ORDER BY score DESC, term) <= 10")
def top_n_per_core(spark, sf):
    pairs = C.core_pairs(tokenised(spark, sf), CORE, LEAST_DF, min_co=LEAST_CO)
    scored = C.document_scores(pairs.withColumnsRenamed({"core": "a", "term": "b", "df_core": "df_a", "df_term": "df_b"}))
    return C.top_per_core(C.scaled_scores(scored.selectExpr("a as core", "b as term", "co", "pmi", "tscore")), 10)


@query(f"""WITH {TOKENS}, c AS (SELECT term, count(*) AS c FROM (SELECT unnest(tokens) AS term FROM t) GROUP BY term HAVING count(*) >= 100),
w AS (SELECT list_distinct(tokens[i:i + 3]) AS w FROM (SELECT tokens, unnest(range(1, len(tokens))) AS i FROM t)),
n AS (SELECT count(*) AS n FROM w), x AS (SELECT row_number() OVER () AS id, w FROM w), y AS (SELECT id, unnest(w) AS term FROM x),
co AS (SELECT p.term AS a, q.term AS b, count(*) AS co FROM y p JOIN y q ON p.id = q.id AND p.term < q.term WHERE p.term IN (SELECT term FROM c) AND q.term IN (SELECT term FROM c) GROUP BY ALL),
m AS (SELECT a, b, co, ca.c AS c_a, cb.c AS c_b, CAST((SELECT n FROM n) AS DOUBLE) AS n FROM co JOIN c ca ON ca.term = a JOIN c cb ON cb.term = b),
s AS (SELECT *, log2((co / n + 1e-9) / ((c_a / n) * (c_b / n) + 1e-9)) AS pmi FROM m)
SELECT a, b, co, c_a, c_b, round_even(pmi, 6) AS pmi, round_even(pmi / -log2(co / n + 1e-9), 6) AS npmi, round_even((co - CAST(c_a AS DOUBLE) * c_b / n) / sqrt(co), 6) AS tscore,
 round_even(CASE WHEN c_a + c_b - co > 0 THEN co / CAST(c_a + c_b - co AS DOUBLE) END, 6) AS jaccard,
 round_even(CASE WHEN co > 0 THEN 2 * co * ln(co * n / (CAST(c_a AS DOUBLE) * c_b)) ELSE 0 END + CASE WHEN c_a > co AND n > c_b THEN 2 * (c_a - co) * ln((c_a - co) * n / (c_a * (n - c_b))) ELSE 0 END
  + CASE WHEN c_b > co AND n > c_a THEN 2 * (c_b - co) * ln((c_b - co) * n / ((n - c_a) * c_b)) ELSE 0 END + CASE WHEN n - c_a - c_b + co > 0 AND n > c_a AND n > c_b THEN 2 * (n - c_a - c_b + co) * ln((n - c_a - c_b + co) * n / ((n - c_a) * (n - c_b))) ELSE 0 END, 6) AS llr FROM s""")
def npmi_jaccard(spark, sf):
    return C.window_scores(C.window_pairs(tokenised(spark, sf), 4, 100))


@query(f"WITH {TOKENS}, n AS (SELECT count(*) AS n FROM t), x AS (SELECT doc_id, lang, term, count(*) AS tf FROM (SELECT doc_id, lang, unnest(tokens) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM x GROUP BY term HAVING count(*) >= 5), w AS (SELECT doc_id, lang, term, tf * (ln((1 + (SELECT n FROM n)) / (1.0 + df)) + 1) AS w FROM x JOIN df USING (term)), v AS (SELECT lang, term, round_even(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w), s AS (SELECT lang, term, round_even(sum(weight) / (SELECT count(*) FROM t WHERE t.lang = v.lang), 6) AS mean_weight FROM v GROUP BY lang, term) SELECT lang, term, mean_weight, CAST(row_number() OVER (PARTITION BY lang ORDER BY mean_weight DESC, term) AS INTEGER) AS place FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY mean_weight DESC, term) <= 10")
def tfidf_keywords(spark, sf):
    return C.group_keywords(tokenised(spark, sf), "lang", 10, min_df=5)


# -- axes and group statistics ----------------------------------------------------------------------------------------


@query(f"{BIASED} SELECT * FROM b")
def axis_projection(spark, sf):
    return biased(spark, sf)


@query(f"{BIASED} SELECT doc_id, lang, {', '.join(f'round_even(CASE WHEN stddev_pop({x}) OVER (PARTITION BY lang) < 1e-12 THEN 0 ELSE ({x} - avg({x}) OVER (PARTITION BY lang)) / stddev_pop({x}) OVER (PARTITION BY lang) END, 6) AS {x}_z' for x in AXES)} FROM b")
def zscore_within_lang(spark, sf):
    return S.z_scores(biased(spark, sf), AXES, "lang").select("doc_id", "lang", *[f"{x}_z" for x in AXES])


@query(f"{BIASED} SELECT topic, lang, count(*) AS n, {', '.join(f'round_even(avg({x}), 12) AS {x}_mean' for x in AXES)} FROM b WHERE topic <> -1 GROUP BY topic, lang")
def topic_lang_profile(spark, sf):
    return A.means(biased(spark, sf).where("topic <> -1"), ["topic", "lang"], AXES, digits=12)


@query(f"{BIASED} SELECT doc_id, bias_a0, CASE WHEN bias_a0 <= least(bias_a1, bias_a2) THEN 'bias_a0' WHEN bias_a1 <= bias_a2 THEN 'bias_a1' ELSE 'bias_a2' END AS dominant_axis, least(bias_a0, bias_a1, bias_a2) AS dominant_value FROM b")
def dominant_axis(spark, sf):
    return A.lowest_axis(biased(spark, sf), AXES).select("doc_id", "bias_a0", "dominant_axis", "dominant_value")


@query(f"{BIASED}, l AS ({MELTED}), s AS (SELECT lang, axis, min(o) AS o, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd, stddev_samp(value) / sqrt(count(*)) AS se, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY lang, axis), t AS (SELECT lang, axis, arg_min(topic, (round_even(m, 9), topic)) AS most_negative_topic FROM (SELECT lang, axis, topic, avg(value) AS m FROM l GROUP BY ALL) GROUP BY lang, axis), r AS (SELECT *, m - avg(m) OVER (PARTITION BY lang) AS sal FROM s) SELECT lang, axis, n, round_even(m, 6) AS mean, round_even(sd, 6) AS sd, round_even(se, 6) AS se, round_even(m - 1.96 * se, 6) AS ci_low, round_even(m + 1.96 * se, 6) AS ci_high, round_even(q2, 6) AS median, round_even(q1, 6) AS q25, round_even(q3, 6) AS q75, round_even(sal, 6) AS salience, CAST(row_number() OVER (PARTITION BY lang ORDER BY round_even(sal, 9), o) AS INTEGER) AS rank, most_negative_topic FROM r JOIN t USING (lang, axis)")
def lang_axis_summary(spark, sf):
    return A.language_axis_summary(biased(spark, sf), AXES)


@query(f"{BIASED}, l AS ({MELTED}), g AS (SELECT topic FROM b GROUP BY topic HAVING count(*) >= 10) SELECT topic, {', '.join(f"round_even(avg(value) FILTER (axis = '{x}'), 6) AS {x}" for x in AXES)} FROM l JOIN g USING (topic) WHERE topic <> -1 GROUP BY topic")
def topic_axis_table(spark, sf):
    rows = J.group_size_at_least(biased(spark, sf).where("topic <> -1"), ["topic"], 10)
    return A.pivot_fixed(A.melt(rows.select("topic", *AXES), ["topic"], AXES), ["topic"], "axis", AXES, A.r6(F.avg("value")), 0.0)


@query(f"{BIASED} SELECT x.k AS x, y.k AS y, round_even(CASE {' '.join(f"WHEN x.k = '{a}' AND y.k = '{b}' THEN (SELECT corr({a}, {b}) FROM b)" for a in AXES for b in AXES)} END, 6) AS r FROM (SELECT unnest({AXES!r}) AS k) x, (SELECT unnest({AXES!r}) AS k) y")
def pearson_axes(spark, sf):
    return S.pearson_matrix(biased(spark, sf), AXES)


@query(f"{BIASED}, l AS ({MELTED}), g AS (SELECT axis, lang, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM l GROUP BY ALL), t AS (SELECT axis, sum(n) AS n, sum(n * m) / sum(n) AS m FROM g GROUP BY axis), s AS (SELECT axis, sum(g.n * (g.m - t.m) ** 2) AS ssb, sum(g.n * v) AS ssw, count(*) AS k, any_value(t.n) AS n FROM g JOIN t USING (axis) GROUP BY axis HAVING min(g.n) >= 10) SELECT axis, round_even((ssb / (k - 1)) / (ssw / (n - k)), 5) AS f_stat, round_even(ssb / (ssb + ssw), 6) AS eta_squared FROM s")
def anova_axes(spark, sf):
    return S.anova(biased(spark, sf), AXES, "lang").select("axis", F.bround("f_stat", 5).alias("f_stat"), A.r6(F.col("eta_squared")).alias("eta_squared"))


@query()
def anova_significance(spark, sf):
    return S.anova(biased(spark, sf), AXES, "lang").select("axis", "p_value", "significant", F.explode("welch").alias("pair", "welch_p"))


# -- vectors ----------------------------------------------------------------------------------------------------------

_COS = "round_even(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6)"
_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(f"WITH {_E}, p AS (SELECT a.vec_id AS seed, b.vec_id AS pool, {_COS} AS cosine FROM e a, e b WHERE a.vec_id % 50 = 0) SELECT seed, pool, cosine, CAST(row_number() OVER (PARTITION BY seed ORDER BY cosine DESC, pool) AS INTEGER) AS place FROM p QUALIFY row_number() OVER (PARTITION BY seed ORDER BY cosine DESC, pool) <= 5")
def cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return V.top_k_cosine(e.where("vec_id % 50 = 0"), e, 5, "vec_id", "vec_id")


@query(f"WITH {_E}, p AS (SELECT a.vec_id, max({_COS}) AS m FROM e a, e b WHERE a.label < 3 AND b.label >= 3 GROUP BY 1) SELECT count(*) FILTER (m > 0.3) AS redundant, round_even(count(*) FILTER (m > 0.3) / count(*), 6) AS share FROM p")
def redundancy_share(spark, sf):
    e = table(spark, sf, "embeddings")
    return V.redundancy(e.where("label < 3"), e.where("label >= 3"), "vec_id", "vec_id", 0.3)


@query(f"WITH {_E} SELECT a.label, any_value(n) AS n, round_even(avg(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))), 6) AS mean_cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id JOIN (SELECT label, count(*) AS n FROM e GROUP BY label) c ON c.label = a.label GROUP BY a.label")
def group_similarity(spark, sf):
    return V.mean_similarity(table(spark, sf, "embeddings"), "embedding", ["label"])


@query(f"WITH {_E}, p AS (SELECT a.vec_id AS s, a.label = b.label AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id) SELECT round_even(avg(p), 6) AS precision FROM (SELECT s, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS p FROM p WHERE r <= 5 GROUP BY s)")
def precision_at_5(spark, sf):
    return V.precision_at_k(table(spark, sf, "embeddings"), 5, "vec_id", "label")


_CENTRE = f"{_E}, m AS (SELECT label, i, avg(e[i]) AS x FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label)"


@query(f"WITH {_CENTRE}, q AS (SELECT e.label, vec_id, round_even(list_dot_product(e.e, c.c) / (sqrt(list_dot_product(e.e, e.e)) * sqrt(list_dot_product(c.c, c.c))), 6) AS cosine FROM e JOIN c USING (label)) SELECT label, vec_id, cosine, CAST(row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS INTEGER) AS place FROM q QUALIFY row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) <= 3")
def centroid_nearest(spark, sf):
    return V.representatives(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")


@query(f"WITH {_CENTRE}, z AS (SELECT vec_id, list_transform(list_zip(e.e, c.c), lambda p: p[1] - p[2]) AS v FROM e JOIN c USING (label)) SELECT vec_id, round_even(v[1] / (sqrt(list_dot_product(v, v)) + 1e-12), 6) AS first, round_even(v[64] / (sqrt(list_dot_product(v, v)) + 1e-12), 6) AS last FROM z")
def centred_vectors(spark, sf):
    out = V.centre_by(table(spark, sf, "embeddings"), "label", "embedding")
    return out.select("vec_id", A.r6(F.col("centred")[0]).alias("first"), A.r6(F.col("centred")[63]).alias("last"))


@query(f"WITH {_CENTRE}, s AS (SELECT label, any_value(c.c) AS c, avg(list_distance(e.e, c.c)) AS s, sum(list_distance(e.e, c.c) ** 2) AS w, count(*) AS n FROM e JOIN c USING (label) GROUP BY label), g AS (SELECT list(x ORDER BY i) AS g FROM (SELECT i, avg(e[i]) AS x FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY i)), d AS (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label) SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS rows, round_even((SELECT avg(r) FROM d), 6) AS davies_bouldin, round_even((sum(n * list_distance(c, (SELECT g FROM g)) ** 2) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) AS calinski_harabasz FROM s")
def cluster_scores(spark, sf):
    out = V.cluster_scores(table(spark, sf, "embeddings"), "label", "embedding")
    return out.select("clusters", "rows", A.r6(F.col("davies_bouldin")).alias("davies_bouldin"), A.r6(F.col("calinski_harabasz")).alias("calinski_harabasz"))


@query("SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS place, round_even(CAST(list_sum(CAST(embedding AS DOUBLE[])) AS DOUBLE), 6) AS total, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings")
def array_rows(spark, sf):
    """The embeddings written as .npy files by the tasks that hold them, and read back by ranges of rows."""
    folder = f"{checkpoint_dir(spark)}/arrays-{uuid.uuid4().hex}"
    e = table(spark, sf, "embeddings")
    arrays.write_npy(e, folder, "vec_id", "embedding", V.dim_of(e, "embedding"))
    rows = arrays.read_npy(spark, folder, 1 << 20)
    files = cut(rows.groupBy("name").agg(F.count("*").alias("n")))  # a row a file
    before = files.select("name", (F.sum("n").over(Window.orderBy("name")) - F.col("n")).alias("before"))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return rows.join(J.small(before), "name").select((F.col("before") + F.col("row")).alias("place"), A.r6(total).alias("total"), F.get("vector", F.lit(0)).alias("first"))


@query()
def segmented_documents(spark, sf):
    """Words of all documents learnt from those whose crc32(doc_id) mod 5 is not 0, found again in the others' letters without blanks: boundaries there, found, and right."""
    rows = tokenised(spark, sf).select("doc_id", F.coalesce("tokens", F.array()).alias("tokens"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    model = segment.learn(rows.where(fold != 0).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    held = rows.where(fold == 0).select("doc_id", F.array_join("tokens", "").alias("text"), segment.boundaries("tokens").alias("own"))
    found = segment.segmented(held, model).select("doc_id", "own", F.size("words").alias("n_words"), segment.boundaries("words").alias("ends"))
    return found.select("doc_id", "n_words", F.size("own").alias("n_own"), F.size("ends").alias("n_found"), F.size(F.array_intersect("own", "ends")).alias("n_right"))


@query()
def kmeans_closest(spark, sf):
    out = V.kmeans(table(spark, sf, "embeddings"), 10, "embedding")
    return V.closest_to_centre(V.drop_outliers(out), 5, "vec_id").select("cluster", "vec_id", "place")


@query()
def density_topics(spark, sf):
    """Every vector with its topic by density; no SQL has the hierarchy, the tests hold it against the definitions."""
    return D.density_topics(table(spark, sf, "embeddings"), 10, 2, "vec_id")


@query()
def pca_scores(spark, sf):
    return S.principal_components(biased(spark, sf), AXES, 2)[0].select("doc_id", A.r6(F.col("pc1")).alias("pc1"), A.r6(F.col("pc2")).alias("pc2"))


# -- labels, ensembles, samples ---------------------------------------------------------------------------------------


@query(f"WITH {DOCS}, x AS (SELECT lang, toxic, CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END AS p FROM d JOIN labels USING (doc_id)), c AS (SELECT lang, count(*) FILTER (toxic = 1 AND p = 1) AS tp, count(*) FILTER (toxic <> 1 AND p = 1) AS fp, count(*) FILTER (toxic = 1 AND p <> 1) AS fn, count(*) FILTER (toxic <> 1 AND p <> 1) AS tn FROM x GROUP BY lang) SELECT lang, tp, fp, fn, tn, round_even(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy, round_even(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round_even(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round_even(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")
def confusion_f1(spark, sf):
    rows = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").withColumn("p", F.when(F.col("n_chars") % 3 == 0, 1).otherwise(0))
    return S.confusion(rows, "toxic", "p", ["lang"])


_PROB = f"{DOCS}, x AS (SELECT toxic, (doc_id * 37 % 100) / 100.0 + 0.003 AS p FROM d JOIN labels USING (doc_id)), g AS (SELECT 0.01::DOUBLE + i * ((0.95::DOUBLE - 0.01::DOUBLE) / 94) AS t FROM (SELECT unnest(range(0, 95)) AS i)), s AS (SELECT t, count(*) FILTER (p >= t AND toxic = 1) AS tp, count(*) FILTER (p >= t) AS said, count(*) FILTER (toxic = 1) AS pos FROM x, g GROUP BY t), w AS (SELECT round_even(t, 6) AS threshold, round_even(coalesce(2 * tp / nullif(said + pos, 0), 0), 6) AS f1 FROM s)"


def _probabilities(spark, sf):
    return docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("toxic", (F.pmod(F.col("doc_id") * 37, F.lit(100)) / 100.0 + 0.003).alias("p"))


@query(f"WITH {_PROB} SELECT threshold, f1 FROM w")
def threshold_sweep(spark, sf):
    return S.threshold_sweep(_probabilities(spark, sf), "toxic", "p")


@query(f"WITH {_PROB} SELECT threshold, f1 FROM w ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, sf):
    return S.best_threshold(S.threshold_sweep(_probabilities(spark, sf), "toxic", "p"))


def voted(spark, sf):
    vote = lambda k, m: F.struct(F.lit(f"m{k}").alias("model"), (F.pmod(F.col("doc_id"), F.lit(m)) == 0).cast("int").alias("label"), (F.pmod(F.col("doc_id") * (k + 3), F.lit(101)) / 101.0).alias("prob"))
    return ensemble.evaluate(docs(spark, sf).select("doc_id", "text", F.array(vote(1, 2), vote(2, 3), vote(3, 5)).alias("votes")))


_VOTES = "v AS (SELECT doc_id, [CAST(doc_id % 2 = 0 AS INTEGER), CAST(doc_id % 3 = 0 AS INTEGER), CAST(doc_id % 5 = 0 AS INTEGER)] AS l, [(doc_id * 4 % 101) / 101.0, (doc_id * 5 % 101) / 101.0, (doc_id * 6 % 101) / 101.0] AS p FROM documents), w AS (SELECT doc_id, CAST(list_sum(l) AS INTEGER) AS f, list_sum(p) / 3 AS m, (CASE WHEN l[1] = 1 THEN p[1] ELSE 1 - p[1] END + CASE WHEN l[2] = 1 THEN p[2] ELSE 1 - p[2] END + CASE WHEN l[3] = 1 THEN p[3] ELSE 1 - p[3] END) / 3 AS q FROM v)"


@query(f"WITH {_VOTES} SELECT doc_id, f AS vote_for, 3 - f AS vote_against, f || '/' || (3 - f) AS model_votes, round_even(m, 6) AS avg_prob, round_even(q, 6) AS avg_p_pos, round_even(CASE WHEN m <= 0 OR m >= 1 THEN 0 ELSE -m * log2(m) - (1 - m) * log2(1 - m) END, 6) AS entropy, f > 0 AND f < 3 AS conflict FROM w")
def ensemble_eval(spark, sf):
    return voted(spark, sf).select("doc_id", "vote_for", "vote_against", "model_votes", "avg_prob", "avg_p_pos", "entropy", "conflict")


_DRAW = "md5('{}:' || doc_id), doc_id"


@query(f"""WITH {_VOTES}, z AS (SELECT doc_id, text, f, round_even(m, 6) AS m, f > 0 AND f < 3 AS conflict FROM w JOIN documents USING (doc_id)),
pool AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY CASE WHEN conflict OR m BETWEEN 0.4 AND 0.6 THEN 0 ELSE 1 END, doc_id) AS r FROM z WHERE conflict OR m BETWEEN 0.4 AND 0.6 OR m < 0.5) WHERE r = 1),
first AS (SELECT doc_id FROM pool ORDER BY {_DRAW.format(42)} LIMIT {{ANNOTATED}}), need AS (SELECT {{ANNOTATED}} - count(*) AS k FROM first),
rest AS (SELECT * FROM z WHERE doc_id NOT IN (FROM first)),
high AS (SELECT doc_id, row_number() OVER (ORDER BY {_DRAW.format(42)}) AS r FROM rest WHERE f = 3 AND m >= 0.8), low AS (SELECT doc_id, row_number() OVER (ORDER BY {_DRAW.format(42)}) AS r FROM rest WHERE f = 0)
SELECT doc_id, 'uncertain_or_low_confidence' AS sampling_strategy_tag FROM first
UNION ALL SELECT doc_id, 'consistent_hate_high_conf' FROM high WHERE r <= (SELECT (k + 1) // 2 FROM need)
UNION ALL SELECT doc_id, 'consistent_non_hate' FROM low WHERE r <= (SELECT k // 2 FROM need)""".replace("{ANNOTATED}", "4000"))
def annotation_sample(spark, sf):
    return sampling.annotation_sample(voted(spark, sf), 4000, 3).select("doc_id", "sampling_strategy_tag")


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY toxic, quality ORDER BY {_DRAW.format(42)}) <= round_even(count(*) OVER (PARTITION BY toxic, quality) * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM labels")
def stratified_split(spark, sf):
    return sampling.split(table(spark, sf, "labels"), ["toxic", "quality"]).select("doc_id", "split")


@query(f"WITH n AS (SELECT count(*) // 5 AS size, count(*) % 5 AS longer FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY {_DRAW.format(42)}) - 1 AS place FROM documents) SELECT doc_id, CAST(CASE WHEN place < longer * (size + 1) THEN place // (size + 1) ELSE longer + (place - longer * (size + 1)) // greatest(size, 1) END AS INTEGER) AS fold FROM r, n")
def fold_rows(spark, sf):
    return sampling.exact_folds(docs(spark, sf)).select("doc_id", "fold")


@query("SELECT CAST(k AS INTEGER) AS fold, (SELECT count(*) FROM documents) // 5 + CASE WHEN k < (SELECT count(*) FROM documents) % 5 THEN 1 ELSE 0 END AS rows FROM (SELECT unnest(range(0, 5)) AS k)")
def fold_sizes(spark, sf):
    return sampling.exact_folds(docs(spark, sf)).groupBy("fold").agg(F.count("*").alias("rows"))


@query(f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_DRAW.format(42)}) <= 25")
def sample_per_lang(spark, sf):
    return sampling.sample_per_group(docs(spark, sf), "lang", 25).select("doc_id", "lang")


@query("SELECT doc_id, toxic, CAST(copy AS INTEGER) AS copy FROM labels, (SELECT unnest(range(1, 11)) AS copy) WHERE toxic = 1 OR copy = 1")
def oversampled(spark, sf):
    return J.oversample(table(spark, sf, "labels"), F.col("toxic") == 1).select("doc_id", "toxic", "copy")


@query("SELECT d.doc_id, 'exact' AS kind FROM documents d WHERE doc_id % 10 = 0 AND text IN (SELECT text FROM documents WHERE doc_id % 10 <> 0)")
def exact_leaks(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return V.leaks(rows.where("doc_id % 10 = 0"), rows.where("doc_id % 10 <> 0"), "doc_id", "doc_id", near=False)


@query()
def all_leaks(spark, sf):
    rows = spread(table(spark, sf, "documents")).select("doc_id", "text")
    return V.leaks(rows.where("doc_id % 10 = 0"), rows.where("doc_id % 10 <> 0"), "doc_id", "doc_id", blocking=False)


@query()
def near_leaks(spark, sf):
    """Every pair of a held-out document (ids divisible by 100) and another whose difflib ratio exceeds 0.85; held against all pairs in the tests."""
    rows = spread(table(spark, sf, "documents")).select("doc_id", "text")
    return near_copies(rows.where("doc_id % 100 = 0"), rows, "doc_id", "doc_id").select("held", "train", A.r6(F.col("ratio")).alias("ratio"))


@query()
def leak_report(spark, sf):
    """The verdict on a validation table: shares of exact and near leaks, and whether they exceed 5 %."""
    rows = spread(table(spark, sf, "documents")).select("doc_id", "text")
    val = rows.where("doc_id % 100 = 0")
    return V.leak_verdict(val, V.leaks(val, rows.where("doc_id % 100 <> 0"), "doc_id", "doc_id", blocking=False))


@query("SELECT doc_id, quality, toxic FROM labels WHERE toxic = 1 AND quality = 1")
def flag_conjunction(spark, sf):
    return J.flags(table(spark, sf, "labels"), ["toxic", "quality"]).select("doc_id", "quality", "toxic")


@query("SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 1")
def flag_disjunction(spark, sf):
    return J.flags(table(spark, sf, "labels"), any_of=["toxic", "quality"]).select("doc_id")


@query("SELECT role, count(*) AS turns FROM conversations WHERE lower(role) IN ('user', 'assistant') GROUP BY role")
def equality_any_case(spark, sf):
    return table(spark, sf, "conversations").where(J.equals_any_case("role", "USER", "Assistant")).groupBy("role").agg(F.count("*").alias("turns"))


@query("SELECT a.n_name AS subject, b.r_name AS predicate, a.n_name || ' ' || b.r_name AS text FROM nation a, region b")
def product_testset(spark, sf):
    return J.product_rows(table(spark, sf, "nation").select(F.col("n_name").alias("subject")), table(spark, sf, "region").select(F.col("r_name").alias("predicate")))


@query(f"WITH {FRAMED} SELECT lang, frame, count(*) AS count, round_even(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM f GROUP BY lang, frame")
def lang_category_share(spark, sf):
    return S.row_share(framed(spark, sf), ["lang"], "frame")


@query(f"{BIASED}, l AS ({MELTED}) SELECT lang, axis, round_even(avg(value), 6) AS mean, round_even(stddev_samp(value), 6) AS sd, count(*) AS n FROM l GROUP BY lang, axis")
def lang_axis_long(spark, sf):
    return S.axis_long_table(biased(spark, sf), AXES, "lang")


@query("SELECT doc_id, round_even(CASE WHEN toxic = 1 THEN 0.25 ELSE 0.75 END * (1 - p) ** 2 * -ln(p), 6) AS loss FROM (SELECT doc_id, toxic, CASE WHEN toxic = 1 THEN 1 / (1 + exp(-x)) ELSE 1 - 1 / (1 + exp(-x)) END AS p FROM (SELECT doc_id, toxic, (doc_id % 17 - 8) / 3.0 AS x FROM labels))")
def focal_losses(spark, sf):
    return table(spark, sf, "labels").select("doc_id", A.r6(S.focal_loss((F.pmod("doc_id", F.lit(17)) - 8) / 3.0, "toxic")).alias("loss"))


@query("SELECT n_name AS name, CASE WHEN n_name = 'CHINA' THEN 'Middle Kingdom' ELSE regexp_replace(array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' '), '$', '') END AS translated FROM nation")
def name_translation(spark, sf):
    return J.translate_names(table(spark, sf, "nation").select(F.col("n_name").alias("name")), "name", {"china": "Middle Kingdom"})


@query("SELECT doc_id, CASE WHEN length(s) <= 28 THEN s ELSE rtrim(s[1:27]) || '…' END AS label FROM (SELECT doc_id, source || ' ' || text[1:40] AS s FROM documents)")
def short_labels(spark, sf):
    return docs(spark, sf).select("doc_id", T.short_label(F.concat_ws(" ", "source", F.substring("text", 1, 40))).alias("label"))


@query(f"WITH {DOCS} SELECT d.doc_id, b.item_id FROM d, (SELECT item_id, lower(split_part(text, ' ', 3)) AS term FROM benchmark) b WHERE contains(lower(d.text), b.term)")
def vocabulary_containment(spark, sf):
    terms = table(spark, sf, "benchmark").select("item_id", F.split_part("text", F.lit(" "), F.lit(3)).alias("term"))
    return J.contains_join(docs(spark, sf).select("doc_id", "text"), terms, "text", "term").select("doc_id", "item_id")


@query()
def vector_topics(spark, sf):
    out = V.bisecting_topics(table(spark, sf, "embeddings"), 8, "embedding")
    return out.groupBy("topic").agg(F.count("*").alias("rows"))


@query(f"WITH {TOKENS} SELECT doc_id, array_to_string(tokens[greatest(p - 8, 1):p + 8], ' ') AS context FROM (SELECT doc_id, tokens, list_position(tokens, 'the') AS p FROM t) WHERE p > 0")
def token_context(spark, sf):
    at = F.array_position("tokens", "the")
    rows = tokenised(spark, sf).withColumn("p", at).where("p > 0")
    start = F.greatest(F.col("p") - 8, F.lit(1))
    return rows.select("doc_id", F.array_join(F.slice("tokens", start.cast("int"), (F.col("p") + 9 - start).cast("int")), " ").alias("context"))


# -- words, topics and text forms -------------------------------------------------------------------------------------

SYLLABLES = ["tion", "ing", "ent", "the", "ung", "heit", "ción", "eau", "er", "en"]


@query(f"WITH {TOKENS}, c AS (SELECT lang, term, count(*) AS tf FROM (SELECT lang, unnest(tokens) AS term FROM t) GROUP BY ALL), s AS (SELECT lang, sum(tf) AS words FROM c GROUP BY lang), f AS (SELECT term, sum(tf) AS f FROM c GROUP BY term HAVING sum(tf) >= 5), w AS (SELECT lang, term, round_even(tf / words * ln(1 + (SELECT avg(words) FROM s) / f), 6) AS weight FROM c JOIN s USING (lang) JOIN f USING (term)) SELECT lang, term, weight, CAST(row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS INTEGER) AS place FROM w QUALIFY row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) <= 10")
def class_keywords(spark, sf):
    return C.class_keywords(tokenised(spark, sf), "lang", 10, min_df=5)


_GRAMS = "list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: array_to_string(tokens[i:i + 1], ' ')))"


@query(f"WITH {TOKENS}, n AS (SELECT count(*) AS n FROM t), x AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_GRAMS}) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM x GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.85 * (SELECT n FROM n)), w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT n FROM n)) / (1.0 + df)) + 1) AS w FROM x JOIN df USING (term)), v AS (SELECT term, round_even(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w), s AS (SELECT term, round_even(sum(weight) / (SELECT n FROM n), 6) AS mean_weight FROM v GROUP BY term) SELECT 'all' AS pool, term, mean_weight, CAST(row_number() OVER (ORDER BY mean_weight DESC, term) AS INTEGER) AS place FROM s QUALIFY row_number() OVER (ORDER BY mean_weight DESC, term) <= 50")
def keyword_candidates(spark, sf):
    rows = tokenised(spark, sf).withColumn("pool", F.lit("all"))
    return C.group_keywords(rows, "pool", 50, min_df=3, max_df=0.85, grams=2)


@query(f"WITH {TOKENS}, n AS (SELECT count(*) AS n FROM t), x AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM x GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.1 * (SELECT n FROM n)), w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT n FROM n)) / (1.0 + df)) + 1) AS w FROM x JOIN df USING (term)), v AS (SELECT doc_id, term, round_even(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w), p AS (SELECT q.doc_id, v.doc_id AS nearest, round_even(sum(q.weight * v.weight), 6) AS s FROM v q JOIN v USING (term) WHERE q.doc_id % 100 = 0 AND v.doc_id % 100 <> 0 GROUP BY ALL), b AS (SELECT doc_id, arg_min((nearest, s), (-s, nearest)) AS b FROM p GROUP BY doc_id) SELECT doc_id, b[1] AS nearest, coalesce(b[2], 0.0) AS similarity FROM (SELECT doc_id FROM documents WHERE doc_id % 100 = 0) LEFT JOIN b USING (doc_id)")
def text_redundancy(spark, sf):
    rows = tokenised(spark, sf)
    return C.max_text_similarity(rows.where("doc_id % 100 = 0"), rows.where("doc_id % 100 <> 0"), min_df=2, max_df=0.1)


@query(f"WITH {DOCS} SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '{'|'.join(sorted(SYLLABLES, key=lambda w: (-len(w), w)))}|[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]'), ' ') AS words FROM d")
def dictionary_words(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.dictionary_tokens(F.lower("text"), SYLLABLES), " ").alias("words"))


@query(f"WITH {_E}, s AS (SELECT vec_id, label, list_transform(e, lambda x: x) AS e FROM e), d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.e, b.e) ** 2) AS s, count(*) AS n FROM s a JOIN s b ON true GROUP BY ALL), k AS (SELECT label, count(*) AS n FROM e GROUP BY label), i AS (SELECT vec_id, max(CASE WHEN own = other AND d.n > 1 THEN s / (d.n - 1) WHEN own = other THEN 0 END) AS a, min(CASE WHEN own <> other THEN s / d.n END) AS b, max(CASE WHEN own = other THEN d.n END) AS size FROM d GROUP BY vec_id) SELECT round_even(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM i")
def silhouette_score(spark, sf):
    value = V.silhouette(table(spark, sf, "embeddings"), "label", "embedding", "euclidean")
    return spark.createDataFrame([(float(value),)], "v double").select(A.r6(F.col("v")).alias("silhouette"))


@query(f"WITH {DOCS} SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\\S+', ' ', 'g'), '[^\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS zh, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\\S+', ' ', 'g'), '[^\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}\\x{{ff10}}-\\x{{ff19}}A-Za-z0-9ー]', ' ', 'g'), '\\s+', ' ', 'g')) AS ja FROM d")
def clean_other(spark, sf):
    return docs(spark, sf).select("doc_id", T.clean_zh("text").alias("zh"), T.clean_ja("text").alias("ja"))


@query(f"WITH {DOCS} SELECT doc_id, regexp_replace('1. - ' || text[1:100], '^[\\d.\\-*\\s]+', '') AS bare, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-zA-Z'']+'), lambda w: NOT list_contains({CORE!r}, w) AND NOT regexp_full_match(w, '[0-9]+')), ' ') AS kept FROM d")
def bare_words(spark, sf):
    kept = T.without(T.tokens("text", F.lit("en")), CORE)
    return docs(spark, sf).select("doc_id", T.strip_list_marker(F.concat(F.lit("1. - "), F.substring("text", 1, 100))).alias("bare"), F.array_join(kept, " ").alias("kept"))


@query(f"WITH {DOCS} SELECT DISTINCT text FROM d WHERE regexp_matches(text, '(?i){'|'.join(KEYWORDS)}') AND length(text) <= 300")
def keyword_regex(spark, sf):
    return J.keyword_regex_filter(docs(spark, sf), KEYWORDS)


@query(f"WITH {DOCS}, s AS (SELECT doc_id, lang, {SQUEEZE.format('text')} AS s FROM d) SELECT doc_id, json_object('context', s[1:220], 'lang', lang, 'predicate', split_part(s, ' ', 1)[1:120], 'target', lower(split_part(s, ' ', 2))[1:80]) AS key FROM s")
def classification_keys(spark, sf):
    word = lambda k: F.split_part(T.normalise("text"), F.lit(" "), F.lit(k))
    return docs(spark, sf).select("doc_id", T.classification_key(word(1), "text", "lang", word(2)).alias("key"))


@query(f"WITH {DOCS} SELECT doc_id, array_to_string(list_filter(list_transform(string_split(source || ', ' || lang || ',,' || source, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS listed, array_to_string([source, lang], '|') AS quoted FROM d")
def entity_lists(spark, sf):
    comma = F.concat("source", F.lit(", "), "lang", F.lit(",,"), "source")
    printed = F.concat(F.lit("['"), "source", F.lit("', \""), "lang", F.lit('"]'))
    return docs(spark, sf).select("doc_id", F.array_join(T.entity_list(comma), "|").alias("listed"), F.array_join(T.entity_list(printed), "|").alias("quoted"))


@query(f"WITH {DOCS} SELECT doc_id, lang, n_chars FROM d ORDER BY n_chars DESC, lang, doc_id LIMIT 100")
def longest_documents(spark, sf):
    return docs(spark, sf).orderBy(F.desc("n_chars"), "lang", "doc_id").limit(100).select("doc_id", "lang", "n_chars")


# -- sources and sinks ------------------------------------------------------------------------------------------------


def _written(spark, sf):
    """Rows to write, and a folder for them that all machines share."""
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), f"{checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, text FROM documents")
def csv_round_trip(spark, sf):
    rows, folder = _written(spark, sf)
    writers.write_csv(rows, folder)
    return readers.read_csv(spark, folder, strings=True)


@query("SELECT doc_id, lang, source, text FROM documents")
def jsonl_round_trip(spark, sf):
    rows, folder = _written(spark, sf)
    writers.write_jsonl(rows, folder)
    return spark.read.schema(rows.schema).json(folder)


@query("SELECT doc_id, source FROM documents")
def appended_new(spark, sf):
    rows, folder = _written(spark, sf)
    rows = rows.select("doc_id", "source")
    writers.append_new(rows.where("doc_id % 3 = 0"), folder, "doc_id")
    writers.append_new(rows, folder, "doc_id")
    return spark.read.parquet(folder)


@query("SELECT source AS key, CAST(max(CASE WHEN doc_id % 2 = 0 THEN doc_id + 1000000 ELSE NULL END) AS VARCHAR) AS value FROM documents GROUP BY source HAVING max(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) = 1 UNION ALL SELECT source, CAST(max(doc_id) AS VARCHAR) FROM documents GROUP BY source HAVING max(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) = 0")
def cached_values(spark, sf):
    rows, folder = _written(spark, sf)
    cache = writers.KeyedCache(spark, folder)
    cache.put(rows.groupBy(F.col("source").alias("key")).agg(F.max("doc_id").cast("string").alias("value")))
    cache.put(rows.where("doc_id % 2 = 0").groupBy(F.col("source").alias("key")).agg((F.max("doc_id") + 1_000_000).cast("string").alias("value")))
    return cache.load()


@query(f"SELECT text, length(text) AS char_count FROM documents WHERE length(text) BETWEEN 1 AND 250 AND ({' OR '.join(f"contains(text, '{k}')" for k in KEYWORDS)})")
def filtered_texts(spark, sf):
    return readers.filtered_corpus(docs(spark, sf), KEYWORDS)


@query("SELECT 'documents' AS dataset, 'xx' AS lang, text AS content FROM documents UNION ALL SELECT 'benchmark', 'en', text FROM benchmark")
def registry_rows(spark, sf):
    entries = [("documents", "xx"), ("benchmark", "en")]
    return readers.read_registry(spark, [{"name": name, "path": f"{sf}/{name}.parquet", "column": "text", "lang": lang} for name, lang in entries])


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(?:script|style)\b[^>]*(?:>|\z).*?(?:</(?:script|style)\s*>|\z)|<!--.*?(?:-->|\z)', ' ', 'g'), '<[A-Za-z!/?][^>]*(?:>|\z)', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\s+', ' ', 'g')) AS visible FROM pages".replace('\\"', '"'))
def page_texts(spark, sf):
    return table(spark, sf, "pages").select("page_id", readers.page_text("html").alias("visible"))


_WORD1 = f"split_part({SQUEEZE.format('text')}, ' ', 1)"
_EDGE = "[\\s.,;:!?、。，；：！？「」『』（）()\\[\\]【】…]+"


@query(f"WITH w AS (SELECT doc_id, trim(regexp_replace(regexp_replace({_WORD1}, '^{_EDGE}', ''), '{_EDGE}$', '')) AS bare FROM documents) SELECT doc_id, CASE WHEN length(bare) BETWEEN 2 AND 40 AND lower(bare) NOT IN ('the', 'les') THEN bare END AS entity FROM w")
def clean_entities(spark, sf):
    word = F.split_part(T.normalise("text"), F.lit(" "), F.lit(1))
    return docs(spark, sf).select("doc_id", match.clean_entity(word, "lang", ["the"], ["Les"]).alias("entity"))


@query(f"SELECT doc_id, regexp_replace(lower({_WORD1}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]+', '', 'g') AS form FROM documents")
def fingerprints(spark, sf):
    return docs(spark, sf).select("doc_id", T.fingerprint(F.split_part(T.normalise("text"), F.lit(" "), F.lit(1)), "lang").alias("form"))


@query("SELECT doc_id, source || lang || ',zz' AS kept FROM documents")
def distinct_entities(spark, sf):
    entity = lambda text: F.struct(text.alias("text"), F.lit("NAME").alias("label"), F.lit("ner").alias("source"))
    found = F.array(entity(F.col("source")), entity(F.col("lang")), entity(F.concat("source", "lang")), entity(F.upper("source")), entity(F.lit("zz")))
    return docs(spark, sf).select("doc_id", F.array_join(F.transform(match.dedup_entities(found), lambda e: e["text"]), ",").alias("kept"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN lang END AS first, CASE WHEN doc_id % 5 > 0 THEN source END AS second, CASE WHEN doc_id % 3 > 0 THEN source || '/' || lang ELSE '' END AS entities FROM documents")
def reply_values(spark, sf):
    rows = docs(spark, sf)
    answer = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit('Sure:\n```json\n{"1": "'), "lang", F.lit('",\n "2": "'), "source", F.lit('"}\n```'))).otherwise(F.lit("{broken"))
    listed = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit('Found [{"text": " '), "source", F.lit(' ", "category": "'), "lang", F.lit('"}, {"category": "X"}].'))).otherwise(F.lit("nothing"))
    said = rows.select("doc_id", replies.reply_map(answer).alias("m"), replies.reply_entities(listed).alias("e"))
    return said.select("doc_id", F.element_at("m", F.lit("1")).alias("first"), F.element_at("m", F.lit("2")).alias("second"), F.array_join(F.transform("e", lambda x: F.concat_ws("/", x["text"], x["label"])), ",").alias("entities"))


@query("WITH n AS (SELECT lang, count(*) AS n, 1.96 * 1.96 * 0.25 / (0.03 * 0.03) AS n0 FROM documents GROUP BY lang) SELECT lang, n AS rows, least(CAST(ceil(CAST(n0 AS DOUBLE) / (1 + (CAST(n0 AS DOUBLE) - 1) / n)) AS BIGINT), n) AS needed FROM n")
def annotation_sizes(spark, sf):
    counts = A.value_counts(docs(spark, sf), "lang").collect()  # a row per language
    return spark.createDataFrame([(r["lang"], r["count"], S.sample_size(r["count"])) for r in counts], "lang string, rows long, needed long")


@query("SELECT conv_id, turn, CASE WHEN lower(trim(role)) IN ('user') THEN 1 ELSE 0 END AS label, turn / 10.0 AS prob FROM conversations")
def vote_rules(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.vote_rule("role", F.col("turn") / 10.0, ["User"]).alias("v")).select("conv_id", "turn", "v.label", "v.prob")


@query(f"SELECT round_even(avg(f1), 6) AS mean, round_even(stddev_pop(f1), 6) AS sd, count(f1) AS folds FROM ({SQL['confusion_f1']})")
def fold_f1(spark, sf):
    return S.fold_summary(confusion_f1(spark, sf), "f1")


# -- layers and streams -----------------------------------------------------------------------------------------------

GAZETTEER = [("the", "article"), ("erthe", "noun"), ("que", "particle"), ("und", "particle")]
RULES = match.Rules({"moral_accusation": ["tion"], "institutional_rot": ["ment"]}, ["the"], [], {"en": r"\b(?:re|ha)\w*\b"})


def _who(spark, sf):
    return stages.who_entities(docs(spark, sf), GAZETTEER).drop("text")


@query()
def who_targets(spark, sf):
    return X.who_rows(stages.who_targets(cut(_who(spark, sf))))


@query()
def how_expressions(spark, sf):
    rows = docs(spark, sf)
    vocabulary = cut(stages.topic_vocabulary(stages.who_summary(cut(_who(spark, sf)))))
    return X.how_summary(cut(stages.how_labels(rows, vocabulary, RULES).drop("text")))


@query(f"WITH {DOCS}, n AS (SELECT *, lower({SQUEEZE.format('text')}) AS s FROM d), p AS (SELECT doc_id, split_part(s, ' ', 1) AS pred, s[1:220] AS ctx, lang FROM n) SELECT doc_id, CASE WHEN pred = '' OR (regexp_full_match(pred, '[a-z'']+') AND length(pred) <= 2) OR (length(pred) = 1 AND NOT regexp_matches(pred, '[a-z]')) THEN 'noise' WHEN (contains(pred, 'tion') OR contains(ctx, 'tion') OR contains(pred, 'ment') OR contains(ctx, 'ment')) THEN CASE WHEN contains(pred || ctx, 'tion') OR contains(ctx, 'tion') THEN 'moral_accusation' ELSE 'institutional_rot' END WHEN pred = 'the' OR (len(regexp_extract_all(pred, '[a-z'']+')) > 0 AND len(list_filter(regexp_extract_all(pred, '[a-z'']+'), lambda w: w <> 'the')) = 0) THEN 'noise' ELSE 'other' END AS frame FROM p")
def rule_frames(spark, sf):
    rows = docs(spark, sf)
    return rows.select("doc_id", match.frame_of(F.split_part(T.normalise("text"), F.lit(" "), F.lit(1)), "text", F.lit(""), "lang", RULES).alias("frame"))


@query("SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_first_seen(spark, sf):
    """Distinct (user, type) pairs by a stream with its state and sink in the shared folder."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*") if not sf.startswith("viewfs") else spark.readStream.schema(schema).parquet(f"{sf}/events.parquet")
    seen = incremental.first_seen(stream.select("user_id", "event_type"), ["user_id", "event_type"])
    incremental.append_to(seen, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


def _stream(spark, sf, name):
    """A table as a stream, and a folder for its sink and state that all machines share."""
    schema = table(spark, sf, name).schema
    path = f"{sf}/{name}.parquet" + ("" if sf.startswith("viewfs") else "*")
    return spark.readStream.schema(schema).parquet(path), f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@query(f"SELECT doc_id, length(text) AS char_count FROM documents WHERE length(text) BETWEEN 1 AND 250 AND ({' OR '.join(f"contains(text, '{k}')" for k in KEYWORDS)})")
def stream_filtered(spark, sf):
    stream, folder = _stream(spark, sf, "documents")
    incremental.append_to(incremental.filtered(stream, KEYWORDS), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "char_count")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 20")
def stream_quota(spark, sf):
    """The first 20 documents of each language, counted in the stream's state."""
    stream, folder = _stream(spark, sf, "documents")
    incremental.append_until(stream.select("doc_id", "lang"), f"{folder}/out", f"{folder}/state", 20, "lang", "doc_id").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS chars, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def stream_shard_lines(spark, sf):
    """The documents written as JSON lines, half of them gzipped, and streamed back from the shards by ranges of bytes."""
    folder = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    rows = spread(table(spark, sf, "documents")).where("text is not null").select("doc_id", "lang", "text")
    for name, half in (("none", "doc_id % 2 = 0"), ("gzip", "coalesce(doc_id % 2, 1) <> 0")):
        rows.where(half).write.option("compression", name).option("ignoreNullFields", False).json(f"{folder}/{name}")
    urls = sorted(r["path"] for name in ("none", "gzip") for r in spark.read.format("binaryFile").load(f"{folder}/{name}").select("path").collect())  # a row a file
    lines = shards.stream_shards(spark, urls).select(F.from_json("line", "doc_id long, lang string, text string").alias("d"))
    found = lines.select("d.doc_id", "d.lang", F.char_length("d.text").alias("chars"), F.md5("d.text").alias("digest"))
    incremental.append_to(found, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN -1 ELSE n_chars % 2 END AS label FROM documents")
def stream_labels(spark, sf):
    """Documents that have a label already (a fourth of them) are not labelled again."""
    stream, folder = _stream(spark, sf, "documents")
    table(spark, sf, "documents").where("doc_id % 4 = 0").select("doc_id", F.lit(-1).cast("long").alias("label")).write.parquet(f"{folder}/out")
    label = lambda todo: todo.select("doc_id", (F.col("n_chars") % 2).cast("long").alias("label"))
    incremental.append_labels(stream.select("doc_id", "n_chars"), label, f"{folder}/out", f"{folder}/state", "doc_id").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def unfinished_keys(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id")
    progress = rows.where("doc_id % 3 < 2").select("doc_id", F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("a")))).alias("path"))
    return incremental.unfinished(rows, progress, "doc_id", 2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
