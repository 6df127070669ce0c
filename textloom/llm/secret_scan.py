"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base kinds: pattern and the least length of the group that counts. Fixed by the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Bits that the best window of a candidate must reach, by its class of characters.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
# Candidates that are no secrets, whatever their entropy: UUIDs, placeholders, paths and slugs of words, alphabets.
ALLOWED = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"(?i).*(?:example|placeholder|changeme|dummy|xxxx|0123456789|abcdefgh).*",
    r"(?:[A-Za-z]+|[0-9]{1,4})(?:[-_/=+](?:[A-Za-z]+|[0-9]{1,4})?)*",
    r"[0-9_/=+-]+",
)
# The third of these with possessive repeats, which match the same and on which Java's engine doesn't recurse.
_SLUG = r"(?:[A-Za-z]++|[0-9]{1,4}+)(?:[-_/=+](?:[A-Za-z]++|[0-9]{1,4}+)?+)*+"
_GRAMS = 80  # characters from '+' (43) to 'z' (122)
_BLOCK = 256


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, although the body uses it many times."""
    return F.transform(F.array(value), body)[0]


def spans_of(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches, in code points, end exclusive.

    The matches and the stretches between them alternate, so a start is a sum of lengths; sums are taken over blocks,
    which keeps the work near-linear in the matches of a text.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(steps: Column) -> Column:
        n = F.size(steps)
        length = lambda s, x: s + x["g"] + x["m"]
        totals = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(steps, b * _BLOCK + 1, _BLOCK), F.lit(0).cast("long"), length))

        def with_offsets(offsets: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                block = F.floor(i / _BLOCK).cast("int")
                before = F.aggregate(F.slice(steps, block * _BLOCK + 1, i % _BLOCK), F.lit(0).cast("long"), length)
                start = F.get(offsets, block) + before + x["g"]
                return F.struct(start.alias("start"), (start + x["m"]).alias("end"), x["match"].alias("match"))

            return F.transform(steps, span)

        return bind(totals, lambda t: bind(F.transform(t, lambda _, i: F.aggregate(F.slice(t, F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x)), with_offsets))

    def steps(matches: Column) -> Column:
        between = F.slice(gaps, F.lit(1), F.size(matches))
        return F.zip_with(matches, between, lambda m, g: F.struct(F.char_length(g).cast("long").alias("g"), F.char_length(m).cast("long").alias("m"), m.alias("match")))

    return bind(found, lambda m: F.when(F.size(m) > 0, bind(steps(m), placed)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")))


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits) of the windows of a string; -1 if it is shorter than a window.

    A window's entropy is log2(w) - sum(c log2 c) / w over its counts c. The fold keeps the counts and the sum; a step
    adds the character that enters and takes off the one that leaves.
    """
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c) - 43)

    def fold(codes: Column) -> Column:
        start = F.struct(F.array_repeat(F.lit(0), _GRAMS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))

        def step(state: Column, i: Column) -> Column:
            enters, leaves, full = F.get(codes, i), F.get(codes, i - window), i >= window
            c = F.get(state["counts"], enters)
            d = F.get(state["counts"], leaves) + F.when(enters == leaves, 1).otherwise(0)
            total = state["sum"] + (F.get(table, c + 1) - F.get(table, c)) + F.when(full, F.get(table, d - 1) - F.get(table, d)).otherwise(0.0)
            counts = F.transform(state["counts"], lambda v, k: (v + F.when(k == enters, 1).otherwise(0) - F.when(full & (k == leaves), 1).otherwise(0)).cast("int"))
            entropy = F.lit(math.log2(window)) - total / window
            best = F.when(i >= window - 1, F.greatest(state["best"], entropy)).otherwise(state["best"])
            return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: s["best"])

    return bind(codes, fold)


def outside(candidates: Column, assigned: Column, whole: Column) -> Column:
    """The candidates that lie in no base span, in time linear in both.

    A candidate is a longest run of its characters, and so is an access key or a hex string of some of them: one of
    those holds a candidate only if it is the same span. An assignment may hold several; they are the runs that are
    found in its match alone. So spans are compared as strings of start and match, by a hash set.
    """
    key = lambda start, s: F.concat_ws(":", start.cast("string"), s["match"])
    inner = F.flatten(F.transform(assigned, lambda a: F.transform(spans_of(a["match"], CANDIDATE), lambda s: key(a["start"] + s["start"], s))))
    left = F.array_except(F.transform(candidates, lambda s: key(s["start"], s)), F.concat(inner, F.transform(whole, lambda s: key(s["start"], s))))

    def span(k: Column) -> Column:
        start, match = F.substring_index(k, ":", 1).cast("long"), F.substring_index(k, ":", -1)
        return F.struct(start.alias("start"), (start + F.char_length(match)).alias("end"), match.alias("match"))

    return F.when(F.size(candidates) > 0, F.transform(left, span)).otherwise(candidates)


def _named(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy. No shuffle, no Python.

    spans lists kind:start:end of the whole matches by start. A candidate (a run of 20 or more key characters with a
    letter and a digit) is a span of kind `entropy` if one of its windows reaches the threshold of its class
    (hex, alnum, base64), no allow-list pattern matches all of it, and it doesn't lie in a base span.

    Long texts and long candidates are scanned whole, in time about linear in them and without recursion.

    Cases: null text = empty text = no spans, the digest of the empty string; a null id is returned as it is; repeated
    rows are scanned each; spans of one start are listed in the order assign, access, hex, entropy; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    limits = thresholds or THRESHOLDS
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    value = lambda s: F.regexp_extract(s["match"], ASSIGN, 2)
    rows = rows.select("doc_id", F.filter(spans_of(F.col("t"), ASSIGN), lambda s: F.char_length(value(s)) >= 6).alias("a"), spans_of(F.col("t"), ACCESS).alias("k"), spans_of(F.col("t"), HEX).alias("h"), spans_of(F.col("t"), CANDIDATE).alias("c"))
    base = F.concat(_named(F.col("a"), "assign", 0), _named(F.col("k"), "access", 1), _named(F.col("h"), "hex", 2))
    free = outside(F.col("c"), F.col("a"), F.concat("k", "h"))
    rows = rows.select("doc_id", F.size("a").cast("long").alias("n_assign"), F.size("k").cast("long").alias("n_access"), F.size("h").cast("long").alias("n_hex"), base.alias("base"), free.alias("c"))

    def suspicious(s: Column) -> Column:
        m = s["match"]
        limit = F.when(m.rlike("^[0-9a-fA-F]+$"), limits["hex"]).when(m.rlike("^[A-Za-z0-9]+$"), limits["alnum"]).otherwise(limits["base64"])
        allowed = F.lit(False)
        for pattern in (*ALLOWED[:2], _SLUG, *ALLOWED[3:]):
            allowed = allowed | m.rlike(f"^(?:{pattern})$")
        mixed = m.rlike("[A-Za-z]") & m.rlike("[0-9]")
        return F.when(mixed & ~allowed, window_entropy(m) >= limit).otherwise(False)

    more = F.filter("c", suspicious)
    rows = rows.select("doc_id", "n_assign", "n_access", "n_hex", "base", _named(more, "entropy", 3).alias("more"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_entropy"))


def sql(thresholds: dict[str, float] | None = None) -> str:
    """DuckDB SQL of secret_scan(): spans from split gaps, and each window's entropy by itself."""
    limits = thresholds or THRESHOLDS
    quoted = lambda pattern: pattern.replace("'", "''")

    def spans(pattern: str) -> str:
        found, gaps = f"regexp_extract_all(t, '{quoted(pattern)}')", f"string_split_regex(t, '{quoted(pattern)}')"
        return f"list_transform(range(1, len({found}) + 1), lambda i: {{'m': {found}[i], 'a': CAST(list_sum(list_transform({gaps}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({found}[1:i - 1], lambda x: length(x))), 0) AS BIGINT)}})"

    kinds = {"assign": spans(ASSIGN), "access": spans(ACCESS), "hex": spans(HEX), "entropy": spans(CANDIDATE)}
    rows = " UNION ALL ".join(f"SELECT rid, t, {k} AS o, '{name}' AS kind, unnest({body}) AS s FROM d" for k, (name, body) in enumerate(kinds.items()))
    allowed = " OR ".join(f"regexp_full_match(m, '{quoted(p)}')" for p in ALLOWED)
    chars = f"string_split(m[i:i + {WINDOW - 1}], '')"
    best = f"list_max(list_transform(range(1, length(m) - {WINDOW - 2}), lambda i: {math.log2(WINDOW)!r}::DOUBLE - list_sum(list_transform({chars}, lambda c: log2(len(list_filter({chars}, lambda e: e = c))))) / {WINDOW}))"
    limit = f"CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') THEN {limits['hex']} WHEN regexp_full_match(m, '[A-Za-z0-9]+') THEN {limits['alnum']} ELSE {limits['base64']} END"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
raw AS ({rows}),
sp AS (SELECT rid, o, kind, s.m AS m, s.a AS a, s.a + length(s.m) AS e FROM raw),
base AS (SELECT rid, o, kind, m, a, e FROM sp WHERE o IN (1, 2) OR (o = 0 AND length(regexp_extract(m, '{quoted(ASSIGN)}', 2)) >= 6)),
cand AS (SELECT * FROM sp WHERE o = 3 AND regexp_matches(m, '[A-Za-z]') AND regexp_matches(m, '[0-9]') AND NOT ({allowed}) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = sp.rid AND b.a <= sp.a AND sp.e <= b.e)),
more AS (SELECT rid, o, kind, m, a, e FROM cand WHERE {best} >= {limit}),
b AS (SELECT rid, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, o) AS line FROM base GROUP BY rid),
m AS (SELECT rid, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, o) AS line, count(*) FILTER (o = 3) AS n_entropy FROM (FROM base UNION ALL FROM more) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.line, '')) AS base_sha256, coalesce(m.line, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM d LEFT JOIN b USING (rid) LEFT JOIN m USING (rid)
"""
