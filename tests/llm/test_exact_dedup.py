import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm.exact_dedup import drop_copies, exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        for doc_id, _ in members:
            out.append((doc_id, keep, len(members), doc_id == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted(map(tuple, df.collect()), key=str)


CASES = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " \n\r\x0b\x0c"), (7, "a b"), (8, "😀 x"), (9, "😀x"), (10, "😀x"), (-11, "😀 x"), (None, "😀  x"), (12, "12"), (12, "12"), (13, "AB"), (None, "only"), (14, "long " * 30_000), (15, "long" * 30_000)]


def test_against_brute_force(docs_of):
    assert run(exact_dedup(docs_of(CASES))) == brute(CASES)


@pytest.mark.parametrize("digest", [lambda n: F.lit("same"), lambda n: F.substring(F.sha2(n, 256), 1, 1)])
def test_equal_digests_of_different_texts_stay_apart(docs_of, digest):
    rows = CASES + [(100 + i, f"text {i % 37}") for i in range(200)]
    assert [r[:4] for r in run(exact_dedup(docs_of(rows), digest=digest))] == [r[:4] for r in brute(rows)]


def test_hot_group_and_empty_table(docs_of):
    rows = [(i, "copy  " if i == 77 else "copy") for i in range(500)]
    assert {(r.keep_id, r.group_size) for r in exact_dedup(docs_of(rows)).collect()} == {(77, 500)}
    assert exact_dedup(docs_of([])).collect() == []


def test_drop_copies_keeps_one_row_of_each_text(docs_of):
    df = docs_of(CASES)
    found = drop_copies(df)
    assert found.columns == df.columns
    kept = sorted(((r.doc_id, re.sub(r"[\x20\x09-\x0D]", "", r.text or "")) for r in found.collect()), key=str)
    assert kept == sorted({(d, re.sub(r"[\x20\x09-\x0D]", "", t or "")) for (d, t), b in [((d, t), b) for d, t in CASES for b in brute(CASES) if b[0] == d and b[3] and b[4] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()]}, key=str)
    assert len({t for _, t in kept}) == len(kept) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in CASES})


def test_drop_copies_keeps_columns_of_any_name(docs_of):
    df = docs_of(CASES).selectExpr("*", "'keepme' as _id", "'me too' as _sha", "3 as id", "4 as `row`", "5 as sha", "6 as `a.b`")
    found = drop_copies(df)
    assert found.columns == df.columns
    assert {(r["_id"], r["_sha"], r["id"], r["row"], r["sha"], r["a.b"]) for r in found.collect()} == {("keepme", "me too", 3, 4, 5, 6)}
    assert found.count() == drop_copies(docs_of(CASES)).count()
    assert drop_copies(docs_of([])).collect() == []
