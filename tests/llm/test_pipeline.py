import re

import corpus_pipeline
import pytest
import sentencepiece
from test_exact_dedup import brute as copies
from test_ngram_join import brute as near
from test_source_mix import brute as mixed

import public_tokenizers

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    rows = [(d, t, "xx", ["hot", "hot", "b", "c"][(d or 0) % 4], len(t or "")) for d, t in corpus]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    letters = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, folder)
    assert one.columns == docs.columns
    assert sorted(map(tuple, one.collect()), key=str) == sorted(letters, key=str)

    kept = {(b[0], b[4]) for b in copies([(r[0], r[1]) for r in letters]) if b[3]}
    two = stages["exact_dedup"](spark, one, folder)
    assert two.columns == docs.columns
    rest = [tuple(r) for r in two.collect()]
    assert len(rest) == len({b[4] for b in copies([(r[0], r[1]) for r in letters])}) == len({k[1] for k in kept})
    assert {r[0] for r in rest} == {k[0] for k in kept}

    three = stages["ngram_join"](spark, spark.createDataFrame(rest, COLUMNS), folder)
    left = [tuple(r) for r in three.collect()]
    assert sorted(r[0] for r in left) == sorted(b[0] for b in near([(r[0], r[1]) for r in rest]) if b[4])
    assert len(left) < len(rest) < len(letters)

    four = stages["source_mix"](spark, spark.createDataFrame(left, COLUMNS), folder)
    assert four.columns == docs.columns
    chosen = sorted(r[0] for r in mixed([(r[0], r[1], r[3]) for r in left], corpus_pipeline.MIX)[2] if r[2] == 0)
    assert sorted(r.doc_id for r in four.collect()) == chosen and 0 < len(chosen) < len(left)

    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(corpus_pipeline.PIECES)))
    text = {r[0]: r[1] for r in left}
    five = {r.doc_id: r.ids for r in stages["sentencepiece"](spark, four, folder).collect()}
    assert five == {d: library.encode(text[d]) for d in chosen}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()} == five


def test_columns_of_any_name_repeated_ids_and_rejection(spark, corpus, tmp_path):
    rows = [(d, t, "xx", "s") for d, t in corpus if d is not None][:150]
    rows += [(0, rows[40][1], "xx", "s"), (0, rows[41][1] + " more words", "xx", "s"), (3, rows[3][1], "xx", "s"), (None, rows[2][1], "xx", "s")]
    junk = [(5000 + i, "щука жила была " * (20 + i), None, "s") for i in range(5)] + [(6000, None, None, None), (6001, "² ½ 12", None, "s")]
    extra = "*, 'i' as _id, 'h' as _sha, 1 as _none, 2 as epoch, 3 as weight, 4 as block, 5 as place, 6 as n_tokens, 7 as `row`, 8 as key, 9 as component, 10 as size, 11 as digest, 12 as id"
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string").selectExpr(*extra.split(", "))
    docs, seen = df, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == df.columns
            assert {tuple(r)[4:] for r in docs.collect()} == {("i", "h", *range(1, 13))}
            seen.append({(r.doc_id, r.text) for r in docs.collect()})
            assert docs.count() == len(seen[-1]) or k == 0
    known = {(d, t) for d, t, *_ in rows if re.search(r"[^\W\d_]", t or "")}
    assert seen[0] <= known and len(known - seen[0]) <= 2 and not any((d, t) in seen[0] for d, t, *_ in junk)
    assert seen[0] > seen[1] > seen[2] > seen[3] and docs.count() == len(seen[3])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.collect() == [] and "ids" in found.columns
