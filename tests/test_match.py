import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import match as M
from textloom.plans import stages
from textloom.sources import lexicons

GAZETTEER = [("red house", "group"), ("red", "colour"), ("house", "place"), ("红房子", "group"), ("房子", "place"), ("赤い家", "group"), ("Church", "body"), ("red", "other")]
RULES = M.Rules({"moral_accusation": ["liar", "骗"], "dehumanization": ["beast", "rot"]}, ["think", "确认"], ["go"], {"en": r"\b(?:lie|cheat)\w*\b", "zh": "骗取|掩盖", "ja": "騙す"})


def one(spark, expression, schema="text string, lang string", row=("", "en")):
    return spark.createDataFrame([row], schema).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "lang", "expected"),
    [
        ("The Red House and a house, redder", "en", [("Red House", "group"), ("house", "place")]),
        ("看红房子和房子", "zh", [("红房子", "group"), ("房子", "place")]),
        ("あの赤い家", "jp", [("赤い家", "group")]),
        ("", "en", []),
        (None, "en", []),
    ],
)
def test_longest_terms_first(spark, text, lang, expected):
    found = one(spark, M.gazetteer_entities(GAZETTEER, "text", "lang"), row=(text, lang))
    assert [(e["text"], e["label"]) for e in found] == expected


def test_offline_names(spark):
    assert [e["text"] for e in one(spark, M.capitalised_entities("text", "lang"), row=("yesterday Ann Lee met Bob. x", "en"))] == ["Ann Lee", "Bob"]
    assert one(spark, M.capitalised_entities("text", "lang"), row=("Ann", "zh")) == []


@pytest.mark.parametrize(
    ("text", "lang", "expected"),
    [("「Blue Hill」.", "en", "Blue Hill"), ("x", "en", None), ("THEY", "en", None), ("the thing", "en", None), ("y" * 41, "en", None), ("很长的名字的一个东西啊", "zh", None), ("走来走去说明白啊", "zh", None), ("山の会", "ja", "山の会"), ("何かしている", "ja", None), ("...", "en", None)],
)
def test_entity_cleaning(spark, text, lang, expected):
    assert one(spark, M.clean_entity(F.col("text"), "lang", ["they"], ["the thing"]), row=(text, lang)) == expected


def entities(*names):
    return F.array(*[F.struct(F.lit(n).alias("text"), F.lit("x").alias("label"), F.lit("t").alias("source")) for n in names])


def test_entity_row_dedup_and_alias(spark):
    names = lambda e: [x["text"] for x in e]
    assert names(one(spark, M.dedup_entities(entities("Church", "Catholic Church", "hill", "Hilltop", "sea")))) == ["Catholic Church", "Hilltop", "sea"]
    # what is remembered is the alias, so two forms of one alias pass the first test; the containment test then joins them
    assert names(one(spark, M.entity_row(entities("BH", "Blue H", "bh"), "lang", {"bh": "Blue Hill", "blue h": "Blue Hill"}))) == ["Blue Hill"]
    assert names(one(spark, M.entity_row(entities("Sea", "sea", "SEA."), "lang"))) == ["Sea"]
    assert names(one(spark, M.merge_entities(entities("Sea"), entities("sea", "Hill")))) == ["Sea", "Hill"]


def test_window_expressions_in_three_languages(spark):
    rows = [("Some say that Green Club members lie and cheat all day", "en", ["green club", "club"]), ("绿社 掩盖 事实 骗取 钱", "zh", ["绿社"]), ("緑会 は 騙す", "jp", ["緑会"]), ("nothing near", "en", ["club"]), (None, "en", ["club"])]
    df = spark.createDataFrame(rows, "text string, lang string, terms array<string>")
    found = [r["v"] for r in df.select(M.window_expressions("text", "lang", "terms", RULES.actions).alias("v")).collect()]
    assert [(e["target"], e["verb"], e["layer"], e["role"]) for e in found[0]] == [("green club", "lie", "window", "unknown"), ("green club", "cheat", "window", "unknown"), ("club", "lie", "window", "unknown"), ("club", "cheat", "window", "unknown")]
    assert {e["verb"] for e in found[1]} == {"掩盖", "骗取"} and {e["verb"] for e in found[2]} == {"騙す"}
    assert found[3] == found[4] == []


def test_windows_reach_eight_tokens(spark):
    words = ["w"] * 30
    words[10], words[18], words[19] = "target", "lie", "cheat"
    found = one(spark, M.window_expressions("text", "lang", F.array(F.lit("target")), RULES.actions), row=(" ".join(words), "en"))
    assert [e["verb"] for e in found] == ["lie"] and found[0]["context"].startswith("w w w") and len(found[0]["context"]) <= 150


@pytest.mark.parametrize(
    ("predicate", "context", "target", "expected"),
    [("", "x", "y", "noise"), ("go", "", "", "noise"), ("啊", "", "", "noise"), ("think", "", "", "noise"), ("think go", "", "", "noise"), ("think", "a liar", "", "moral_accusation"), ("确认", "", "", "noise"), ("build", "", "", "other"), ("beast liar", "", "", "moral_accusation"), ("carrots", "", "", "dehumanization"), ("walk", "", "beast", "dehumanization")],
)
def test_frames_in_declared_order(spark, predicate, context, target, expected):
    assert one(spark, M.frame_of("p", "c", "t", F.lit("en"), RULES), "p string, c string, t string", (predicate, context, target)) == expected


def test_word_boundaries_are_an_option(spark):
    assert one(spark, M.frame_of(F.lit("carrots"), F.lit(""), F.lit(""), F.lit("en"), RULES, word_boundary=True)) == "other"


def test_parsed_rows_beat_window_rows(spark):
    svo = [{"layer": "svo", "target": "club", "verb": "lie", "predicate": "lie to", "role": "agent", "context": "c"}]
    docs = spark.createDataFrame([(1, "club lie lie cheat", "en", 0, svo), (2, "club lie", "en", -1, [])], "doc_id long, text string, lang string, topic int, svo array<struct<layer:string,target:string,verb:string,predicate:string,role:string,context:string>>")
    found = M.expressions(docs, spark.createDataFrame([(0, ["club"]), (-1, ["club"])], "topic int, terms array<string>"), RULES).orderBy("verb").collect()
    assert [(r.doc_id, r.verb, r.layer) for r in found] == [(1, "cheat", "window"), (1, "lie", "svo")]


def test_candidates(spark):
    rows = [("伪善者", "伪善 者", 0.9, "zh"), ("seed", "seedling", 0.9, "en"), ("seed", "grain", 0.85, "en"), ("seed", "Grain!", 0.95, "en"), ("seed", "low", 0.9, "en"), ("seed", "kernel", 0.7, "en"), ("seed", "1234", 0.9, "en")]
    found = M.clean_candidates(spark.createDataFrame(rows, "seed_word string, candidate_word string, similarity double, language string"))
    assert [(r.candidate_word, r.similarity) for r in found.collect()] == [("Grain!", 0.95)]


def test_relabelling_only_touches_other(spark):
    rows = spark.createDataFrame([("a", "other"), ("b", "other"), ("c", "noise")], "classification_key string, frame_type string")
    new = spark.createDataFrame([("a", "dehumanization"), ("c", "dehumanization")], "classification_key string, frame_type string")
    assert {(r.classification_key, r.frame_type) for r in M.relabel_other(rows, new).collect()} == {("a", "dehumanization"), ("b", "other"), ("c", "noise")}


def test_vocabulary_from_summary(spark):
    s = spark.createDataFrame([(1, ["Blue Hill(5)", "X(3)", "Sea(2)", "a b(1)", "Y Z(1)", "late(1)"])], "topic int, top_targets array<string>")
    assert stages.topic_vocabulary(s).first()["terms"] == ["blue hill", "sea", "a b", "y z"]


def test_lexicons(spark, tmp_path):
    (tmp_path / "a.dic").write_bytes("%\n1\tcare.virtue\n2\tfairness.vice\n3\tother\n%\nkind*\t1\r\nunfair\t2\t1\n\nx\t1\nkind\t1\n".encode())
    (tmp_path / "b.dic").write_text("%\r01\tHarmVirtue\r02\tMoralityGeneral\r%\r優し*\t01\r善\t02\r", encoding="utf-8")
    (tmp_path / "c.csv").write_text("word,foundation,polarity,lang,note\nsteal,realistic_threat,vice,en,\nkind,care,virtue,en,\n", encoding="utf-8")
    merged = lexicons.merge_lexicons(lexicons.dotted_axes(lexicons.read_liwc(spark, str(tmp_path / "a.dic"))), lexicons.joined_axes(lexicons.read_liwc(spark, str(tmp_path / "b.dic"))), lexicons.read_lexicon_csv(spark, str(tmp_path / "c.csv")))
    found = {(r.axis, r.polarity, r.word) for r in merged.collect()}
    assert found == {("harm", "pos", "kind*"), ("harm", "pos", "unfair"), ("fairness", "neg", "unfair"), ("harm", "pos", "優し*"), ("realistic_threat", "neg", "steal")}
    df = spark.createDataFrame([("不公",), ("不",), ("恶意",), ("善良",)], "w string")
    assert [r.v for r in df.select(lexicons.infer_polarity("w", ["恶意"], ["不", "非"]).alias("v")).collect()] == ["neg", "pos", "neg", "pos"]


def test_rules_file(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"frames": {"own": ["z"], "dehumanization": ["b"], "moral_accusation": ["a"]}, "noise": ["n"]}', encoding="utf-8")
    rules = lexicons.load_rules(str(path))
    assert list(rules.frames) == ["moral_accusation", "dehumanization", "own"] and rules.noise == ["n"]


def test_gazetteer_against_brute_force(spark):
    rng = random.Random(3)
    terms = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 4))).strip() or "a" for _ in range(12)]
    texts = ["".join(rng.choice("ab") for _ in range(20)) for _ in range(60)]
    df = spark.createDataFrame([(t, "zh") for t in texts], "text string, lang string")
    found = [[(e["text"]) for e in r.v] for r in df.select(M.gazetteer_entities([(t, "k") for t in terms], "text", "lang").alias("v")).collect()]
    for text, got in zip(texts, found, strict=True):
        taken, want = [], []
        for term in sorted(dict.fromkeys(terms), key=lambda t: -len(t)):
            at = text.find(term)
            while at >= 0:
                if all(at + len(term) <= a or at >= b for a, b in taken):
                    taken.append((at, at + len(term)))
                    want.append(text[at : at + len(term)].strip())
                at = text.find(term, at + len(term))
        assert sorted(got) == sorted(want)
