import random
import re

from textloom.llm.license_scan import PHRASES, TEMPLATES, least_overlap, license_scan, templates_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    text = "".join(c.lower() if c < "\x80" else c for c in text or "")
    words = WORD.findall(text)
    base = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    own = {label for _, label in base}
    more, score = set(), 0.0
    for line in text.split("\n"):
        have = set(WORD.findall(line))
        for _, label, wanted in templates_of():
            shared = len(have & set(wanted))
            if shared >= least_overlap(len(wanted)):
                more.add(label)
                score = max(score, shared / len(wanted))
    at = [i for i, _ in base]
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)), 1.0 if base else score


def test_against_brute_force(docs_of):
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, "GNU  General-Public\nLicense"), (4, "the gnu general public licenses"), (5, "MIT License, mit license; Apache License"), (6, "CC BY-NC 4.0"), (7, "xcc by"), (8, "É Apache Ünï license\napache LICENSE")]
    noise = "foo bar the of version license free software public 2 0 in source".split()
    for i in range(500):
        lines = []
        for _ in range(rng.randint(0, 4)):
            words = rng.choice(TEMPLATES)[1].split()
            words = [w for w in words if rng.random() > rng.choice([0, 0.1, 0.3, 0.5])] + [rng.choice(noise) for _ in range(rng.randint(0, 5))]
            if rng.random() < 0.3:
                rng.shuffle(words)
            lines.append(rng.choice([" ", ", ", "-"]).join(w.upper() if rng.random() < 0.2 else w for w in words))
        rows.append((100 + i, "\n".join(lines)))
    rows += [(None, "mit license"), (9000, "mit license"), (9000, "mit license"), (9001, "word " * 50_000 + "\nLicensed under the MIT License")]
    found = sorted(map(tuple, license_scan(docs_of(rows)).collect()), key=str)
    assert found == sorted([(d, *brute(t)) for d, t in rows], key=str)
    assert sum(bool(r[6]) and not r[5] for r in found) > 20
    assert license_scan(docs_of([])).collect() == []


def test_wrapped_notices(docs_of, spark, tmp_path):
    import textwrap

    from textloom.llm.license_scan import SPAN
    from textloom.llm.queries import op2_license_scan

    rng = random.Random(3)
    rows, wanted = [], {}
    for i, (label, text) in enumerate(TEMPLATES):
        for k, width in enumerate((1, 24, 48, 76)):
            lines = ["copyright " * rng.randint(0, 9) + "2020"] * rng.randint(0, 2) + textwrap.wrap("and then " * rng.randint(0, 40) + text, width, break_long_words=False)
            rows.append((10 * i + k, rng.choice(["\n", "\n * ", "\n\n"]).join(lines).upper() + "\nend"))
            wanted[10 * i + k] = label
    rows += [(1000, "redistribution and use in source and binary forms\n" + "word " * SPAN + "\nwith or without modification are permitted provided that the following conditions are met"), (1001, ""), (1002, None)]
    rows += [(2000 + i, "\n".join(" ".join(w for w in rng.choice(TEMPLATES)[1].split() if rng.random() > 0.3) for _ in range(rng.randint(1, 5)))) for i in range(200)]

    def brute_windows(text):
        lines = [w for w in map(WORD.findall, (text or "").lower().split("\n")) if w]
        found = {}
        for i, own in enumerate(lines):
            have = set(own + [w for line in lines[i + 1 :] for w in line][:SPAN])
            for _, label, words in templates_of():
                shared = len(have & set(words))
                if shared >= least_overlap(len(words)):
                    found[label] = max(found.get(label, 0), shared / len(words))
        return found

    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in op2_license_scan(spark, str(tmp_path)).collect()}
    assert all(label in found[d].labels.split(",") for d, label in wanted.items()) and found[1000].labels == ""
    for d, text in rows:
        own, base, more = found[d], brute(text), brute_windows(text)
        assert own.labels == ",".join(sorted({x for x in base[4].split(",") if x} | set(more))) and own.score == (1.0 if base[1] else max(more.values(), default=0.0))
    plain = {r.doc_id: r.labels for r in license_scan(docs_of(rows)).collect()}
    assert sum(label not in plain[d].split(",") for d, label in wanted.items()) > 20
