import difflib
import glob
import os
import random

import numpy as np
import pytest

from textloom.operators.overlap import common, near_copies, places
from textloom.operators.quantiles import exact_quantiles
from textloom.sources import arrays
from textloom.streaming import incremental


def texts(seed=3, n=140):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    for i in range(0, 60):
        t = list(out[i % 20])
        for _ in range(rng.randint(0, max(1, len(t) // 6))):
            if t:
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "yz"])
        out.append("".join(t))
    return [*out, "", "", "a", out[0], "日本語" * 50]


@pytest.mark.parametrize(("threshold", "chars"), [(0.85, 2_000_000), (0.6, 700)])
def test_near_copies_against_all_pairs(spark, threshold, chars):
    rows = [*enumerate(texts()), (500, None), (None, "a"), (0, "other row of an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.held, r.train, round(r.ratio, 9)) for r in near_copies(df.where("doc_id % 5 = 0"), df, "doc_id", "doc_id", threshold=threshold, chars=chars).collect())
    usable = [r for r in rows if r[0] is not None and r[1] is not None]
    want = [(i, j, round(difflib.SequenceMatcher(None, a, b).ratio(), 9)) for i, a in usable if i % 5 == 0 for j, b in usable if i != j]
    assert found == sorted(w for w in want if w[2] > threshold)
    assert len(found) > 20


def test_common_subsequences():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        assert common(places(a), len(a), b, 0) == row[-1]
        assert (common(places(a), len(a), b, row[-1] + 1) <= row[-1] + len(b)) and common(places(a), len(a), b, row[-1]) == row[-1]


@pytest.mark.parametrize(("local", "buckets"), [(50_000, 1024), (3, 4)])
def test_quantiles_of_hot_groups(spark, local, buckets):
    rng = np.random.default_rng(9)
    groups = {"a": rng.normal(size=301), "b": np.concatenate([np.full(200, 7.0), rng.normal(size=99) * 1e-9 + 7]), None: np.array([1.0, 2.0]), "c": np.array([-1e308, 1e308, 5.0]), "d": np.array([4.0]), "e": rng.integers(0, 3, 100).astype(float)}
    rows = [(g, float(v), "x") for g, vs in groups.items() for v in vs] + [("f", None, "x"), ("a", float("nan"), "x"), ("a", float("inf"), "x"), ("a", None, "x")]
    df = spark.createDataFrame(rows, "g string, value double, q string")
    shares = {"low": 0.0, "q1": 0.25, "q2": 0.5, "p95": 0.95, "high": 1.0}
    found = {r.g: r for r in exact_quantiles(df, ["g"], "value", shares, local, buckets).collect()}
    assert set(found) == {*groups, "f"}
    assert all(found["f"][k] is None for k in shares)
    for g, vs in groups.items():
        for k, p in shares.items():
            assert found[g][k] == pytest.approx(float(np.quantile(vs / 2, p)) * 2, rel=1e-12, abs=1e-300)
    assert exact_quantiles(df.limit(0), ["g"], "value", shares).collect() == []


def test_arrays_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    kept = {"plain": rng.normal(size=(1000, 7)), "columns": np.asfortranarray(rng.normal(size=(300, 5)).astype(np.float32)), "cube": rng.integers(0, 9, (40, 3, 2)), "flat": np.arange(9, dtype=np.int16), "none": np.zeros((0, 4))}
    for name, x in kept.items():
        np.save(tmp_path / f"{name}.npy", x)
    (tmp_path / "other.txt").write_text("no array")
    for part in (64 << 20, 2000):
        rows = arrays.read_npy(spark, str(tmp_path), part).collect()
        for name, x in kept.items():
            own = np.array([r.vector for r in sorted((r for r in rows if r.name == name), key=lambda r: r.row)])
            want = x.reshape(1 if x.ndim < 2 else len(x), int(np.prod(x.shape[1:])) if x.ndim > 1 else len(x)).astype(float)
            assert own.size == want.size and (own.reshape(want.shape) == want).all()
    with pytest.raises(Exception, match="not a .npy"):
        arrays.NpyReader(str(tmp_path / "other.txt"), 10).partitions()


def test_a_file_of_three_gigabytes_is_planned_by_its_head(spark, tmp_path):
    path = tmp_path / "large.npy"
    rows, width = 6_000_000, 64
    with open(path, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": (rows, width)})
        first = f.tell()
        f.truncate(first + rows * width * 8)  # sparse
        f.seek(first + (rows - 1) * width * 8)
        f.write(np.arange(width, dtype=np.float64).tobytes())
    parts = arrays.NpyReader(str(path), arrays.PART_BYTES).partitions()
    assert len(parts) == 46 and parts[-1].stop == rows
    assert all(a.stop == b.start for a, b in zip(parts[:-1], parts[1:], strict=True))
    last = list(arrays.NpyReader(str(path), arrays.PART_BYTES).read(arrays.Stretch(str(path), rows - 2, rows)))
    assert last[0].column(2).to_pylist() == [[0.0] * width, list(map(float, range(width)))]


def _ids(spark, folder):
    return sorted(r.id for r in spark.read.schema("id long, lang string").parquet(folder).collect())


def test_quota_goes_on_after_a_restart(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def come(ids):
        spark.createDataFrame([(i, [None, "en"][i % 2]) for i in ids], "id long, lang string").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = incremental.stream_files(spark, source, "id long, lang string", files_per_batch=1)
        incremental.append_until(stream, sink, state, 4, "lang", "id").awaitTermination()
        return _ids(spark, sink)

    come([5, 3, 4])
    assert run() == [3, 4, 5]
    come([9, 7, 11, 13, 6])
    assert run() == [3, 4, 5, 6, 7, 9]
    # the last batch was written, but the stream died before it said so: it runs again and changes nothing
    last = max(glob.glob(f"{state}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    os.remove(f"{state}/commits/.{os.path.basename(last)}.crc")
    come([0, 2, 8, 1])
    assert run() == [0, 2, 3, 4, 5, 6, 7, 9]
    assert run() == [0, 2, 3, 4, 5, 6, 7, 9]


def test_whole_leak_queries(spark):
    """near_leaks and leak_report on sf0.001 against difflib over all pairs."""
    from textloom.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if r.text is not None]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio() if 2 * min(len(a), len(b)) >= 0.85 * (len(a) + len(b)) else 0
    want = {(i, j): ratio(a, b) for i, a in rows if i % 100 == 0 for j, b in rows if i != j}
    assert {(r.held, r.train): r.ratio for r in QUERIES["near_leaks"](spark, sf).collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items() if v > 0.85}
    found = QUERIES["leak_report"](spark, sf).first()
    others = {t for i, t in rows if i % 100}
    exact = {i for i, t in rows if i % 100 == 0 and t in others}
    near = {i for (i, j), v in want.items() if j % 100 and v > 0.85} - exact
    n = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 100 = 0").count()
    assert (found.rows, found.exact_rate, found.fuzzy_rate) == (n, pytest.approx(len(exact) / n, abs=1e-6), pytest.approx(len(near) / n, abs=1e-6))


def prose(rng, n):
    words = ["".join(rng.choice(["the", "an", "ou", "ing", "er", "is", "ed", "tion", "ble", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(n // 6)]
    return " ".join(w.capitalize() + rng.choice([".", ",", "", ""]) if rng.random() < 0.2 else w for w in words)[:n]


def test_unlike_texts_of_a_language_are_ruled_out_by_grams(monkeypatch):
    """texts of the same letters and lengths came to the longest common subsequence, every pair of them."""
    from textloom.operators import overlap

    rng = random.Random(7)
    texts = [prose(rng, rng.choice([300, 900, 2500])) for _ in range(60)]
    for i in range(12):
        at = rng.randrange(200)
        texts.append(texts[i][:at] + texts[i][at + len(texts[i]) // 20 :])
    held = list(enumerate(texts))
    compared = []
    monkeypatch.setattr(overlap, "common", lambda *a, f=common: compared.append(1) or f(*a))
    block = overlap.Held(held, 0.85, True)
    found = sorted((a, b, ratio) for i, t in held for a, b, ratio in block.near(i, t))
    want = sorted((i, j, ratio) for i, a in held for j, b in held if i != j for ratio in [difflib.SequenceMatcher(None, a, b).ratio()] if ratio > 0.85)
    assert found == want and len(found) >= 10
    assert len(compared) < 150  # before: 1,700


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh ", "etaoinshrdlu      ETAZQX", "".join(map(chr, range(0x4E00, 0x4F00)))])
@pytest.mark.parametrize("threshold", [0.85, 0.6])
def test_bounds_lose_no_pair(alphabet, threshold):
    from textloom.operators import overlap

    rng = random.Random(len(alphabet))
    for n in (0, 2, 30, 199, 200, 500):
        base = "".join(rng.choice(alphabet) for _ in range(n))
        texts = [base, base, "zz" + base, base[n // 2 :] + base[: n // 2]]
        for rate in (0.02, 0.07, 0.14):
            texts += ["".join(x if rng.random() > rate else rng.choice(["", "#", "xy", alphabet[0]]) for x in base) for _ in range(3)]
        block = overlap.Held(list(enumerate(texts)), threshold, False)
        found = sorted(x for j, t in enumerate(texts) for x in block.near(j, t))
        assert found == sorted((i, j, ratio) for i, a in enumerate(texts) for j, b in enumerate(texts) for ratio in [difflib.SequenceMatcher(None, a, b).ratio()] if ratio > threshold)


def test_copies_are_compared_once(monkeypatch):
    from textloom.operators import overlap

    calls = []
    monkeypatch.setattr(overlap, "common", lambda *a, f=common: calls.append(1) or f(*a))
    one, two = "abcdefgh" * 20, "abcdefgh" * 19 + "abcdefg#"
    block = overlap.Held([(i, one) for i in range(9)], 0.85, False, once=True)
    assert sum(len(block.near(100 + i, two)) for i in range(9)) == 9 and len(calls) == 1
    block = overlap.Held([(i, one) for i in range(9)], 0.85, True)
    assert sum(len(block.near(i, two)) for i in range(9)) == 72 and len(calls) == 2
