import random
import re
import time
from collections import Counter

import pytest

from textloom.llm.line_dedup import LEAST_PAGES, RATIO, page_line_dedup

SCHEMA = "page_id long, url string, html string, host string, lines string, n int, line int"


def lines_of(html):
    text = re.sub(r"(?is)<(script|style)\b[^>]*(>|\Z).*?(</(script|style)\s*>|\Z)|<!--.*?(-->|\Z)", " ", html or "")
    text = re.sub(r"(?i)</?(?:p|div|br|li|ul|h1|body|html|title|head|nav)\b[^>]*(>|\Z)", "\n", text)
    text = re.sub(r"<[A-Za-z!/?][^>]*(>|\Z)", "", text)
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = text.replace(a, b)
    return [x for x in (y.strip(" ") for y in re.sub(r"[\x20\x09\x0B\x0C\x0D]+", " ", text).split("\n")) if x]


def host(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", url or "")
    return m[1].lower() if m else ""


def brute(rows):
    pages, held = Counter(host(u) for _, u, _ in rows), Counter()
    for _, u, h in rows:
        held.update({(host(u), x) for x in lines_of(h)})
    out = []
    for p, u, h in rows:
        own = lines_of(h)
        stay = [x for x in own if not (held[host(u), x] >= LEAST_PAGES and held[host(u), x] > RATIO * pages[host(u)])]
        out.append((p, host(u), len(own), len(own) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr("textloom.llm.line_dedup.BROADCAST_BYTES", most)
    rng = random.Random(11)
    rows = []
    for i in range(400):
        h = rng.choice(["a.com", "A.com:80", "user@b.org", "c.net", "c.net", "c.net", "d.io"])
        body = "".join(f"<p class=x>{rng.choice(['Menu', 'Home &amp; more', 'Login', 'ad <b>now</b>', f'text {rng.randrange(60)}', f'own {i}', ''])}</p>" for _ in range(rng.randint(0, 8)))
        rows.append((i, f"https://{h}/x?{i}", f"<html><head><title>T</title><script>var a='<p>Menu</p>'</script></head><body><!-- Menu\n -->{body}</body></html>"))
    rows += [(900, None, None), (901, "nonsense", ""), (None, "http://a.com", "<p>Menu</p>"), (902, "http://a.com", "<p>twice</p>" * 3), (902, "http://a.com", "<p>twice</p>" * 3), (903, "http://e.com", "<p>" + "long " * 50_000 + "</p>")]
    rows += [(910 + i, "http://f.com", f"<p>seen {i}</p>{end}") for i, end in enumerate(("<script>x<p>y</p>", "<style", "<!-- <p>z</p>", "<div class='a'", "a < b <p>c", "</script> <b title='<p>'>d</b>", "<script <p>e</p></script>f"))]
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)
    found = sorted(map(tuple, page_line_dedup(df).collect()), key=str)
    assert found == brute(rows)
    assert sum(r[3] for r in found) > 100
    assert page_line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ratio_is_exclusive_and_relative_to_the_site(spark):
    rows = [(i, "http://big.com/", "<p>on all</p>" + ("<p>on a fifth</p>" if i < 20 else "")) for i in range(100)] + [(200 + i, "http://small.com/", "<p>on a fifth</p>" if i < 6 else "<p>z</p>") for i in range(7)]
    found = {r.page_id: r.text for r in page_line_dedup(spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)).collect()}
    assert found[0] == "on a fifth" and found[50] == "" and found[200] == "" and found[206] == "z"


def test_query_cleans_small_hosts(spark, tmp_path):
    from textloom.llm.queries import op6_line_dedup

    rows = [(i, "http://three.com/", f"<p>own {i}</p><p>footer</p>") for i in range(3)] + [(10 + i, "http://ten.com/", f"<p>own {i}</p>" + "<p>menu</p>" * (i < 4) + "<p>fifth</p>" * (i < 2)) for i in range(10)] + [(30, "http://one.com/", "<p>footer</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: r.text for r in op6_line_dedup(spark, str(tmp_path)).collect()}
    assert found[0] == "own 0" and found[2] == "own 2"
    assert found[10] == "own 0\nfifth" and found[13] == "own 3"
    assert found[30] == "footer"


@pytest.mark.parametrize("start", ["<script>", "<script ", "<!--", "<div", "<b ", "</script ", "<", "&amp;", "<p>"])
def test_long_pages_of_what_is_never_closed(spark, start):
    page = "<p>first</p>" + start * (10_000_000 // len(start))
    began = time.time()
    found = page_line_dedup(spark.createDataFrame([(1, "http://a.com", page, "x", "y", 1, 2)], SCHEMA)).collect()
    assert found[0].text.split("\n")[0] == "first"
    assert time.time() - began < 60
