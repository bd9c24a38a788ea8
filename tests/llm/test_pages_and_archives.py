"""Archives read back as written; main text of pages."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tablemill.llm import htmltext, labelled_pages, warc

FOLDER = "/root/testdata/sf0.001"
LONG = "<p>" + "long text, " * 20 + "</p>"


def captures_by_hand(rows):
    first = {}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 100 and page_id is not None:
            first[payload] = min(first.get(payload, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        original = first.get(payload)
        revisit = original is not None and original != page_id
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", original if revisit else None))
    return sorted(out, key=repr)


def test_archives_come_back_as_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_ARCHIVE", 3)
    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5
    rows = [(5, "http://a.example/x", LONG), (3, "https://www.a.example:8080/x#top", LONG), (9, None, LONG), (1, "http://b.example/é ü\r\nX: y", tricky), (2, "", None),
            (4, "HTTP://A.Example", ""), (6, "http://a.example/x", "é" * 60), (7, "http://c.example", "é" * 60), (8, "u", "short"), (10, "u", "short"),
            (None, "http://a.example/x", LONG), (None, "n", "unseen " * 30), (3, "https://www.a.example:8080/x#top", LONG), (11, "big", "<b>" * 300_000)]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, digest string").repartition(4)
    folder = warc.write_archives(df, str(tmp_path / "warc"))
    index = warc.read_index(spark, folder)
    got = index.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == captures_by_hand(rows)
    order = [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)
    for r in got:
        content = (tmp_path / "warc" / r.run).read_bytes()[r.offset : r.offset + r.length]
        assert content.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
    assert warc.archive_pages(df.where("false")).count() == 0


def test_a_damaged_archive_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.example", LONG)], "page_id long, url string, html string")
    folder = tmp_path / "warc"
    warc.write_archives(df, str(folder))
    part = max(folder.glob("part-*"), key=lambda f: f.stat().st_size)
    content = part.read_bytes()
    for broken in (content.replace(b"long text", b"lost text", 1), content[:-6], content.replace(b"WARC/1.1", b"WARC/0.9")):
        with pytest.raises(ValueError):
            warc._entries("x", broken)


@pytest.mark.parametrize("sizes", [[], [0], [5], [3, 0, 4], [1] * 9, [40, 1, 17, 0, 23]])
def test_the_loser_tree_merges(sizes):
    rng = random.Random(len(sizes))
    runs = [sorted(rng.randint(0, 30) for _ in range(n)) for n in sizes]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def test_ranges_are_merged_in_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "ENTRIES_PER_RANGE", 40)
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".example/"), F.col("id") % 3).alias("url"), F.lit("x").alias("html"))
    got = warc.archive_pages(pages.repartition(5)).collect()
    order = [(r.url_key, r.captured_at, r.page_id) for r in got]
    assert len(order) == 300 and order == sorted(order)


def test_url_keys():
    assert warc.url_key("HTTPS://www.Ab.example.com:443/P?q=1#f") == "com,example,ab)/p?q=1" and warc.url_key("") == ")"


@pytest.fixture(scope="module")
def model():
    return htmltext.train(labelled_pages.PAGES)


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><script>var a='<p>';</script><style>p{{}}</style></head><body>{body}</body></html>"


def test_parts_around_the_article_are_left_out(model):
    body = (
        '<header class="top"><p>Site name, the best of all sites.</p></header><nav><ul><li><a href="/a">Start</a></li><li><a href="/b">News</a></li></ul></nav>'
        '<div id="cookie-bar" class="notice">We use cookies, and you accept.</div><div class="ad">Buy this, and that, today.</div>'
        "<article><h1>A &amp; B</h1><p>First   para,\n with <b>bold</b> and a <a href='/x'>link</a>, of some length.<p>Second &eacute;&#233; one.</article>"
        '<aside class="sidebar"><h3>More</h3><p>Some other story, told elsewhere, at length.</p></aside><form><p>Name</p><input></form>'
        '<section class="comments"><div class="comment"><p>I like it, very much so, indeed.</p></div></section><footer><p>Copyright, all rights reserved.</p></footer>'
    )
    assert model.main_text(page(body)) == "A & B\n\nFirst para, with bold and a link, of some length.\n\nSecond éé one."


def test_pages_without_text(model):
    assert [model.main_text(p) for p in (None, "", "<html></html>", "<script>x", "<!-- x", "<p", page("<nav><a href='/'>x</a></nav>"))] == [""] * 7


def test_broken_markup_does_not_crash(model):
    rng = random.Random(7)
    parts = ["<p>", "</p>", "<div class='a", '"', "'", "<", ">", "</", "text, more. ", "<!--", "-->", "<script>", "</script>", "<li>", "<table><tr><td>", "&amp", "&#x110000;", "<a href=x>", "</article>"]
    for _ in range(200):
        model.main_text("".join(rng.choice(parts) for _ in range(60)))
    assert isinstance(model.main_text("<div>" * 3_000 + "deep text" + "</div>" * 3_000), str)


def test_marginals_are_exact(model):
    """Messages against a sum over all labellings of a small tree."""
    import itertools
    import math

    tree = htmltext.parse("<div class='x'><p>one, two</p><ul><li>a</li></ul></div>")
    n = len(tree.tag)
    own = [
        model.bias + sum(model.weights.get(f, 0) for f in htmltext.name_features(t, a)) + sum(model.weights.get(f, 0) for f in htmltext.shape_features(s))
        for t, a, s in zip(tree.tag, tree.attributes, htmltext.node_shapes(tree))
    ]
    total, held = 0.0, [0.0] * n
    for labels in itertools.product((0, 1), repeat=n):
        score = sum(o for o, y in zip(own, labels) if y)
        score += sum(model.pair.get(tree.tag[tree.parent[i]], model.pair[""])[labels[tree.parent[i]]][labels[i]] for i in range(1, n))
        total += math.exp(score)
        for i in range(n):
            held[i] += math.exp(score) * labels[i]
    assert all(abs(h / total - p) < 1e-9 for h, p in zip(held, model.marginals(tree)))


def test_labelled_pages_held_out():
    """Trained on some of the labelled pages, the model reads the others."""
    pages = labelled_pages.PAGES
    model = htmltext.train(p for i, p in enumerate(pages) if i % 3)
    right = runs = 0
    for p in pages[::3]:
        tree = htmltext.parse(p)
        for tag, chance, label in zip(tree.tag, model.marginals(tree), htmltext.labels_of(tree)):
            if tag == "#run":
                runs += 1
                right += (chance >= 0.5) == bool(label)
    assert right >= 0.95 * runs


def test_query_over_the_pages(spark):
    """The given pages mark their articles, so the expected text can be cut out with patterns."""
    import html

    from tablemill.llm.queries import QUERIES

    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = QUERIES["op10_main_text"](spark, FOLDER).collect()
    same = 0
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        same += r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
    assert len(got) == len(pages) and same >= 0.95 * len(pages)


def test_odd_rows(spark):
    rows = [(1, "u", None, "mine"), (None, None, "", "mine"), (1, "u", None, "mine"), (2, "v", page("<article><p>" + "word, " * 60_000 + "</p></article>"), None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    got = htmltext.main_text(df).collect()
    assert [r.n_chars for r in got][:3] == [0, 0, 0] and got[3].n_chars > 300_000 and got[3].text.startswith("word, word")
    assert htmltext.main_text(df.where("false")).count() == 0
