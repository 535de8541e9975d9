from __future__ import annotations

import re
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from quillmesh.llm import html_extract as he

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="<p>no</p>";</script></head>
<body><nav><ul><li><a href="/a">Home, page</a><li><a href="/b">Other</a></ul></nav>
<div class="ad">Buy now, cheap, cheap, cheap, cheap, and once more for the sake of the advertisement.</div>
<div id=main><h1>Head &amp; line</h1><p>First paragraph, with commas, and enough text to count as a real one.
<p>Second <b>bold</b> paragraph, also long enough, with an <a href="x">inner link</a> in it.</p><p>Short.</p></div>
<div class="links"><p><a href="1">link text, link text, link text, link text, link text</a></p></div>
<footer>&copy; someone</footer></body></html>"""


def test_content_is_kept_and_boilerplate_left():
    text, score = he.extract(PAGE)
    assert text == "Head & line\nFirst paragraph, with commas, and enough text to count as a real one.\nSecond bold paragraph, also long enough, with an inner link in it.\nShort."
    assert score > 0


def test_score_by_hand():
    page = "<div><p>aaaaaaaaaa, bbbbbbbbbbbb, cccccccc</p><p>" + "d" * 250 + "</p></div>"
    # (1 + 2 commas + 0) + (1 + 0 + 2 hundreds), no links, against the root's half of it
    assert he.extract(page)[1] == 6.0
    linked = "<div><p>aaaaaaaaaa, bbbbbbbbbbbb, cccccccc</p><a>" + "d" * 35 + "</a></div>"
    text = len("aaaaaaaaaa, bbbbbbbbbbbb, cccccccc")
    assert abs(he.extract(linked)[1] - 3 * (1 - 35 / (35 + text))) < 1e-6


class Plain(HTMLParser):
    """All visible text by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_tree_holds_all_visible_text_of_real_pages(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    kept = total = 0
    for page in pages:
        plain = Plain()
        plain.feed(page)
        plain.close()
        everything = re.sub(r"\s+", "", "".join(plain.out))
        root = he.parse(page)
        assert re.sub(r"\s+", "", he.render([root])) == everything
        text, _ = he.extract(page)
        article = re.search(r"<article>(.*?)</article>", page, re.S)
        if article:
            inner = Plain()
            inner.feed(article.group(1))
            inner.close()
            total += 1
            kept += re.sub(r"\s+", "", "".join(inner.out)) == re.sub(r"\s+", "", text)
        assert "©" not in text and "track(" not in text
    assert total > 200 and kept / total > 0.95


def test_odd_markup():
    for page in ("", "plain", "<", "<p", "<!--", "<script>x", "</p></p>", "<p>a<p>b<table><tr><td>c<td>d", "a < b > c", "<a href='x>y", "<![CDATA[z]]>", "<div " * 3000, "<b>" * 5000 + "deep"):
        text, score = he.extract(page)
        assert isinstance(text, str) and score == 0.0
    assert he.extract("<p>a<p>b<table><tr><td>c<td>d")[0] == "a\nb\nc\nd"
    assert he.extract("x<br>y &lt;z&gt;<![CDATA[q]]>")[0] == "x\ny <z>q"


def test_hostile_pages_take_linear_time():
    pages = ["<blockquote>some words, and more of them here ", "<table><tr><td>some words, and more, here ", "<div><dt>x", "<ul><li><div>some text, "]
    for part in pages:
        took = []
        for n in (20_000, 200_000):
            began = time.process_time()
            he.extract((part * n)[:n])
            took.append(time.process_time() - began)
        assert took[1] < 30 * max(took[0], 0.02)
    began = time.process_time()
    he.extract("<div>" * 60_000 + "</span></b>" * 60_000)
    assert time.process_time() - began < 10


def plain_extract(page):
    """The same rules by recursion, everything counted anew for each element."""
    def visible(n):
        return [c for c in n.children if isinstance(c, str) or c.tag not in he.SKIPPED and c.tag != "title"]

    def chars(n):
        return sum(len(" ".join(c.split())) if isinstance(c, str) else chars(c) for c in visible(n))

    def linked(n):
        return chars(n) if n.tag == "a" else sum(linked(c) for c in visible(n) if not isinstance(c, str))

    def commas(n):
        return sum(c.count(",") if isinstance(c, str) else commas(c) for c in visible(n))

    def elements(n):
        return [n] + [e for c in visible(n) if not isinstance(c, str) for e in elements(c)]

    root = he.parse(page)
    every = elements(root)
    score = {}
    for n in every:
        if n.tag in he.PARAGRAPH and n.parent is not None and chars(n) >= he.MIN_CHARS:
            above = n.parent
            for share in (1, 2, 3):
                if above is not None:
                    base = (-25 if above.unlikely else 0) + (5 if above.tag in ("article", "main") else 0)
                    score[above] = score.get(above, base) + (1 + commas(n) + min(3, chars(n) // 100)) / share
                    above = above.parent
    boilerplate = {id(n) for n in every if n.tag in he.BOILERPLATE or n.unlikely}
    if not score:
        return he.render([root], boilerplate), 0.0
    final = {n: s * (1 - (linked(n) / chars(n) if chars(n) else 0)) for n, s in score.items()}
    best = max((n for n in every if n in final), key=lambda n: final[n])
    if best.parent is None:
        return he.render([best], boilerplate), round(final[best], 6)

    def stays(n):
        if isinstance(n, str) or n.tag in he.SKIPPED:
            return False
        if n is best or final.get(n, -1) >= max(10, final[best] / 5):
            return True
        few = chars(n) and linked(n) / chars(n) < 0.25
        return n.tag == "p" and not n.unlikely and bool(chars(n) > 80 and few or 0 < chars(n) <= 80 and not linked(n) and re.search(r"[.!?…](\s|$)", he.render([n])))

    return he.render([n for n in best.parent.children if stays(n)]), round(final[best], 6)


def test_query_equals_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = sorted((r.page_id, r.text, r.score) for r in he.op4_html_extract(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted((r.page_id, *plain_extract(r.html)) for r in pages) and len(got) == 50


def test_defined_cases(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, PAGE), (3, None, PAGE), (None, "u", "<p>t"), (4, "u", "<p>" + "word, " * 60_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("score", F.lit("y"))
    got = sorted(((r.page_id or 0), r.text, r.n_chars) for r in he.extract_pages(df).collect() if r.text is not None)
    assert [g[0] for g in got] == [0, 2, 3, 3, 4] and got[0][1] == "t" and got[1][1:] == ("", 0) and got[4][2] > 300_000
    assert he.extract_pages(df.limit(0)).collect() == [] and he.extract_pages(df).where("page_id = 1").first().text is None
