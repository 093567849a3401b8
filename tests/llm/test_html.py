import re
from html import unescape
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import html_text


def cost(odds, edges, keep):
    return sum(-o for o, k in zip(odds, keep, strict=True) if o < 0 and k) + sum(o for o, k in zip(odds, keep, strict=True) if o > 0 and not k) + sum(c for a, b, c in edges if keep[a] != keep[b])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=7), st.data())
def test_cut_is_the_least(odds, data):
    n = len(odds)
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(1, 9)), max_size=9))
    edges = [(a, b, float(c)) for a, b, c in edges if a != b]
    best = min(cost(odds, edges, k) for k in product((False, True), repeat=n))
    assert abs(cost(odds, edges, html_text.min_cut(odds, edges)) - best) < 1e-6


def test_article_of_every_page(spark):
    """The pages' articles, cut out by pattern: blocks start and end at tags other than b."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract_pages(pages).collect()}
    for page in pages.collect():
        body = "".join(re.findall(r"<article>(.*?)</article>", page["html"], re.S))
        blocks = (" ".join(unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:h1|p|br)>", body))
        expected = "\n".join(b for b in blocks if b)
        assert got[page["page_id"]]["text"] == expected
        assert got[page["page_id"]]["n_chars"] == len(expected)


PAGE = """<html><head><title>T</title><script>if (a < b) "</p>"</script></head><body><div id="cookie-notice">We use cookies</div>
<header><h1>Site</h1></header><div class="content"><p>First &amp; long paragraph of the story, with quite enough words to count<p>Second
 <b>bold</b>\tone&nbsp;here that also goes on for a while, as stories do</div><form>Name <input></form><section class="comments"><p>Nice post!</p></section>
<div class="sidebar"><p>More links</p></div><footer>&copy; us</footer></body></html>"""


def test_other_layouts():
    assert html_text.extract(PAGE) == "First & long paragraph of the story, with quite enough words to count\nSecond bold one here that also goes on for a while, as stories do"
    assert html_text.extract("<article><h2>A</h2>x<br>y<div class='ad'>buy</div><p>z</article>") == "A\nx\ny\nz"


def test_edges(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "<p"), (3, "<article>" + "<p>a b" * 20_000), (4, "</div></p><b>"), (5, "<div>" * 3000 + "deep" + "</div>" * 3000)]
    frame = spark.createDataFrame([(*r, "u", "old", 1) for r in rows], "page_id long, html string, url string, text string, n_chars int")
    got = html_text.extract_pages(frame).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert next(r for r in got if r["page_id"] == 3)["text"].count("\n") == 19_999
    assert html_text.extract_pages(frame.limit(0)).count() == 0
