"""Extraction against the articles of the pages, by brute-force marginals, and on odd pages."""

import html
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import html_extraction as hx
from skein.llm.common import table


def article(source):
    """The text of a page that marks one plain article of headings and paragraphs."""
    inner = source[source.index("<article>") + 9 : source.index("</article>")]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(x for x in parts if x)


@pytest.fixture(scope="module")
def model(spark, sf):
    return hx.train(hx.sample(table(spark, sf, "pages")))


def shown(model, source, at_least=0.5):
    return [t for t, p in hx.texts_of(model, [source])[0] if p >= at_least]


def test_articles_of_all_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in hx.op11_html_extraction(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == article(r.html) and got[r.page_id].url == r.url and got[r.page_id].n_chars == len(article(r.html))


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    for source in ("<div><p>a<p>b</div><ul><li>c</ul>", "text", "<nav><a>x</a></nav><p>y"):
        page = hx.parse(source)
        n = len(page.tag)
        own, edge = np.zeros((n, 2)), rng.normal(size=(hx.N_KINDS, 2, 2))
        own[:, 1] = rng.normal(size=n)
        kind, total, hits, pairs = hx.kinds(page), 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for states in itertools.product((0, 1), repeat=n):
            mass = np.exp(sum(own[k, s] for k, s in enumerate(states)) + sum(edge[kind[k], states[page.parent[k]], states[k]] for k in range(1, n)))
            total += mass
            hits += mass * np.array(states)
            for k in range(1, n):
                pairs[k, states[page.parent[k]], states[k]] += mass
        p, q, sums = hx.Forest([page]).marginals(own, edge)
        assert np.allclose(p, hits / total) and np.allclose(q, pairs / total) and np.isclose(sums[0], np.log(total))


def test_marginals_of_several_pages_are_those_of_each(model):
    sources = ["<article><p>one two</p></article>", "", "<div>three</div>", "<nav>four</nav><main><p>five</main>"]
    both = hx.texts_of(model, sources)
    for source, got in zip(sources, both, strict=True):
        alone = hx.texts_of(model, [source])[0]
        assert [t for t, _ in got] == [t for t, _ in alone] and np.allclose([p for _, p in got], [p for _, p in alone])


def test_gradient_raises_the_likelihood(model):
    rng = random.Random(5)
    lines = [f"{'some words of a line ' * k}." for k in range(1, 9)]
    pages = [hx.parse(hx.compose([("h1", "head line"), ("p", lines[5]), ("p", lines[7])], lines, rng)) for _ in range(40)]
    labels = [hx.composed_labels(p) for p in pages]
    right = np.concatenate([(m >= 0.5) == y for m, y in zip(model.content(pages), labels, strict=True)])
    assert right.mean() > 0.9


PARTS = """<html><head><title>Not this</title><style>p{}</style></head><body><header class="site-header"><h1>The Daily</h1><p>News that you can use</p></header>
<nav class="menu"><ul><li><a href=/>Home</a></li><li><a href=/a>World</a></li></ul></nav><div class="cookie-banner">We use cookies to improve things. <button>OK</button></div>
<main><h1>Title of the story</h1><p>First paragraph of the story, which is fairly   long
and has text.</p><div class="ad">Buy this now, best price.</div><p>Short.</p><ul><li>Point one</li><li>Point two</li></ul><p>Last&nbsp;of &lt;all&gt;.<script>var x = "</p><p>no</p>";</script></main>
<aside class="sidebar"><h3>Related</h3><p>Other text about things that you may like very much.</p></aside>
<section class="comments"><h3>2 comments</h3><div class="comment"><p>I think that this is a great article and I liked it very much. Thanks.</p></div></section>
<form><label>Email</label><input><button>Sign up</button></form><footer>&copy; 2024 The Daily. All rights reserved.</footer></body></html>"""
STORY = ["Title of the story", "First paragraph of the story, which is fairly long and has text.", "Short.", "Point one", "Point two", "Last of <all>."]


def test_parts_of_a_page(model):
    assert shown(model, PARTS) == STORY
    assert shown(model, PARTS.replace("<main>", '<div class="post-content">').replace("</main>", "</div>")) == STORY


def test_comments_inside_an_article(model):
    source = '<article><h1>Head</h1><p>Text one is here and it is long enough to be read as such.</p><section id="comments"><article class="comment"><p>Reader says something that is also fairly long.</p></article></section><footer>Filed under things</footer></article>'
    assert shown(model, source) == ["Head", "Text one is here and it is long enough to be read as such."]


def test_pages_without_structure(model):
    assert shown(model, "Just plain text, &amp; no markup at all.") == ["Just plain text, & no markup at all."]
    assert shown(model, "<p>One paragraph of text that is the whole page.</p><p>Another one.</p>") == ["One paragraph of text that is the whole page.", "Another one."]
    assert shown(model, "<article>" + "<p>word.</p>" * 3000 + "</article>") == ["word."] * 3000


def test_parser():
    texts = lambda s: [t for t in hx.parse(s).text if t is not None]
    assert texts("<p>a<p>b<div>c</p>d</div>e") == ["a", "b", "c", "d", "e"]
    assert texts("<p><b>a<br>b<p>c") == ["a b", "c"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert texts("x<!-- <p>no --> y<!-- open <p>no") == ["x y"]
    assert texts("a<script>if (1 < 2) '</p>'</script>b<style>p{}") == ["ab"]
    assert texts("<a title='1 > 0' href=x>in</a>line <b class=\"q>r\">t</b>") == ["inline t"]
    assert texts("&lt;p&gt; &amp;amp; &eacute; &#8364; &ampx &am") == ["<p> &amp; é € &x &am"]
    assert texts("1 < 2 and 3 > 2 <3") == ["1 < 2 and 3 > 2 <3"]
    assert texts("</div></p>a</body></html>b") == ["a", "b"]
    assert texts("<div>" * 5000 + "deep" + "</div>" * 5000 + "after") == ["deep", "after"] and max(hx.parse("<div>" * 5000 + "x").depth) <= hx.DEEPEST + 1
    assert texts("<body class=x><body>twice") == ["twice"] and texts("") == [] and texts(" \n ") == []
    assert hx.attributes(' class="siteHeader top-bar" id=mainNav data-x="y"')[0] == ("site", "header", "top", "bar", "main", "nav")


def test_odd_rows(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>same</p>"), (3, "u", "<p>same</p>"), (None, "v", "<article><p>no id</p></article>"), (4, "w", "<article>" + "long words here " * 100_000 + "</article>"), (5, "x", "<script>"), (6, "y", "<div <p <!--")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "blocks": F.lit(1), "n_chars": F.lit(2), "label": F.lit(3)})
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in hx.op11_html_extraction(pages).collect()), key=str)
    assert len(got) == len(rows)
    by = {g[0]: g for g in got}
    assert by[1][2:] == by[2][2:] == by[5][2:] == ("", 0) and by[0][2] == "no id" and by[4][2] == ("long words here " * 100_000).strip() and by[4][3] == len(by[4][2])
    assert sum(g[0] == 3 for g in got) == 2
    assert hx.op11_html_extraction(pages.limit(0)).collect() == []
    kept = hx.blocks(pages, model).filter("page_id = 4").first()
    assert len(kept.blocks) == 1 and 0 <= kept.blocks[0].content <= 1
