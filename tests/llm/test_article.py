"""Main texts on the given pages, on layouts that training never saw, and the parts of the method against plain versions."""

import html
import itertools
import random
import re

import numpy as np
import pytest

from metermill.llm import article, dom
from metermill.llm.layouts import Layout

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return article.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def text_of(model, page):
    tree = dom.parse(page or "")
    return article.main_text(tree, model.article(article.Nodes([tree])))


def plain(page):
    """The given pages' one <article>, by regular expressions."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inside = re.sub(r"</?(p|h1|br)\b[^>]*>", " ", re.sub(r"<!--.*?-->", "", inside))
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", inside)).split())


def test_query_equals_plain_extraction(spark):
    from __spark_entry__ import queries

    df = queries()["op13_article"](spark, SF)
    assert df.columns[:4] == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in df.collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert (r.url, r.text, r.n_chars) == (p.url, plain(p.html), len(plain(p.html)))


A, B, C = "Ein Wort und noch eines, dann ein Satz.", "The second block speaks of something else; it is longer, and it ends here.", "Kurz."
HAND_MADE = [
    f"<html><body><div id='header'><h1>My Site</h1><ul id='menu'><li><a href=/>Home</a><li><a href=/a>About</a></ul></div><div id='content'><h2>Title</h2><p>{A}<p>{B}<p>{C}</div><div id='sidebar'><h3>More</h3><a href=/x>Link one</a> <a href=/y>Link two</a></div><div id='footer'>Copyright 2020 My Site</div></body></html>",
    f"<!doctype html><html><head><title>t</title></head><body><div class='cookie-consent'><p>We use cookies.</p><button>OK</button></div><header><a href=/>Logo</a><nav><a href=/1>One</a><a href=/2>Two</a><a href=/3>Three</a></nav></header><main><article class=post><h1>Title</h1><p>{A}</p><div class='ad-slot'>Buy this now</div><p>{B}</p><p>{C}</p><section id='comments'><h2>Comments</h2><div class='comment'><b>Joe</b><p>I liked this a lot, thank you for it.</p></div><div class='comment'><p>Me too.</p></div></section></article><aside><h3>Related</h3><ul><li><a href=/z>Zed</a></li></ul></aside></main><footer>&copy; 2021</footer></body></html>",
    f"<html><body><nav><ul><li><a href='/a'>A</a></li><li><a href='/b'>B</a></li></ul></nav><article><h1>Title</h1><p>{A}</p><p>{B}</p><form action=/s><label>Mail</label><input name=m><button>Send</button></form><p>{C}</p></article><footer>&copy; site</footer>",
    f"<html><body><div class='wrapper'><div class='topbar'><a href=/>Home</a> | <a href=/n>News</a></div><div class='story-body'><h1>Title</h1><p>{A}</p><blockquote>{B}</blockquote><p>{C}</p></div><div class='share-buttons'><a href=/f>Facebook</a><a href=/t>Twitter</a></div><div class='newsletter'><p>Get our newsletter every week.</p><input name=e></div></div></body></html>",
]


@pytest.mark.parametrize("page", HAND_MADE)
def test_hand_made_layouts(model, page):
    assert text_of(model, page) == f"Title {A} {B} {C}"


def test_unseen_layouts(spark, model):
    """Held-out accuracy: texts and seeds that training did not have."""
    rng = random.Random("held out")
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) between 200 and 3000").orderBy("doc_id").limit(120).collect()]
    exact, near, pages = 0, 0, 0
    for text in docs:
        blocks = [" ".join(b.split()) for b in re.split(r"(?<=\.)\s+", text) if b.strip()][:15]
        page = Layout(rng, ["one two three four five six", *blocks]).page(blocks[0][:50], blocks)
        tree = dom.parse(page)
        want = article.main_text(tree, article.truths(tree, True) == article.ARTICLE)
        got = text_of(model, re.sub(r" data-truth=\w", "", page))
        a, b = set(want.split()), set(got.split())
        exact, near, pages = exact + (want == got), near + (len(a & b) >= 0.9 * len(a | b)), pages + 1
    assert near >= 0.9 * pages and exact >= 0.65 * pages, (exact, near, pages)


SCHEMA = "page_id long, url string, html string, text string, n_chars string, ar_html int"


def extracted(spark, model, pages):
    rows = [(i, f"u{i}", p, "t", "n", 1) for i, p in enumerate(pages)]
    got = article.extracted(spark.createDataFrame(rows, SCHEMA), model).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)], got


def test_odd_pages(spark, model):
    body = f"<body><nav><a href=/>x</a></nav><article><p>{A}</p><p>{B}</p></article></body>"
    long = "<article>" + f"<p>{B}</p>" * 20_000 + "</article>"
    pages = [None, "", "   ", "<", "<nav><ul><li><a href=/>Home</a></li></ul></nav>", body, body, body[:-20], "<div>" * 3000 + A, long, "<script>x<article>y</article>", body.replace("<article>", "<ARTICLE  data-x='>' title=it's>")]
    texts, rows = extracted(spark, model, pages)
    assert texts[:5] == ["", "", "", texts[3], ""] and texts[3] in ("", "<")
    assert texts[5] == texts[6] == f"{A} {B}" and texts[7].startswith(A) and texts[10] == ""
    assert texts[9] == " ".join([B] * 20_000) and texts[11] == texts[5]
    assert all(r.n_chars == len(r.text) and r.url == f"u{r.page_id}" for r in rows)


def test_no_pages_to_learn_from(spark):
    for pages in ([], [None, ""], ["<nav></nav>"]):
        rows = [(i, None, p, "t", "n", 1) for i, p in enumerate(pages)]
        got = article.extract(spark.createDataFrame(rows, SCHEMA)).collect()
        assert [(r.text, r.n_chars) for r in got] == [("", 0)] * len(pages)


def test_references_white_space_and_blocks():
    tree = dom.parse("<p>a&amp;b&nbsp;&#233;&lt;i&gt;\n\t c<b>d</b>e<br>f<p>g<ul><li>h<li>i</ul>j<td>k<!-- x --> l")
    assert article.main_text(tree, np.ones(len(tree.tag), bool)) == "a&b é<i> cde f g h i j k l"


@pytest.mark.parametrize("page,tags", [
    ("<p>a<p>b", ["#page", "p", "p"]), ("<div><p>a</div>b</p>", ["#page", "div", "p"]), ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["#page", "ul", "li", "ul", "li", "li"]),
    ("<b><div>x</b></div>y", ["#page", "div"]), ("</div></p>x", ["#page"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["#page", "table", "tr", "td", "td", "tr", "td"]),
    ('<div a="<p>" b=\'</div>\'>x', ["#page", "div"]), ("<textarea><p>x</textarea><p>y", ["#page", "textarea", "p"]), ("<!-- <p> --><p x", ["#page", "p"]), ("<h1>a<h2>b", ["#page", "h1", "h2"]),
])
def test_trees_of_broken_markup(page, tags):
    tree = dom.parse(page)
    assert tree.tag == tags
    assert all(v < e <= len(tags) for v, e in enumerate(tree.end)) and all(p < v for v, p in enumerate(tree.parent))
    for v, p in enumerate(tree.parent[1:], 1):
        assert tree.end[v] <= tree.end[p]


def test_decoding_equals_all_labellings():
    """Against every labelling of small trees."""
    rng = np.random.default_rng(5)
    for page in ("<div><p>a<p>b</div><nav></nav>", "<div><div><div>a</div></div></div>", "<p>a<p>b<p>c<p>d"):
        nodes = article.Nodes([dom.parse(page), dom.parse("<p>x")])
        for _ in range(30):
            unary, steps = np.log(rng.dirichlet([0.7] * 3, nodes.n)), np.log(rng.dirichlet([0.7] * 3, (nodes.n, 3)))
            for above, own in ((1, 0), (2, 0), (2, 1)):
                steps[:, above, own] = -np.inf
            best = max(
                (sum(unary[v, c] + (0 if nodes.top[v] else steps[v, way[nodes.parent[v]], c]) for v, c in enumerate(way)), way)
                for way in itertools.product(range(3), repeat=nodes.n)
            )
            assert tuple(nodes.decode(unary, steps)) == best[1]


def test_ensembles_equal_sparks_own_margins(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 6)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 3] + x[:, 1] > 0.4)).astype(float)
    df = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "y double, f array<double>").select("y", array_to_vector("f").alias("features"))
    fitted = GBTClassifier(labelCol="y", maxIter=6, maxDepth=article.DEPTH, seed=1).fit(df)
    mine = article.Ensembles()
    for tree, weight in zip(fitted.trees, fitted.treeWeights):
        mine.add(tree.toDebugString, weight, 1)
    mine.done()
    at = np.zeros((len(x), len(mine.roots)), int) + mine.roots
    for _ in range(article.DEPTH):
        at = np.where(x[np.arange(len(x))[:, None], mine.feature[at]] <= mine.cut[at], mine.left[at], mine.right[at])
    margin = (mine.value[at] * mine.weight).sum(axis=1)
    want = [r.rawPrediction[1] for r in fitted.transform(df).select("rawPrediction").collect()]
    assert np.allclose(2 * margin, want, atol=1e-12) or np.allclose(margin, want, atol=1e-12)
