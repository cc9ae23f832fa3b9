import html as references
import re
import time

import numpy as np

from veloframe.llm import html

CLASSIFIER = html.Classifier(np.array([1.14, -1.14, -6.31, -6.3, 1.0, -3.02, 1.37, 0.05, 1.72, -0.5, 1.2, 2.19]))


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert len(got) == pages.count()
    for page in pages.collect():
        article = re.search(r"<article>(.*)</article>", page.html, re.S).group(1)
        spaced = re.sub(r"</?(p|h1|br|article)>", " ", article)
        want = " ".join(references.unescape(re.sub(r"<[^>]*>", "", spaced)).split())
        r = got[page.page_id]
        assert r.text == want and r.n_chars == len(want) and r.url == page.url


def test_parts_beside_the_article_go():
    page = """<body class="has-sidebar"><header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use cookies.</div>
    <main><article><header><h1>Big  title</h1></header><p>Text of the article that is long enough to be seen as such.</p>
    <aside class="newsletter"><p>Subscribe to our letter now and get all the news of the day.</p></aside><div class="ad">Buy this</div>
    <p>More text &eacute; &#8212; a <b>bo</b>ld word.<!-- no --><script>var x = "</p>";</script><p>x < y</p>
    <table><tr><td>one</td><td>two</td></tr></table><form><label>Mail</label><button>Send</button></form>
    <section id="comments"><p>I am a reader and have a long opinion about all of this here.</p></section></article></main>
    <footer>&copy; 2020</footer></body>"""
    assert html.main_text(page, CLASSIFIER) == ("Big title Text of the article that is long enough to be seen as such. "
                                                "More text é — a bold word. x < y one two")


def brute_cut(odds, edges):
    best = None
    for bits in range(1 << len(odds)):
        side = [bits >> i & 1 for i in range(len(odds))]
        cost = sum(o if o > 0 and not s else -o if o < 0 and s else 0 for o, s in zip(odds, side))
        cost += sum(c for a, b, c in edges if side[a] != side[b])
        best = cost if best is None else min(best, cost)
    return best


def test_minimum_cut():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        odds = rng.normal(size=n).round(3).tolist()
        edges = [(a, b, float(rng.random())) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        side = html.min_cut(odds, edges)
        cost = sum(o if o > 0 and not s else -o if o < 0 and s else 0 for o, s in zip(odds, side))
        cost += sum(c for a, b, c in edges if side[a] != side[b])
        assert abs(cost - brute_cut(odds, edges)) < 1e-6


LONG = "words of a text that goes on for long enough " * 20 + "to end here"


def test_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, 0), (2, None, "", 0), (None, "u", "<p title='a>b'>hello <i>wor</i>ld", 0),
                                   (4, "u", "<a \"" * 5000, 0), (5, "u", "<div>" * 5000 + LONG, 0), (5, "u", "<div>" * 5000 + LONG, 0),
                                   (6, "u", "<script>only", 0), (7, "u", "<nav><a href=x>menu</a></nav>", 0)],
                                  "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got[1] == got[2] == got[6] == got[7] == "" and got[None] == "hello world" and got[5] == LONG
    assert html.extract(pages).count() == 8 and html.extract(pages.limit(0)).count() == 0


def test_a_hidden_element_ends_where_its_end_is_implied():
    def text(page):
        return " ".join("".join(b.parts) for b in html.blocks_of(page))

    assert text('<article><p style="display:none">x<p>Para 1<p>Para 2</article>') == "Para 1 Para 2"
    assert text("<article><ul><li hidden>a<li>b<li>c</ul></article>") == "b c"
    assert text("<article><div hidden><p>x<p>y</div><p>z</article>") == "z"
    assert text("<article><p>a<button><p>no</p></button>b</p></article>") == "ab"


def test_math_object_and_noscript_in_an_article_take_part():
    page = "<article><p>The sum <math><mi>x</mi></math> is shown in this long text.</p><noscript><p>Words of the article kept for plain readers.</p></noscript><object>A drawing of the thing.</object></article>"
    assert html.main_text(page, CLASSIFIER) == ("The sum x is shown in this long text. Words of the article kept for plain readers. "
                                                "A drawing of the thing.")


def test_hidden_is_an_attribute_not_a_word():
    page = """<article><p title="the hidden cost">One stays.</p><p class="not hidden now">Two stays.</p><p data-x='display:none'>Three stays.</p>
<p hidden>No.</p><p aria-hidden="true">No.</p><p aria-hidden=false>Four stays.</p><p STYLE="color:red; display : none">No.</p></article>"""
    text = " ".join("".join(b.parts) for b in html.blocks_of(page))
    assert [w for w in ("One", "Two", "Three", "Four", "No.") if w in text] == ["One", "Two", "Three", "Four"]


def test_many_unmatched_end_tags_are_linear():
    start = time.perf_counter()
    assert len(html.blocks_of("<div>" * 50_000 + "</foo>" * 50_000 + "<p>text</p>")) == 1
    assert len(html.blocks_of("<p>" + "<a b='" * 20_000 + "text")) <= 2
    assert time.perf_counter() - start < 10
