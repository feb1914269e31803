import html
import random
import re
import time
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from newsloom.llm import html_extract as h

DATA = "/root/testdata/sf0.01"
LONG = "This is a rather long sentence of the article that goes on for more than a dozen words in all."


def test_min_cut_against_all_labellings():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 8)
        scores = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(i, j, rng.randrange(6)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(x):
            return sum(max(0, s) if not k else max(0, -s) for s, k in zip(scores, x)) + sum(c for i, j, c in edges if x[i] != x[j])

        assert cost(h.min_cut(scores, edges)) == min(cost(x) for x in product((False, True), repeat=n))


def test_article_in_its_page():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
    <header><h1>Site name</h1><p>{LONG}</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
    <div class="cookie-notice"><p>{LONG}</p></div><div id="content"><article><header class="entry-header"><h1>The &eacute;vent</h1></header><!-- <p>x</p> -->
    <p>First&nbsp;line<br>goes   on.<p>{LONG} <a href=x>Link</a></p><div class="ad">{LONG}</div><ul><li>One</li><li><a href=y>Two</a></li></ul><pre>a
    b</pre><form><p>{LONG}</p><input><button>Send</button></form><p>5 &lt; 6 &amp;amp; &#x41;&#8217;s</p></article></div>
    <aside class=sidebar><h2>More</h2><p>{LONG}</p></aside><section id="comments"><h2>2 comments</h2><article class="comment"><p>{LONG}</p></article></section>
    <footer><p>{LONG}</p>&copy; 2024 All rights</footer><script>done()</script></body></html>"""
    assert h.main_text(page).split("\n") == ["The évent", "First line goes on.", f"{LONG} Link", "One", "Two", "a b", "5 < 6 &amp; A’s"]


def test_page_without_semantic_elements():
    page = f"<body><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div><h2>Head</h2><p>{LONG}</p><p>Yes</p><p>{LONG}</p></div><div><a href=1>One</a></div><div>© 2024</div>"
    assert h.main_text(page) == f"Head\n{LONG}\nYes\n{LONG}"


def test_short_lines_between_paragraphs():
    assert h.main_text(f"<div><p>{LONG}</p><p>Two eggs</p><p>One lemon</p><p>{LONG}</p></div>") == f"{LONG}\nTwo eggs\nOne lemon\n{LONG}"
    page = f"<div><p>{LONG}</p><ul><li>Two eggs<li>One lemon<li>Salt</ul><p>{LONG}</p><table><tr><td>A<td>1<tr><td>B<td>2</table></div><div>Menu</div><div>Top</div>"
    assert h.main_text(page) == "\n".join([LONG, "Two eggs", "One lemon", "Salt", LONG, "A", "1", "B", "2"])


def test_names_that_are_no_boilerplate():
    two = f"{LONG}\n{LONG}"
    assert h.main_text(f"<div class='layout right-sidebar'><p>{LONG}</p><p>{LONG}</p><div class='left-sidebar'><p>{LONG}</p></div></div>") == two
    assert h.main_text(f"<div class=comments-open><p>{LONG}</p><p>{LONG}</p></div>") == two
    assert h.main_text(f"<article><section id='discussion'><h2 id='related-work'>Related work</h2><p>{LONG}</p></section><p>{LONG}</p></article>") == f"Related work\n{two}"
    assert h.main_text(f"<div data-id=ad title='class=ad'><p>{LONG}</p></div><p>{LONG}</p>") == two
    # these stay boilerplate
    for name in ("sidebar", "related-posts", "site-footer", "post-comments"):
        assert h.main_text(f"<div class='{name}'><p>{LONG}</p></div><div><p>{LONG}</p><p>{LONG}</p></div>") == two
    assert h.main_text(f"<main><article><p>{LONG}</p><p>{LONG}</p></article><div id=comments><p>{LONG}</p></div></main>") == two


def test_unclosed_elements():
    assert h.main_text(f"<nav><a href=1>x</a><article><h1>A b<p><b>{LONG}<br><p>{LONG}</article><footer>f") == f"A b\n{LONG}\n{LONG}"
    assert h.main_text(f"<p>{LONG}</p><p>{LONG} 1 < 2<a href='x") == f"{LONG}\n{LONG} 1 < 2"
    assert h.main_text(f"<p title='a>b'>{LONG}</p>" + "<a href='x " * 3000) == LONG
    assert h.main_text("<script>" + "x" * 100) == "" and h.main_text(None) == ""


def plain(page):
    """Main text of the test tables' pages, read off their article element."""
    inner = re.search("(?s)<article>(.*)</article>", page)[1]
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(x for x in parts if x)


def test_whole_table(spark):
    got = h.op2_html_extract(spark, DATA).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert len(got) == len(pages) == 250
    for r in got:
        assert r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text)


def lines_right(pairs):
    """Line precision and recall of (got, wanted) texts."""
    got, want, both = Counter(), Counter(), Counter()
    for i, (g, w) in enumerate(pairs):
        g, w = Counter((i, x) for x in g.split("\n")), Counter((i, x) for x in w.split("\n"))
        got, want, both = got + g, want + w, both + (g & w)
    return both.total() / got.total(), both.total() / want.total()


def test_pages_without_names_or_elements(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    bare = pages.withColumn("html", F.regexp_replace("html", " (class|id|role)=(\"[^\"]*\"|[a-z]+)", ""))
    assert not bare.filter("html like '%class=%'").count()
    assert min(lines_right((r.text, want[r.page_id]) for r in h.extracted(bare).collect())) >= 0.97
    # neither names nor any element that tells its part: weights from pages that have them
    weights = h.weights_of(pages)
    plainest = bare.withColumn("html", F.regexp_replace("html", "<(/?)(article|nav|footer)>", "<$1div>"))
    assert min(lines_right((r.text, want[r.page_id]) for r in h.extracted(plainest, weights=weights).collect())) >= 0.9


def test_labels_that_only_the_cut_sets_right():
    page = h.page_of(f"<body><div><p>{LONG}</p><p>Yes no yes no yes no yes</p><div>Yes</div><p>{LONG}</p></div><div class=x><ul><li><a href=1>One two</a><li><a href=2>Two two</a><li>Nearly a whole sentence.<li><a href=3>Three two</a></ul></div></body>")
    score = h.costs(page.blocks)
    kept = h.min_cut(score, h.smoothness(page))
    assert [b.text for b, k in zip(page.blocks, kept) if k] == [LONG, "Yes no yes no yes no yes", "Yes", LONG]
    wrong = {b.text for b, s, k in zip(page.blocks, score, kept) if (s > 0) != k}
    assert wrong == {"Yes", "Nearly a whole sentence."}
    assert max(map(abs, score)) <= h.MOST < h.NEXT


def test_fit_starts_from_fixed_weights():
    assert (h.fitted([]) == h.PRIOR).all()
    rows = [([1.0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0], 1), ([1.0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0], 0)] * 200
    w = dict(zip(h.NAMES, h.fitted(rows)))
    assert w["links"] < h.FEATURES["links"] and w["base"] > h.FEATURES["base"]
    assert (h.fitted(rows) == h.fitted(rows[::-1])).all()


def test_deeply_nested_pages():
    for tag in ("div", "article", "nav", "div class=ad", "li", "table", "header"):
        began = time.time()
        h.main_text(f"<{tag}>" * 20_000 + LONG + "</b></section>" * 20_000)
        h.main_text(f"<{tag}>x" * 20_000)
        assert time.time() - began < 4, tag


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 1), (2, "u", "<article>" + f"<p>{LONG}" * 3000, 1), (2, "u", "<article>x", 1)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id or 0, r.n_chars) for r in h.extracted(pages).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (2, 3000 * (len(LONG) + 1) - 1)]
    assert h.extracted(pages.limit(0)).count() == 0


def test_raw_elements_without_an_end_take_linear_time():
    page = f"<article><p>{LONG}</p>" + "<svg><iframe><noscript>" * 60_000 + "</svg <p>" + f"<p>{LONG}</p></article>"
    began = time.time()
    assert h.main_text(page).startswith(LONG)
    assert time.time() - began < 5
    assert "hidden" not in h.main_text(f"<article><p>{LONG}</p><svg><p>hidden words here</p></svg><iframe>hidden</iframe><p>{LONG}</p></article>")
