"""Main texts of pages: the table's against a plain reading, odd markup by hand."""

import html
import re

from parchment.llm import html_text, queries


def _text(page, path=None):
    return html_text.main_text(page, path)


def test_table_pages(spark, sf):
    """Every page of the table has one article; its blocks begin at h1 and p."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op13_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search("(?s)<article>(.*?)</article>", pages[r.page_id].html)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in re.split("</?(?:h1|p)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_clutter_of_every_kind_goes():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h2>Site</h2></header><nav>Menu</nav>
    <div id="cookie-notice">We use cookies</div><div role="alert">Alarm</div><div class="layout sidebar-left"><div class="sidebar">Side</div><main><article class="post">
    <header><h1>Title &amp; more</h1><nav>toc</nav></header><p>First&nbsp;part <a href="x">link</a> of
    it.<br>Next<script>var a = "</p>";</script>.<div class="ad-slot">Buy</div><aside>Aside</aside><ul><li>One<li>Two</ul><table><tr><td>A<td>B<tr><td>C</table><pre>x
      y</pre><blockquote><p>Quoted</blockquote><form><input><button>Go</button>Form</form><p style="display: none">hidden</p><div class="share">Tweet</div><footer>By me</footer></article>
    <section id="comments"><article class="comment"><p>I like it, and I write a comment that is far longer than the article itself, just because I can do so here.</p></article></section></main></div>
    <div class="related"><article><p>Other</p></article></div><footer>&copy; us</footer></body></html>"""
    assert _text(page) == "Title & more\n\nFirst part link of it. Next.\n\nOne\n\nTwo\n\nA\n\nB\n\nC\n\nx y\n\nQuoted"


def test_broken_pages():
    pages = {None: "", "": "", "<": "<", "<p": "<p", "<!-- open <p>x": "", "<script>p": "", "plain &lt;b&gt; text": "plain <b> text", "<p>a<p>b": "a\n\nb", "<div>a</p>b</div></div>c": "ab\n\nc", "a<br/>b</i>": "a b", "<b><p>x</b>y</p>": "xy", "a < b > c": "a < b > c", "&#169;&copy;&copy &bad;": "©©© &bad;"}
    assert {p: _text(p) for p in pages} == pages
    assert _text("<a title='x>y'>t</a> <i a=\"b\" c>u</i> <x y='>z") == "t u z"
    deep = "<div>" * 30_000 + "deep" + "</div>" * 30_000
    assert _text(deep) == "deep" and _text("<p>" + "word " * 400_000).count("word") == 400_000


HOST = "<html><body><div class='c{k}'><p>{body}</p></div><div class='x'><p>{boiler}</p></div></body></html>"


def test_a_host_decides_by_vote(spark):
    """A short article beside long boilerplate without telling names: other pages of its host know the place."""
    long, short, boiler = "The article goes on and on. " * 40, "Brief.", "The same words stand at the foot of each page. " * 3
    rows = [(k, f"https://WWW.Site.org/{k}", HOST.format(k=k, body=long, boiler=boiler), "old") for k in range(9)] + [(9, "http://www.site.org?9", HOST.format(k=9, body=short, boiler=boiler), "old")]
    rows += [(10, None, HOST.format(k=1, body=long, boiler="b"), "x"), (11, "no scheme", None, None), (12, "http://empty.org/", "", ""), (12, "http://empty.org/", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").selectExpr("*", "1 AS parts", "2 AS host", "3 AS row", "4 AS n")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["page_id", "url", "html", "parts", "host", "row", "n", "path", "text"]
    by_id = {r.page_id: r for r in got}
    assert by_id[0].path == by_id[9].path == "body>div.c#" and by_id[9].text == "Brief." and by_id[0].text == " ".join(long.split())
    assert by_id[10].path is None and by_id[10].text == " ".join(long.split()) and by_id[11].text == by_id[12].text == ""
    assert html_text.extract(df.limit(0)).count() == 0
