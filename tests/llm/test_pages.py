"""Main text of pages: hand-made pages, and the given ones against their article element."""

import html
import re

from conftest import SMALL
from crewline.llm import templates

PAGE = """<html><head><title>x</title><script>var a = "</p>";</script></head><body><header class="site">Site</header>
<nav><ul><li><a>Menu</a></li></ul></nav><div class="ad">buy</div><div id="sidebar-left">side</div><main><article><h1>Ti&amp;tle</h1>
<p>First <b>bold</b><br>line&nbsp;two<p>Second   para <a href="x>y">link</a>.<div class="share-buttons">Share</div><ul><li>one<li>two</ul>
<form><input><p>sub</p></form><section class="comments"><p>bad comment</p></section><!-- <p>no</p> --><p>Last &lt;x&gt; &#8364;</article></main>
<footer>foot</footer></body></html>"""


def test_elements():
    assert templates.main_text(PAGE, set()).split("\n\n") == ["Ti&tle", "First bold line two", "Second para link.", "one", "two", "Last <x> €"]
    assert templates.main_text(None, set()) == templates.main_text("", set()) == templates.main_text("<p>", set()) == ""
    assert templates.main_text("a < b & c <p>d", set()) == "a < b & c\n\nd"


def test_names_of_wrappers():
    body = "<h1>Title</h1><p>A text that is long enough to be most of this page, in one paragraph.</p>"
    around = '<div class="site-footer">foot</div><div id="comments"><p>one</p><article class="comment">two</article></div>'
    want = ["Title", "A text that is long enough to be most of this page, in one paragraph."]
    for wrapper in ('class="content has-sidebar"', 'id="page" class="no-comments"', 'class="header-fixed modal"', 'id="widget"'):
        for page in (f"<div {wrapper}>{body}</div>{around}", f"<div {wrapper}><article>{body}</article>{around}</div>", f"<main><div {wrapper}>{body}</div></main>{around}"):
            assert templates.main_text(page, set()).split("\n\n") == want, page
    for name in ("article-header", "entry-header", "header"):
        page = f'<article class="post category-social"><div class="{name}"><h1>Title</h1></div><p>A text.</p><div class="share-buttons">share</div></article>{around}'
        assert templates.main_text(page, set()) == "Title\n\nA text."


def test_template_of_a_host(spark):
    def page(i):
        body = "".join(f"<div><div>Paragraph {i} {k} with words of its own that no other page of this host has at all.</div></div>" for k in range(3))
        return f"<body><div><span>Our Site</span></div><div><b>Choose wisely</b></div>{body}<div><i>All rights reserved</i></div></body>"

    rows = [(i, f"http://Host.example/{i}", page(i), "x") for i in range(12)] + [(20, "http://other.example/", page(3), "x"), (21, None, None, "x"), (22, "::", "<p>q", "x")]
    rows += [(30 + i, "http://copies.example/", page(5), "x") for i in range(9)] + [(30, "http://copies.example/", page(5), "x")]
    got = {r["page_id"]: r for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[4]["text"].split("\n\n")[0].startswith("Paragraph 4 0") and got[4]["text"].count("\n\n") == 2
    assert got[20]["text"].startswith("Our Site") and got[31]["text"] == got[30]["text"] == got[20]["text"].replace(" 3 ", " 5 ")
    assert (got[21]["text"], got[21]["n_chars"], got[22]["text"]) == ("", 0, "q")
    assert templates.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _site(spark, host, pages):
    return spark.createDataFrame([(i, f"http://{host}/{i}", "<body>" + "".join(f"<div>{x}</div>" for x in texts) + "</body>") for i, texts in enumerate(pages)], "page_id long, url string, html string")


def test_template_is_ordered(spark):
    # Two texts on every page, in changing order: only one of them can be part of the template.
    pages = [["Top", *(["left", "right"] if i % 2 else ["right", "left"]), f"own {i}", "Bottom"] for i in range(12)]
    got = {r["text"] for r in templates.extract(_site(spark, "a.example", pages)).collect()}
    assert got in ({f"right\n\nown {i}" for i in range(12)}, {f"left\n\nown {i}" for i in range(12)})
    # Turn by turn: the list of pairs is in order, the list of two lists is not.
    pairs = [["Top", *["name", "value"] * 3, f"own {i}", "Bottom"] for i in range(6)] + [["Top", *["name", "value"] * 2, f"own {i}", "Bottom"] for i in range(6, 12)]
    assert {r["text"] for r in templates.extract(_site(spark, "a.example", pairs)).collect()} == {f"own {i}" for i in range(12)}
    lists = [["Top", *["name"] * 3, *["value"] * 3, f"own {i}", "Bottom"] for i in range(6)] + [["Top", *["name"] * 2, *["value"] * 2, f"own {i}", "Bottom"] for i in range(6, 12)]
    assert all(r["text"].startswith("name\n\nname") for r in templates.extract(_site(spark, "a.example", lists)).collect())


def test_template_is_nested(spark):
    # The smaller class is on nine pages of twelve: in one slot of the larger, across its tokens, and now in this slot, now in that.
    inside = [["Top", *["x", "y"] * (i < 9), "Middle", f"own {i}", "Bottom"] for i in range(12)]
    across = [["Top", *["x"] * (i < 9), "Middle", *["y"] * (i < 9), f"own {i}", "Bottom"] for i in range(12)]
    moving = [["Top", *["x", "y"] * (i < 5), "Middle", *["x", "y"] * (5 <= i < 9), f"own {i}", "Bottom"] for i in range(12)]
    got = [{r["page_id"]: r["text"] for r in templates.extract(_site(spark, "a.example", pages)).collect()} for pages in (inside, across, moving)]
    assert got[0] == {i: f"own {i}" for i in range(12)}
    assert got[1] == got[2] == {i: ("x\n\ny\n\n" if i < 9 else "") + f"own {i}" for i in range(12)}


def test_long_template_text_goes_and_headings_of_articles_stay(spark):
    notice = " ".join(f"word{k}" for k in range(30))
    got = templates.extract(_site(spark, "a.example", [["Top", notice, f"own {i}"] for i in range(8)])).collect()
    assert {r["text"] for r in got} == {f"own {i}" for i in range(8)}
    articles = [[f"<article><h2>Introduction</h2><p>own {i}</p><p>Share this</p></article>"] for i in range(8)]
    assert {r["text"] for r in templates.extract(_site(spark, "a.example", articles)).collect()} == {f"Introduction\n\nown {i}" for i in range(8)}


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in templates.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(x for x in parts if x)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])
