from __future__ import annotations

import html
import re
import time

import pyarrow.parquet as pq
import pytest

from vitrine.llm import main_text as M

TREE = M.train_tree()


def text(page):
    return M.main_text(page, TREE)[0]


def article_of(page):
    """Reference for the test pages: blocks of their one article element."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", inner)
    plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n".join(x for x in plain if x)


def test_pages_of_the_tables(spark):
    for sf in ("sf0.001", "sf0.01"):
        t = pq.read_table(f"/root/testdata/{sf}/pages.parquet").to_pydict()
        for page in t["html"]:
            assert text(page) == article_of(page)
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert all(r.n_chars == len(r.text) > 0 for r in M.extract(df).collect())


PAGE = """<!doctype html><html><head><title>T &amp; x</title><style>p{}</style></head><body class="has-sidebar">
<div id="cookie-notice"><p>We use cookies, and so does everybody else who writes long notices about it on every page.</p></div>
<header class="site-header"><h2>The Site</h2><a href=/>Home</a></header><ul class="menu"><li><a href=1>One</a><li><a href=2>Two</a></ul>
<main><h1>A &lt;title&gt;</h1><div class="share"><a href=x>Share</a></div>
<p>First   paragraph &amp; its<br>second line, with <a href=z>a link</a>, an <b>unclosed bold word and plenty of other words in it.
<p>Second<!-- <p>no</p> --> one.<script>if (a<b) document.write("<p>bad</p>")</script>
<p class="advert">Buy now, and buy a lot of it because it is cheap today and tomorrow.</p><ul><li>item one of the list<li>item two of the list</ul>
<form><label>Your mail</label><input><button>Send</button></form>
</main><section id="comments"><p>I liked this article a lot and write a long comment about it, as readers do at night.</p></section>
<aside><p>Related things that you may like to read as well.</p></aside><footer><p>&copy; all of it</p></footer>"""


def test_parts_of_a_page():
    assert text(PAGE).split("\n") == [
        "A <title>",
        "First paragraph & its second line, with a link, an unclosed bold word and plenty of other words in it.", "Second one.",
        "item one of the list", "item two of the list"]


def test_without_article_element():
    long = " ".join(["word"] * 60)
    page = f"<body><div><a href=1>Home</a></div><div><a href=2>News</a></div><h1>A heading of words</h1><p>{long}</p><p>{long}</p><div>© me</div>"
    assert text(page) == f"A heading of words\n{long}\n{long}"


def test_wrappers_are_no_asides():
    one, two = " ".join(["alpha"] * 60), " ".join(["beta"] * 45)
    menu, aside = '<ul class="menu"><li><a href=1>One</a></ul>', "<p>Other things that people wrote about here as well.</p>"
    for names in ('class="content has-sidebar"', 'id="page" class="no-sidebar"', 'class="elementor-widget-container"',
                  'class="widget"', 'class="search-container"'):
        inner = f"<header class=entry-header><h1>The headline</h1></header><p>{one}</p><p>{two}</p>"
        later = f'<div id="comments">{aside}</div><div class="sidebar">{aside}</div>'
        assert text(f"{menu}<div {names}><article>{inner}</article>{later}</div>") == f"The headline\n{one}\n{two}", names
        assert text(f"{menu}<div {names}><h1>The headline</h1><p>{one}</p><p>{two}</p>{later}</div>") == f"The headline\n{one}\n{two}", names
    for header in ('<header class="entry-header">%s</header>', '<div class="post-header">%s</div>', '<header class="header">%s</header>'):
        page = f"<article>{header % '<h1>The headline</h1>'}<p>{one}</p></article>"
        assert text(page) == f"The headline\n{one}", header


def test_named_parts_stay_asides():
    one, long = " ".join(["alpha"] * 60), " ".join(["reply"] * 90)
    for names in ('id="cookie-notice"', 'class="site-footer"', 'class="comment-list"', 'id=comments', 'class="related-posts"', 'class="x sidebar"'):
        assert text(f"<article><p>{one}</p><div {names}><p>{long}</p></div></article>") == one, names
        assert text(f"<article><p>{one}</p></article><div {names}><p>{long}</p></div>") == one, names


def test_edges(spark):
    for page in (None, "", "   ", "<", "<p", "<!--", "<script>", "</p></div>", "<nav><a href=1>x</a></nav>"):
        assert text(page) == ""
    assert text("<article><p>a < b &amp &a &#65;&#x42;</p>") == "a < b & &a AB"
    assert text('<article><p title="a > b">in</p><p title="open>out') == "in\nout"  # an unclosed quote ends with its tag
    rows = [(1, "u", None, 3), (1, "u", None, 3), (None, None, "<article><p>x y</p>", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted(map(tuple, M.extract(df).collect()), key=repr) == sorted(
        [(1, "u", "", 0, 0, 0)] * 2 + [(None, None, "x y", 3, 1, 1)], key=repr)
    assert M.extract(df.limit(0)).count() == 0


def test_long_pages_take_linear_time():
    for unit in ("<b>", "<div>", "<p>a</p>", "<a \"", "<!--", "&", "<script>", "</x>", "<p class='"):
        start = time.process_time()
        text("<article>" + unit * 30_000)
        assert time.process_time() - start < 20, unit


def test_tree_learns_its_table():
    wrong = sum(M.is_main(TREE, list(r[:-1])) != bool(r[-1]) for r in M.LABELLED)
    assert wrong == 0
    assert M.train_tree([(1, 0), (2, 1)], 3) == (0, 1.5, False, True)
    assert M.train_tree([(1, 1)], 3) is True


PARAGRAPHS = [" ".join(f"{w}{i}" for i in range(45)) for w in ("river", "stone", "cloud")]
REMARK = "Great read says one visitor who wrote this remark below the story and went on for a while " * 2


def page_with(attributes, inside="article"):
    story = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    return f"<html><body><{inside}><h1>A fine title</h1>{story}</{inside}><div {attributes}><p>{REMARK}</p></div></body></html>"


@pytest.mark.parametrize("name", [
    "reader-comments", "user-comments", "post-comments", "article-comments", "ad-slot", "left-sidebar", "sidebar-left", "blog-sidebar",
    "sidebar__inner", "related-articles", "modal-content", "dropdown-menu", "page-footer", "comments", "cookie-notice", "advertisement"])
@pytest.mark.parametrize("inside", ["article", "div"])
def test_named_elements_beside_the_article(name, inside):
    for attributes in (f'class="{name}"', f"id='{name}'", f'class="block {name} wide"'):
        text, _, _ = M.main_text(page_with(attributes, inside), TREE)
        assert "remark" not in text and all(p in text for p in PARAGRAPHS) and "A fine title" in text


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', 'style="color: red; display : none"', 'aria-hidden="true"', "style='visibility:hidden'"])
def test_hidden_elements(attributes):
    assert "remark" not in M.main_text(page_with(attributes), TREE)[0]


@pytest.mark.parametrize("attributes", [
    'aria-label="A hidden gem"', 'data-title="the hidden valley"', 'class="has-sidebar"', 'class="no-sidebar"', 'class="elementor-widget"',
    'title="display: none"', 'aria-hidden="false"', 'class="content with-comments"', "hidden", 'class="left-sidebar"'])
def test_wrappers_keep_their_article(attributes):
    story = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    for tag in ("section", "div"):
        page = f"<html><body><{tag} {attributes}><article><header class='entry-header'><h1>A fine title</h1></header>{story}</article></{tag}></body></html>"
        text = M.main_text(page, TREE)[0]
        assert all(p in text for p in PARAGRAPHS) and "A fine title" in text
