"""Element job, selector predicates and page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vitrine.operators.elements import element_text, elements, parse_page
from vitrine.operators.extract import link_records, listing_cards, next_pages, product_records_p2
from vitrine.operators.selectors import RAW, TEXT, TEXT_SP, apply_rules, matches
from vitrine.plans.jobs import listing_page_records
from vitrine.plans.page_queries import SITE_SELECTORS

HTML = ("<html><head><title> T &amp; co </title><script>var t=\"</p>\";</script></head><body>"
        "<nav class='breadcrumb'><a href='/'>Home</a><a href='/c/x'>Women</a></nav><!-- c -->"
        "<main><div class='product-single'><h1 class='product-title'> Red  <b>Coat</h1>"
        "<span class='price'>139,00 EUR</span><br><img src='//cdn.x/files/red_coat_1.jpg' alt='coat'>"
        "</div></main></body></html>")


def test_parse_elements_text_and_repair():
    elems, nodes = parse_page(HTML)
    els = {e[3]: e for e in elems}

    def txt(tag, sep=""):
        e = els[tag]
        return element_text(nodes, e[7], e[8], tag, sep)

    assert txt("title") == "T & co"                           # entities decoded, text stripped
    assert txt("h1") == "RedCoat"                             # strip=True joins nodes without blanks
    assert txt("h1", " ") == "Red Coat"
    assert els["script"][11] == 'var t="</p>";'               # script body kept whole
    assert "var t" not in txt("head")                          # and not part of the parent's text
    img = els["img"]
    assert [a[1] for a in img[12]][-2:] == ["main", "div"]


def test_selector_predicates(spark):
    pages = spark.createDataFrame([(1, "https://shop.example.com/products/red-coat-1", HTML)],
                                  "page_id bigint, url string, html string")
    els = elements(pages)
    r = apply_rules(els, ["page_id"], [
        ("t", matches("h1.product-title"), TEXT_SP, "first"),
        ("crumb", matches("nav.breadcrumb a[href^='/c']"), TEXT, "first"),
        ("img", matches("main [class*='product'] img"), F.col("attrs")["src"], "first"),
        ("p", matches("span:not(.price), .price"), TEXT, "first"),
        ("raw", matches("title"), RAW, "first"),
        ("links", matches("a, img"), F.col("tag"), "all")]).first()
    assert (r.t, r.crumb, r.img, r.p, len(r.links)) == ("Red Coat", "Women", "//cdn.x/files/red_coat_1.jpg",
                                                        "139,00 EUR", 3)
    assert r.raw == " T & co "


def test_product_record_p2(spark):
    pages = spark.createDataFrame([(1, "https://shop.example.com/products/red-coat-1", HTML)],
                                  "page_id bigint, url string, html string")
    r = product_records_p2(pages, SITE_SELECTORS, brand="Shop").first()
    assert r.title == "RedCoat" and r.price == "139,00 EUR" and r.external_id == "1"
    assert r.image_url == "https://cdn.x/files/red_coat_1.jpg"
    assert r.gender == "women"                                 # from the breadcrumb


def test_listing_and_next_pages(spark):
    from vitrine.sources.page_fixtures import listing_pages

    lp = listing_pages(spark, SF_SMALL)
    cards = listing_cards(lp, dict(SITE_SELECTORS, product_url="a[href*='/products/']"))
    n_parts = spark.read.parquet(f"{SF_SMALL}/part.parquet").where("p_partkey % 4 in (0, 2)").count()
    assert cards.count() == n_parts
    nxt = next_pages(lp).collect()
    assert all(r.next_url.endswith(f"page={r.page_id + 1}") for r in nxt)


def test_link_fallback(spark):
    html = ("<div><p><a href='/products/red-knit-12'>Red Knit Sweater XL 12 EUR</a> 45,50 EUR "
            "<img src='/i/red_knit.jpg'></p><a href='/products/gift-card'>Gift card</a>"
            "<a href='/products/red-knit-12'>again</a></div>")
    pages = spark.createDataFrame([(7, "https://shop.example.com/collections/all", html)],
                                  "page_id bigint, url string, html string")
    rows = link_records(pages, {"product_url": "a[href*='/products/']"}).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.product_url == "https://shop.example.com/products/red-knit-12"
    assert r.title == "Red Knit Sweater" and r.price == "45,50 EUR"
    assert r.image_url == "https://shop.example.com/i/red_knit.jpg" and r.external_id == "12"
    both = listing_page_records(pages, {"products": ".product-card", "product_url": "a[href*='/products/']"})
    assert both.count() == 1


def test_pages_join_their_site_spec(spark):
    from vitrine.operators.records import with_site_constants
    from vitrine.sources.sites import DEFAULT_SPEC_PATH, categories_frame, pages_with_site, sites_frame

    sites = sites_frame(spark, DEFAULT_SPEC_PATH)
    assert [r.category_url for r in categories_frame(sites).collect()] == [
        "https://shop.example.com/collections/all?page=0"]
    pages = spark.createDataFrame([(1, "https://SHOP.example.com/products/a-1"), (2, "https://other.example/x")],
                                  "page_id bigint, url string")
    rows = {r.page_id: r for r in with_site_constants(pages_with_site(pages, sites), sites).collect()}
    assert rows[1].site == "shop" and rows[1].source == "shop-example" and rows[1].country == "eu"
    assert rows[2].site is None and rows[2].source is None and rows[2].country == "eu"
    assert rows[1].second_hand is False


def test_implied_end_tags():
    elems, nodes = parse_page("<body><p><b>a<br><p>b</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></body>")
    by_tag = {}
    for e in elems:
        by_tag.setdefault(e[3], []).append(e)
    ps = by_tag["p"]
    assert [element_text(nodes, e[7], e[8], "p") for e in ps] == ["a", "b"]
    assert ps[0][1] == ps[1][1]                                   # siblings, not nested
    assert [element_text(nodes, e[7], e[8], "li") for e in by_tag["li"]] == ["x", "y"]
    assert [element_text(nodes, e[7], e[8], "td") for e in by_tag["td"]] == ["1", "2"]


def test_page_without_elements_still_yields_a_record(spark):
    pages = spark.createDataFrame([(9, "https://shop.example.com/products/blue-coat-9", ""),
                                   (10, "https://shop.example.com/products/red-hat-10", "just text")],
                                  "page_id bigint, url string, html string")
    rows = {r.page_id: r for r in product_records_p2(pages, SITE_SELECTORS, brand="Shop").collect()}
    assert rows[9].title == "Blue Coat 9" and rows[9].price is None       # title from the URL slug
    assert rows[10].title == "Red Hat 10" and rows[10].external_id == "10"


def test_descendant_steps_keep_their_order(spark):
    html = ("<html><body><div class='product'><main><p><img src='/a.jpg'></p></main></div>"
            "<main><div class='product'><img src='/b.jpg'></div></main></body></html>")
    pages = spark.createDataFrame([(1, "https://x.example/", html)], "page_id bigint, url string, html string")
    r = apply_rules(elements(pages), ["page_id"], [
        ("imgs", matches("main [class*='product'] img"), F.col("attrs")["src"], "all")]).first()
    assert r.imgs == ["/b.jpg"]                 # /a.jpg has the product block above main, not below


def test_selector_grammar(spark):
    html = ("<div id='main' class='a b'><a href='/x.jpg' data-k=''>1</a><a href='https://cdn/y.png'>2</a>"
            "<span class='price sale'>3</span><span class='price'>4</span></div>")
    pages = spark.createDataFrame([(1, "https://x.example/", html)], "page_id bigint, url string, html string")
    tag = F.col("tag")
    r = apply_rules(elements(pages), ["page_id"], [
        ("by_id", matches("#main"), tag, "first"),
        ("two_classes", matches("div.a.b"), tag, "first"),
        ("ends", matches("a[href$='.png']"), TEXT, "first"),
        ("starts", matches("a[href^='/']"), TEXT, "first"),
        ("present", matches("a[data-k]"), TEXT, "first"),
        ("equals", matches("a[href='https://cdn/y.png']"), TEXT, "first"),
        ("not_sale", matches(".price:not(.sale)"), TEXT, "first"),
        # a comma list takes the first match in document order, not the first member
        ("comma", matches(".price:not(.sale), .sale"), TEXT, "first"),
        ("under_id", matches("#main span"), TEXT, "all")]).first()
    assert (r.by_id, r.two_classes) == ("div", "div")
    assert (r.ends, r.starts, r.present, r.equals) == ("2", "1", "1", "2")
    assert (r.not_sale, r.comma, r.under_id) == ("4", "3", ["3", "4"])


def test_unsupported_selector_is_rejected():
    import pytest

    with pytest.raises(ValueError):
        matches("div > a")


def test_element_rows_keep_nested_values():
    """The batches that the element job builds from flat lists hold what ``parse_page`` found."""
    import pyarrow as pa

    from vitrine.operators.elements import _element_batches, parse_page

    htmls = ["<div id=a class='u v'><p>x<b title>y</b></p><script>s</script></div>", None, "", "bare", "<li>a<li>b<br/>"]
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array([0, None, 2, 3, 4], pa.int64()), "url": ["u", None, "v", "w", ""], "html": htmls})
    got = pa.Table.from_batches(list(_element_batches([batch]))).to_pylist()
    at = 0
    for page_id, url, html in zip([0, None, 2, 3, 4], ["u", None, "v", "w", ""], htmls, strict=True):
        elems, nodes = parse_page(html)
        elems = elems or [(0, -1, 0, "#document", None, [], {}, 0, len(nodes), None, None, None, [])]
        for k, e in enumerate(elems):
            row, at = got[at], at + 1
            assert (row["page_id"], row["url"]) == (page_id, url)
            assert tuple(row[c] for c in ("idx", "parent_idx", "depth", "tag", "elem_id", "classes")) == e[:6]
            assert dict(row["attrs"]) == e[6]
            assert tuple(row[c] for c in ("t0", "t1", "p_t0", "p_t1", "raw_text")) == e[7:12]
            assert [tuple(a.values()) for a in row["ancestors"]] == [tuple(a) for a in e[12]]
            assert row["nodes"] == (None if k else [{"raw": r, "strip": st, "skip": sk} for r, st, sk in nodes])
    assert at == len(got)
