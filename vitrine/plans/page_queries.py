"""Registered page queries: product pages, listings, links, next pointers,
titles and page profiles. Product and listing pages are rendered from
``part``; their oracles compute the expected fields straight from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import classify as C
from vitrine.functions.urls import absolutize
from vitrine.operators.elements import elements
from vitrine.operators.extract import (listing_cards, next_pages, product_links, product_records_p1,
                                       product_records_p2)
from vitrine.operators.selectors import RAW, TEXT, apply_rules, matches
from vitrine.plans import sqlparts as S
from vitrine.plans.scalar_queries import _kw_cat
from vitrine.sources.page_fixtures import GARMENTS, LISTING_SIZE, listing_pages, product_pages
from vitrine.sources.fixtures import with_fixtures
from vitrine.sources.sites import DEFAULT_SPEC_PATH, load_spec
from vitrine.sources.tables import read_pages

# Selectors of the rendered shop, from its site file.
SITE_SELECTORS = load_spec(DEFAULT_SPEC_PATH)["shop"]["selectors"]
BRAND = "Shop"
# What the page profile counts (candidate containers, price
# shapes and shop texts).
PROFILE_CONTAINERS = [".product-item", ".grid-item", ".product", ".item", '[class*="product"]',
                      '[class*="item"]', "article", ".card", '[class*="card"]']
PROFILE_PRICE = [r"\d+,\d+\s*EUR", r"\d+\.\d+\s*EUR", r"\d+,\d+", r"\d+\.\d+"]
PROFILE_TEXT = ["EUR", "new in", "NEW ", "+1"]


def q_product_page_p2(spark, sf_dir):
    r = product_records_p2(product_pages(spark, sf_dir), SITE_SELECTORS, brand=BRAND)
    return r.select("page_id", "product_url", "external_id", "title", "price", "sale", "image_url",
                    "additional_images", "size", "gender", "description", "category")


def q_product_page_p1(spark, sf_dir):
    r = product_records_p1(product_pages(spark, sf_dir))
    return r.select("page_id", "handle", "title", "price", "image_url", "additional_images", "gender",
                    "category", "description", "size")


def q_listing_links(spark, sf_dir):
    return product_links(listing_pages(spark, sf_dir))


def q_listing_cards(spark, sf_dir):
    sel = dict(SITE_SELECTORS, product_url="a[href*='/products/']")
    r = listing_cards(listing_pages(spark, sf_dir), sel)
    return r.select("page_id", "product_url", "external_id", "title", "price", "image_url")


def q_next_page(spark, sf_dir):
    return next_pages(listing_pages(spark, sf_dir))


def q_page_titles(spark, sf_dir):
    """E6 on raw pages: first ``h1`` text and the ``title`` text, per page."""
    els = elements(read_pages(spark, sf_dir))
    return apply_rules(els, ["page_id"], [("h1", matches("h1"), TEXT, "first"),
                                          ("title", matches("title"), TEXT, "first")])


def q_page_links(spark, sf_dir):
    """X6 + A3: every link of every page made absolute, distinct."""
    els = elements(read_pages(spark, sf_dir)).where((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull())
    return els.select(absolutize(F.col("attrs")["href"], F.col("url")).alias("link")).distinct()


def q_page_profile(spark, sf_dir):
    """Per page, counts of product links, price shapes and shop texts."""
    pg = read_pages(spark, sf_dir)
    text = F.regexp_replace("html", "<[^>]*>", " ")
    cols = [F.size(F.regexp_extract_all("html", F.lit(r'href="[^"]*/products/[^"]*"'), 0)).alias("n_product_links")]
    cols += [F.regexp_count(text, F.lit(p)).alias(f"n_price_{i}") for i, p in enumerate(PROFILE_PRICE)]
    cols += [F.regexp_count(text, F.lit(_esc(t))).alias(f"n_text_{i}") for i, t in enumerate(PROFILE_TEXT)]
    return pg.select("page_id", *cols)


def q_page_containers(spark, sf_dir):
    """Per page, elements matching each candidate container selector."""
    els = elements(read_pages(spark, sf_dir))
    return els.groupBy("page_id").agg(*[
        F.sum(matches(sel).cast("int")).cast("bigint").alias(f"n_container_{i}")
        for i, sel in enumerate(PROFILE_CONTAINERS)])


def q_page_gender(spark, sf_dir):
    """E12 pieces on raw pages: gender from URL, title and h1 in both match modes."""
    els = elements(read_pages(spark, sf_dir))
    g = apply_rules(els, ["page_id", "url"], [("t", matches("title"), RAW, "first"),
                                              ("h", matches("h1"), RAW, "first")])
    chain = lambda m: F.coalesce(C.gender_generic(F.col("url"), m), C.gender_title(F.col("t"), m),
                                 C.gender_title(F.col("h"), m))
    return g.select("page_id", chain("substring").alias("gender_substring"), chain("word").alias("gender_word"))


def _esc(t: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in t)


DYNAMIC_SELECTORS = {"products": ".product-card", "product_url": "a[href*='/products/']", "title": "a",
                     "price": ".price", "sale": ".sale-price", "image_url": "img"}


def q_listing_dynamic(spark, sf_dir):
    """E4 + E13 + E15 + F5 + F10 over listing snapshots."""
    from vitrine.operators.extract import listing_cards_dynamic

    r = listing_cards_dynamic(listing_pages(spark, sf_dir), DYNAMIC_SELECTORS)
    return r.select("page_id", "product_url", "external_id", "title", "price", "sale", "image_url",
                    "additional_images", "gender", "category")


def q_p1_variants(spark, sf_dir):
    """Variants of the embedded product state, one row each."""
    r = product_records_p1(product_pages(spark, sf_dir)).where(F.col("variants").isNotNull())
    v = r.select("page_id", F.explode("variants").alias("v"))
    return v.select("page_id", F.col("v.title").alias("variant"), F.col("v.price_eur").alias("price_eur"),
                    F.col("v.sku").alias("sku"), F.col("v.available").alias("available"))


def q_p1_metadata(spark, sf_dir):
    """The record's metadata JSON (state JSON fields when present)."""
    return product_records_p1(product_pages(spark, sf_dir)).select("page_id", "metadata")


def q_link_fallback(spark, sf_dir):
    """Pages without containers fall back to link-only records."""
    from vitrine.plans.jobs import listing_page_records

    sel = dict(SITE_SELECTORS, products=".product-item")
    r = listing_page_records(listing_pages(spark, sf_dir), sel)
    return r.select("page_id", "product_url", "external_id", "title", "price", "image_url")


def q_new_links(spark, sf_dir):
    """O2: product links on the listing pages that the stored catalog lacks."""
    from vitrine.sources.fixtures import catalog_old

    known = catalog_old(spark, sf_dir).select("product_url")
    return product_links(listing_pages(spark, sf_dir)).join(known, "product_url", "left_anti")


def q_page_sites(spark, sf_dir):
    """Every page (raw, listing, product) joined to its site spec by host."""
    from vitrine.sources.sites import DEFAULT_SPEC_PATH, pages_with_site, sites_frame

    allp = (read_pages(spark, sf_dir).select("page_id", "url")
            .unionByName(listing_pages(spark, sf_dir).select("page_id", "url"))
            .unionByName(product_pages(spark, sf_dir).select("page_id", "url")))
    j = pages_with_site(allp, sites_frame(spark, DEFAULT_SPEC_PATH))
    return j.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))


QUERIES = {
    "listing_dynamic": q_listing_dynamic,
    "p1_variants": q_p1_variants,
    "p1_metadata": q_p1_metadata,
    "link_fallback": q_link_fallback,
    "new_links": q_new_links,
    "page_sites": q_page_sites,
    "product_page_p2": q_product_page_p2,
    "product_page_p1": q_product_page_p1,
    "listing_links": q_listing_links,
    "listing_cards": q_listing_cards,
    "next_page": q_next_page,
    "page_titles": q_page_titles,
    "page_links": q_page_links,
    "page_profile": q_page_profile,
    "page_containers": q_page_containers,
    "page_gender": q_page_gender,
}

# ---------------------------------------------------------------- DuckDB side

_P = "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR)"
_SALE = "CAST(CAST(p_retailprice - 10 AS DECIMAL(18,2)) AS VARCHAR)"
_SLUG = "replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR)"
_U = f"'https://shop.example.com/products/' || {_SLUG}"
_IMG = f"'https://cdn.example.com/files/' || replace({S.initcap('p_name')}, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR)"
_GARMENT = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(GARMENTS)) + " END"
_DESC_G = ("CASE p_partkey % 4 WHEN 0 THEN 'for men''s wear' WHEN 1 THEN 'for women''s wear' "
           "WHEN 2 THEN 'unisex fit' ELSE 'everyday piece' END")
_DESC = f"p_name || ' ' || {_GARMENT} || ' in ' || p_type || ', ' || {_DESC_G}"


def _first_gender() -> str:
    from vitrine.plans.scalar_queries import _gender_generic as g, _has_any
    from vitrine.operators.extract import TITLE_MEN, TITLE_WOMEN
    title = (f"CASE WHEN {_has_any('p_name', TITLE_WOMEN, 'substring')} THEN 'women' "
             f"WHEN {_has_any('p_name', TITLE_MEN, 'substring')} THEN 'men' END")
    return f"coalesce({g(_U, 'substring')}, {title})"


def _container_sql(sel: str) -> str:
    """DuckDB test on one start tag ``t`` for a one-step selector: tag name,
    class token (``.x``) or class substring (``[class*="x"]``)."""
    cls = "coalesce(regexp_extract(t, 'class=\"([^\"]*)\"', 1), '')"
    if sel.startswith("."):
        return f"list_contains(string_split_regex({cls}, '\\s+'), '{sel[1:]}')"
    if sel.startswith("[class*="):
        return f"contains({cls}, '{sel.split(chr(34))[1]}')"
    return f"regexp_matches(t, '^<{sel}[\\s>/]')"


def _entities(e: str) -> str:
    """Decode the entities the test pages use; like HTML5 (and Python's
    parser) the legacy names also decode without their ';'."""
    return (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({e}, '&quot;?', '\"', 'g'), "
            f"'&middot;?', chr(183), 'g'), '&copy;?', chr(169), 'g'), '&amp;?', '&', 'g')")


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def _gender_generic(t: str, mode: str) -> str:
    from vitrine.plans.scalar_queries import _gender_generic as g
    return g(t, mode)


def _gender_title(t: str, mode: str) -> str:
    from vitrine.functions import classify as C
    from vitrine.plans.scalar_queries import _first, _has_any
    return _first([(_has_any(t, C.TITLE_WOMEN, mode), "women"), (_has_any(t, C.TITLE_MEN, mode), "men")])


_TITLE_SQL = _entities("regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)")
_H1_SQL = _entities("regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)")

_LINKS = f"""
SELECT DISTINCT product_url FROM (
  SELECT CASE p_partkey % 4 WHEN 0 THEN {_U} WHEN 1 THEN {_U} || '?variant=1' WHEN 2 THEN {_U} || '/quick-view'
              ELSE {_U} END AS product_url FROM part
  UNION ALL
  SELECT 'https://shop.example.com/products/gift-card-' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 4 = 3)"""
_IMG_URL = f"{_IMG} || '_1.jpg'"


def _coarse_sql(t: str) -> str:
    from vitrine.functions import classify as C
    from vitrine.plans.scalar_queries import _first, _has_any
    return _first([(_has_any(t, terms, "substring"), c) for c, terms in C.COARSE_TERMS])


def _desired_sql(u: str) -> str:
    from vitrine.plans.scalar_queries import _desired
    return _desired(u)


def _link_title(t: str) -> str:
    cut = f"string_split(string_split({t}, ' EUR')[1], ' +')[1]"
    cleaned = f"trim(regexp_replace({cut}, '\\b(XS|S|M|L|XL|XXL|\\d+)\\b', '', 'g'))"
    return f"CASE WHEN length({t}) > 10 AND {cleaned} <> '' THEN {cleaned} END"


ORACLES = {
    "listing_dynamic": f"""
SELECT p_partkey // {LISTING_SIZE} AS page_id, {_U} AS product_url, {_SLUG} AS external_id, p_name AS title,
  replace({_P}, '.', ',') || ' EUR' AS price,
  CASE WHEN p_partkey % 8 = 0 THEN replace({_SALE}, '.', ',') || ' EUR' END AS sale,
  {_IMG_URL} AS image_url, CAST(NULL AS VARCHAR) AS additional_images,
  {_first_gender()} AS gender,
  coalesce({_coarse_sql(_U)}, {_coarse_sql('p_name')}, {_kw_cat('p_name', 'substring')}, 'other') AS category
FROM part WHERE p_partkey % 4 = 0 AND {_desired_sql(_IMG_URL)}""",
    "p1_variants": f"""
SELECT p_partkey AS page_id, v.variant, v.price_eur, v.sku, v.available FROM part,
  (SELECT unnest([
     {{'variant': CAST(p_size AS VARCHAR), 'price_eur': CAST(CAST(CAST(round(p_retailprice * 100) AS BIGINT) / 100
        AS DECIMAL(18,2)) AS VARCHAR) || 'EUR', 'sku': 'SKU-' || CAST(p_partkey AS VARCHAR), 'available': true}},
     {{'variant': 'Default Title', 'price_eur': CAST(CAST(CAST(round(p_retailprice * 100) AS BIGINT) / 100
        AS DECIMAL(18,2)) AS VARCHAR) || 'EUR', 'sku': 'SKU-' || CAST(p_partkey AS VARCHAR) || '-D',
      'available': false}}]) AS v)
WHERE p_partkey % 5 = 4""",
    "p1_metadata": f"""
SELECT page_id, CAST(CASE WHEN has_state THEN
    json_object('title', title, 'description', description, 'price', price, 'category', category,
                'gender', gender, 'sizes', [CAST(p_size AS VARCHAR)], 'colors', CAST([] AS VARCHAR[]),
                'product_type', 'Woman ' || p_type, 'vendor', 'Shop', 'tags', CAST([] AS VARCHAR[]),
                'variants', [{{'title': CAST(p_size AS VARCHAR), 'price_eur': minor, 'sku': 'SKU-' || CAST(page_id AS VARCHAR),
                               'available': true}},
                             {{'title': 'Default Title', 'price_eur': minor,
                               'sku': 'SKU-' || CAST(page_id AS VARCHAR) || '-D', 'available': false}}])
  ELSE json_object('title', title, 'description', description, 'price', price, 'category', category,
                   'gender', gender, 'sizes', CAST([] AS VARCHAR[]), 'colors', CAST([] AS VARCHAR[])) END AS VARCHAR)
  AS metadata
FROM (
  SELECT p_partkey AS page_id, p_size, p_type, p_partkey % 5 = 4 AS has_state,
    CASE WHEN p_partkey % 5 = 4 THEN p_name WHEN p_partkey % 3 = 0 THEN p_name
         WHEN p_partkey % 3 = 1 THEN 'All Products' ELSE 'Collection' END AS title,
    CASE WHEN p_partkey % 5 = 4 THEN p_name || ' made to last' ELSE '' END AS description,
    CAST(CAST(CAST(round(p_retailprice * 100) AS BIGINT) / 100 AS DECIMAL(18,2)) AS VARCHAR) || 'EUR' AS minor,
    CASE WHEN p_partkey % 6 = 0 THEN {_P} || 'EUR'
         WHEN p_partkey % 5 = 4 THEN CAST(CAST(CAST(round(p_retailprice * 100) AS BIGINT) / 100 AS DECIMAL(18,2))
                                          AS VARCHAR) || 'EUR'
         ELSE '' END AS price,
    CASE WHEN p_partkey % 5 = 4 AND lower(p_type) = 'standard' THEN 'Woman ' || p_type ELSE p_type END AS category,
    CASE WHEN p_partkey % 5 = 4 THEN 'women' ELSE '' END AS gender
  FROM part)""",
    "link_fallback": f"""
SELECT p_partkey // {LISTING_SIZE} AS page_id,
  CASE p_partkey % 4 WHEN 1 THEN {_U} || '?variant=1' WHEN 2 THEN {_U} || '/quick-view' ELSE {_U} END AS product_url,
  CAST(p_partkey AS VARCHAR) AS external_id,
  CASE WHEN p_partkey % 4 = 2 THEN NULL ELSE {_link_title('p_name')} END AS title,
  CASE WHEN p_partkey % 4 = 0 THEN replace({_P}, '.', ',') || ' EUR' END AS price,
  CASE WHEN p_partkey % 4 = 0 THEN {_IMG_URL} END AS image_url
FROM part""",
    "new_links": f"""{with_fixtures("catalog_old")}, links AS ({_LINKS})
SELECT product_url FROM links EXCEPT SELECT product_url FROM catalog_old""",
    "page_sites": f"""
SELECT CAST(NULL AS VARCHAR) AS site, count(*) AS pages FROM pages
UNION ALL
SELECT 'shop' AS site, (SELECT count(DISTINCT p_partkey // {LISTING_SIZE}) FROM part) + count(*) AS pages FROM part""",
    "product_page_p2": f"""
SELECT p_partkey AS page_id, {_U} AS product_url, CAST(p_partkey AS VARCHAR) AS external_id, p_name AS title,
  CASE p_partkey % 6 WHEN 0 THEN {_P} || ' EUR' WHEN 2 THEN {_P} || ' EUR' ELSE {_P} END AS price,
  CASE WHEN p_partkey % 7 = 0 THEN {_SALE} || ' EUR' END AS sale,
  {_IMG} || '_1.jpg' AS image_url, {_IMG} || '_2.jpg' AS additional_images,
  CAST(p_size AS VARCHAR) || CAST(p_size + 1 AS VARCHAR) || ', '
    || CAST(p_size AS VARCHAR) || ', ' || CAST(p_size + 1 AS VARCHAR) AS size,
  CASE WHEN p_partkey % 5 = 0 THEN 'men' WHEN p_partkey % 5 = 1 THEN 'women'
       WHEN p_partkey % 4 = 0 THEN 'men' WHEN p_partkey % 4 = 1 THEN 'women' END AS gender,
  {_DESC} AS description,
  {_kw_cat(f"concat_ws(' ', p_name, {_DESC})", 'substring')} AS category
FROM part""",
    "product_page_p1": f"""
SELECT p_partkey AS page_id, {_SLUG} AS handle,
  CASE WHEN p_partkey % 5 = 4 THEN p_name WHEN p_partkey % 3 = 0 THEN p_name
       WHEN p_partkey % 3 = 1 THEN 'All Products' ELSE 'Collection' END AS title,
  CASE WHEN p_partkey % 6 = 0 THEN {_P} || 'EUR'
       WHEN p_partkey % 5 = 4 THEN CAST(CAST(round(p_retailprice * 100) AS BIGINT) / 100 AS DECIMAL(18,2)) || 'EUR'
       ELSE '' END AS price,
  CASE WHEN p_partkey % 5 = 4 THEN 'https:' || substr({_IMG}, 7) || '_1.jpg' ELSE '' END AS image_url,
  CASE WHEN p_partkey % 5 = 4 THEN 'https:' || substr({_IMG}, 7) || '_2.jpg' ELSE '' END AS additional_images,
  CASE WHEN p_partkey % 5 = 4 THEN 'women' ELSE '' END AS gender,
  CASE WHEN p_partkey % 5 = 4 AND lower(p_type) = 'standard' THEN 'Woman ' || p_type ELSE p_type END AS category,
  CASE WHEN p_partkey % 5 = 4 THEN p_name || ' made to last' ELSE '' END AS description,
  CASE WHEN p_partkey % 5 = 4 THEN CAST(p_size AS VARCHAR) END AS size
FROM part""",
    "listing_links": f"""
SELECT DISTINCT product_url FROM (
  SELECT CASE p_partkey % 4 WHEN 0 THEN {_U} WHEN 1 THEN {_U} || '?variant=1' WHEN 2 THEN {_U} || '/quick-view'
              ELSE {_U} END AS product_url FROM part
  UNION ALL
  SELECT 'https://shop.example.com/products/gift-card-' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 4 = 3)""",
    "listing_cards": f"""
SELECT p_partkey // {LISTING_SIZE} AS page_id,
  CASE WHEN p_partkey % 4 = 0 THEN {_U} ELSE {_U} || '/quick-view' END AS product_url,
  CAST(p_partkey AS VARCHAR) AS external_id,
  CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE 'Quick view' END AS title,
  CASE WHEN p_partkey % 4 = 0 THEN replace({_P}, '.', ',') || ' EUR' END AS price,
  CASE WHEN p_partkey % 4 = 0 THEN {_IMG} || '_1.jpg' END AS image_url
FROM part WHERE p_partkey % 4 IN (0, 2)""",
    "next_page": f"""
SELECT page_no AS page_id, 'https://shop.example.com/collections/all?page=' || CAST(page_no AS VARCHAR) AS url,
  'https://shop.example.com/collections/all?page=' || CAST(page_no + 1 AS VARCHAR) AS next_url
FROM (SELECT DISTINCT p_partkey // {LISTING_SIZE} AS page_no FROM part)""",
    "page_titles": f"""
SELECT page_id,
  {_strip(_entities("regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)"))} AS h1,
  {_strip(_entities("regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)"))} AS title
FROM pages""",
    "page_links": """
SELECT DISTINCT CASE WHEN starts_with(href, '//') THEN 'https:' || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || href
  ELSE href END AS link
FROM (SELECT url, replace(unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)), '&amp;', '&') AS href FROM pages)""",
    "page_profile": "SELECT page_id, CAST(len(regexp_extract_all(html, 'href=\"[^\"]*/products/[^\"]*\"')) "
    "AS INTEGER) AS n_product_links, "
    + ", ".join(f"CAST(len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '{p}')) AS INTEGER) "
                f"AS n_price_{i}" for i, p in enumerate(PROFILE_PRICE)) + ", "
    + ", ".join(f"CAST(len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '{_esc(t)}')) AS INTEGER) "
                f"AS n_text_{i}" for i, t in enumerate(PROFILE_TEXT)) + " FROM pages",
    "page_containers": "SELECT page_id, " + ", ".join(
        f"CAST(len(list_filter(tags, lambda t: {_container_sql(sel)})) AS BIGINT) AS n_container_{i}"
        for i, sel in enumerate(PROFILE_CONTAINERS))
    + " FROM (SELECT page_id, regexp_extract_all(html, '<[a-zA-Z][^>]*>') AS tags FROM pages)",
    "page_gender": "SELECT page_id, " + ", ".join(
        f"coalesce({_gender_generic('url', m)}, {_gender_title(_TITLE_SQL, m)}, {_gender_title(_H1_SQL, m)})"
        f" AS gender_{m}" for m in ("substring", "word"))
    + " FROM pages",
}
