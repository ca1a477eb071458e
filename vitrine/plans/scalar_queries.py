"""Registered scalar queries: categories, gender, URL parts, image filter,
over whole ``documents`` texts, ``part`` and the catalog fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import classify as C
from vitrine.functions.images import desired_image
from vitrine.functions.urls import (absolutize, external_id, fix_protocol, gift_card, product_handle,
                                    product_link, quick_view, row_id, slug_title)
from vitrine.plans import sqlparts as S
from vitrine.sources.fixtures import catalog_new, with_fixtures
from vitrine.sources.tables import read_table, spread


# Every term the document queries test, for the one-pass token lookup.
_DOC_VOCAB = C.vocabulary(C.CATEGORY_KEYWORDS, C.COARSE_TERMS, C.WOMEN_TERMS, C.MEN_TERMS, C.DESC_WOMEN,
                          C.DESC_MEN, [C.UNISEX], C.TYPE_WOMEN, C.TYPE_MEN)


def _docs(spark, sf_dir, *extra):
    """Documents with each text prepared once per mode: lower-cased for
    substring tests, and the vocabulary terms found as whole tokens."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", *extra), "doc_id")
    return d.select("*", F.lower("text").alias("_lower"),
                    C.prepare(F.col("text"), "word", _DOC_VOCAB).alias("_words"))


def q_doc_keyword_category(spark, sf_dir):
    d = _docs(spark, sf_dir)
    t = F.col("text")
    return d.select("doc_id",
                    C.keyword_category(t, None, "substring", F.col("_lower")).alias("cat_substring"),
                    C.keyword_category(t, None, "word", F.col("_words")).alias("cat_word"))


def q_doc_gender(spark, sf_dir):
    d = _docs(spark, sf_dir, "source")
    t, lo, wo = F.col("text"), F.col("_lower"), F.col("_words")
    return d.select(
        "doc_id",
        C.gender_generic(t, "substring", lo).alias("g_generic_sub"),
        C.gender_generic(t, "word", wo).alias("g_generic_word"),
        C.gender_meta(t).alias("g_meta"),
        C.gender_description(t, "substring", lo).alias("g_desc_sub"),
        C.gender_description(t, "word", wo).alias("g_desc_word"),
        C.gender_from_type(t, F.col("source"), "substring", lo).alias("g_type_sub"),
        C.gender_from_type(t, F.col("source"), "word", wo).alias("g_type_word"),
    )


def q_doc_coarse_category(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id",
                    C.coarse_category(F.col("text"), "substring", F.col("_lower")).alias("coarse_sub"),
                    C.coarse_category(F.col("text"), "word", F.col("_words")).alias("coarse_word"))


def q_part_type_category(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    typ = F.concat_ws(" ", F.col("p_name"), F.col("p_type"))
    return p.select("p_partkey", C.category_from_type(typ).alias("category"),
                    C.keyword_category(F.col("p_name"), F.col("p_type")).alias("keyword_category"))


def q_url_parts(spark, sf_dir):
    cn = catalog_new(spark, sf_dir).select("source", "product_url").distinct()
    u = F.col("product_url")
    return cn.select(
        row_id(F.col("source"), u).alias("id"),
        product_handle(u).alias("handle"),
        external_id(u).alias("external_id"),
        slug_title(u).alias("slug_title"),
    )


def q_page_url_parts(spark, sf_dir):
    pg = read_table(spark, sf_dir, "pages").select("page_id", "url")
    u = F.col("url")
    return pg.select("page_id", product_handle(u).alias("handle"), external_id(u).alias("external_id"),
                     absolutize(F.lit("/products/x"), u).alias("abs_link"),
                     fix_protocol(F.regexp_replace(u, "^https?:", "")).alias("fixed"))


def q_image_filter(spark, sf_dir):
    cn = catalog_new(spark, sf_dir).select("product_url", "ord", "image_url")
    return cn.select("product_url", "ord", desired_image(F.col("image_url")).alias("desired"))


def q_link_predicates(spark, sf_dir):
    """F1-F3 over every link of every page (whole html)."""
    pg = read_table(spark, sf_dir, "pages").select("page_id", "html")
    links = pg.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1))
                      .alias("pos", "href"))
    return links.select("page_id", "pos", "href",
                        product_link(F.col("href")).alias("is_product"),
                        gift_card(F.col("href"), "substring").alias("gift_sub"),
                        gift_card(F.col("href"), "word").alias("gift_word"),
                        quick_view(F.col("href")).alias("quick_view"))


def q_price_conversions(spark, sf_dir):
    """X2-X4 over every part's price text: CZK to EUR, EUR text, minor units."""
    from vitrine.functions.price import czk_to_eur, eur_text, minor_units_eur
    from vitrine.sources.fixtures import price_texts

    p = price_texts(spark, sf_dir).join(read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"),
                                        "p_partkey")
    units = F.round(F.col("p_retailprice") * 100).cast("bigint")
    return p.select("p_partkey", czk_to_eur(F.col("s")).alias("czk_eur"), eur_text(F.col("s")).alias("eur"),
                    minor_units_eur(units).alias("minor_eur"))


def q_tags(spark, sf_dir):
    """Comma text to a tag array (trimmed, empties dropped)."""
    from vitrine.functions.text import tags_array

    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    t = F.concat(F.lit(" "), F.col("p_type"), F.lit(", "), F.col("p_brand"), F.lit(" ,, "), F.col("p_name"))
    return p.select("p_partkey", F.array_join(tags_array(t), "|").alias("tags"))


QUERIES = {
    "price_conversions": q_price_conversions,
    "tags": q_tags,
    "doc_keyword_category": q_doc_keyword_category,
    "doc_gender": q_doc_gender,
    "doc_coarse_category": q_doc_coarse_category,
    "part_type_category": q_part_type_category,
    "url_parts": q_url_parts,
    "page_url_parts": q_page_url_parts,
    "image_filter": q_image_filter,
    "link_predicates": q_link_predicates,
}

# ---------------------------------------------------------------- DuckDB side


def _has_any(text: str, terms: list[str], mode: str) -> str:
    t = f"lower({text})"
    if mode == "substring":
        lits = [x.replace("'", "''") for x in terms]
        return "coalesce((" + " OR ".join(f"contains({t}, '{x}')" for x in lits) + "), false)"
    words = (f"(' ' || array_to_string(list_filter(regexp_split_to_array({t}, '[^\\p{{L}}\\p{{N}}]+'), "
             f"lambda x: x <> ''), ' ') || ' ')")
    keys = [(" " + C.word_key(x) + " ").replace("'", "''") for x in terms]
    return "coalesce((" + " OR ".join(f"contains({words}, '{k}')" for k in keys) + "), false)"


def _first(pairs: list[tuple[str, str]]) -> str:
    return "(CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs) + " END)"


def _kw_cat(text: str, mode: str) -> str:
    t = f"lower({text})"
    inner = _first([(_has_any(t, kws, mode), cat) for cat, kws in C.CATEGORY_KEYWORDS])
    return f"(CASE WHEN trim({t}) <> '' THEN {inner} END)"


def _gender_generic(t, mode):
    return _first([(_has_any(t, C.WOMEN_TERMS, mode), "women"), (_has_any(t, C.MEN_TERMS, mode), "men")])


def _gender_desc(t, mode):
    return ("(CASE WHEN " + _has_any(t, [C.UNISEX], mode) + " THEN NULL WHEN " + _has_any(t, C.DESC_WOMEN, mode)
            + " THEN 'women' WHEN " + _has_any(t, C.DESC_MEN, mode) + " THEN 'men' END)")


def _gender_type(t, url, mode):
    return _first([(_has_any(t, C.TYPE_WOMEN, mode), "women"), (_has_any(t, C.TYPE_MEN, mode), "men"),
                   (_has_any(url, C.URL_WOMEN, "substring"), "women"),
                   (_has_any(url, C.URL_MEN, "substring"), "men")])


def _handle(u: str) -> str:
    return (f"coalesce(nullif(regexp_extract({u}, '/products/([^/?#]+)', 1), ''), "
            f"regexp_extract(string_split({u}, '/')[-1], '^([^?]*)', 1))")


def _path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"


def _external_id(u: str) -> str:
    p = f"regexp_replace({_path(u)}, '^/+|/+$', '', 'g')"
    h = f"regexp_extract('/' || {p}, '/products/([^/]+)', 1)"
    d = f"regexp_extract({h}, '(\\d+)', 1)"
    return f"(CASE WHEN {h} <> '' THEN (CASE WHEN {d} <> '' THEN {d} ELSE {h} END) ELSE replace({p}, '/', '-') END)"


def _desired(u: str) -> str:
    name = f"string_split(string_split({u}, '/')[-1], '?')[1]"
    rejected = (f"(regexp_matches({name}, '[a-f0-9]{{32,}}') OR regexp_matches({name}, '^\\d+_') "
                f"OR starts_with({name}, 'DROP_') OR starts_with({name}, 'CO') "
                f"OR regexp_matches({name}, '^[A-Z]{{2,}}\\d+\\.jpg$') "
                f"OR coalesce(TRY_CAST(nullif(regexp_extract({name}, '_(\\d+)\\.jpg$', 1), '') AS DECIMAL(38,0)) > 2, false))")
    meaningful = _has_any(name, __import__("vitrine.functions.images", fromlist=["x"]).MEANINGFUL_TERMS, "substring")
    multi = f"contains(regexp_replace({name}, '\\.jpg', '', 'g'), '_')"
    return f"coalesce(CASE WHEN coalesce({u}, '') <> '' THEN (NOT {rejected}) AND {meaningful} AND {multi} END, false)"


_GIFT_WORD = "gift-?card|(^|[^a-z])card([^a-z]|$)"

_CZK_RAW = "regexp_extract(s, '([\\d\\s.,]+)\\s*CZK', 1)"
_CZK_NUM = f"replace(regexp_replace({_CZK_RAW}, '[\\s.]', '', 'g'), ',', '.')"
_EUR_RAW = "regexp_extract(s, '(\\d+(?:[.,]\\d+)?)\\s*EUR', 1)"

ORACLES = {
    "price_conversions": with_fixtures("price_texts") + f"""
SELECT t.p_partkey,
  CASE WHEN {_CZK_NUM} <> '' THEN CAST(CAST(round(TRY_CAST({_CZK_NUM} AS DECIMAL(28,10)) * 0.042, 2)
       AS DECIMAL(18,2)) AS VARCHAR) || 'EUR' END AS czk_eur,
  CASE WHEN {_EUR_RAW} <> '' THEN CAST(TRY_CAST(replace({_EUR_RAW}, ',', '.') AS DECIMAL(18,2)) AS VARCHAR) || 'EUR'
       END AS eur,
  CASE WHEN round(p.p_retailprice * 100) <> 0
       THEN CAST(CAST(CAST(round(p.p_retailprice * 100) AS BIGINT) / 100 AS DECIMAL(18,2)) AS VARCHAR) || 'EUR'
       END AS minor_eur
FROM price_texts t JOIN part p ON t.p_partkey = p.p_partkey""",
    "tags": f"""
SELECT p_partkey, array_to_string(list_filter(list_transform(
    string_split(' ' || p_type || ', ' || p_brand || ' ,, ' || p_name, ','),
    lambda x: {S.strip_blanks('x')}), lambda x: x <> ''), '|') AS tags
FROM part""",
    "doc_keyword_category": f"""
SELECT doc_id, {_kw_cat('text', 'substring')} AS cat_substring, {_kw_cat('text', 'word')} AS cat_word FROM documents""",
    "doc_gender": f"""
SELECT doc_id, {_gender_generic('text', 'substring')} AS g_generic_sub, {_gender_generic('text', 'word')} AS g_generic_word,
  {_first([(_has_any('text', C.META_WOMEN, 'substring'), 'women'), (_has_any('text', C.META_MEN, 'substring'), 'men')])} AS g_meta,
  {_gender_desc('text', 'substring')} AS g_desc_sub, {_gender_desc('text', 'word')} AS g_desc_word,
  {_gender_type('text', 'lower(source)', 'substring')} AS g_type_sub, {_gender_type('text', 'lower(source)', 'word')} AS g_type_word
FROM documents""",
    "doc_coarse_category": f"""
SELECT doc_id, {_first([(_has_any('text', t, 'substring'), c) for c, t in C.COARSE_TERMS])} AS coarse_sub,
  {_first([(_has_any('text', t, 'word'), c) for c, t in C.COARSE_TERMS])} AS coarse_word FROM documents""",
    "part_type_category": f"""
SELECT p_partkey,
  CASE WHEN len(list_filter(string_split_regex(trim(p_name || ' ' || p_type), '\\s+'),
                            lambda t: t <> '' AND lower(t) NOT IN ('man', 'woman', 'standard'))) > 0
       THEN array_to_string(list_filter(string_split_regex(trim(p_name || ' ' || p_type), '\\s+'),
                            lambda t: t <> '' AND lower(t) NOT IN ('man', 'woman', 'standard')), ' ')
       ELSE p_name || ' ' || p_type END AS category,
  {_kw_cat("concat_ws(' ', nullif(p_name, ''), nullif(p_type, ''))", 'substring')} AS keyword_category
FROM part""",
    "url_parts": with_fixtures("catalog_new") + f"""
SELECT {S.row_id('source', 'product_url')} AS id, {_handle('product_url')} AS handle,
  {_external_id('product_url')} AS external_id,
  CASE WHEN regexp_extract(product_url, '/products/([^/]*)', 1) <> ''
       THEN {S.initcap("replace(regexp_extract(product_url, '/products/([^/]*)', 1), '-', ' ')")} END AS slug_title
FROM (SELECT DISTINCT source, product_url FROM catalog_new)""",
    "page_url_parts": f"""
SELECT page_id, {_handle('url')} AS handle, {_external_id('url')} AS external_id,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || '/products/x' AS abs_link,
  CASE WHEN starts_with(regexp_replace(url, '^https?:', ''), '//') THEN 'https:' || regexp_replace(url, '^https?:', '')
       ELSE regexp_replace(url, '^https?:', '') END AS fixed
FROM pages""",
    "image_filter": with_fixtures("catalog_new") + f"""
SELECT product_url, ord, {_desired('image_url')} AS desired FROM catalog_new""",
    "link_predicates": f"""
SELECT page_id, pos, href,
  coalesce(contains(href, '/products/'), false) AS is_product,
  {_has_any('href', ['giftcard', 'gift-card', 'card'], 'substring')} AS gift_sub,
  coalesce(regexp_matches(lower(href), '{_GIFT_WORD}'), false) AS gift_word,
  coalesce(contains(lower(href), 'quick-view'), false) AS quick_view
FROM (SELECT page_id, unnest(links) AS href, CAST(generate_subscripts(links, 1) - 1 AS INTEGER) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS links FROM pages))""",
}
