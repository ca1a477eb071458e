"""Registered queries whose inputs reach every branch of a rule: links, texts and
raw records derived from ``part`` so that each predicate and label takes all of
its values (the given pages and documents hold only some)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import classify as C
from vitrine.functions.urls import external_id, gift_card, product_link, quick_view
from vitrine.operators.dedupe import keep_first
from vitrine.operators.merge import uniqueness_report
from vitrine.operators.records import format_products
from vitrine.plans import scalar_queries as Q
from vitrine.plans import sqlparts as S
from vitrine.sources.tables import read_table

# Link shapes of a shop, one picked by ``p_partkey``.
LINKS = ["/products/item-{k}", "/products/gift-card-{k}", "/products/cardigan-{k}", "/collections/new?page={k}",
         "/products/item-{k}?view=Quick-View", "https://cdn.example.com/card/{k}", "/products/GiftCard-{k}", "/pages/about"]
# Phrases that the text rules tell apart, one picked by ``p_partkey``.
PHRASES = ["red knit sweater for women", "slim jeans, men's cut", "leather belt and scarf", "running sneakers", "plain item",
           "model (man) wearing a jacket", "Model (Woman) wearing boots", "unisex fit cap", "woman standard dress", "womens wear", "her hat",
           "menswear coat", "a cargo pants set", "kimono", "ladies top"]


def _pick(options: list[str], key):
    return F.element_at(F.array(*[F.lit(o) for o in options]), (key % len(options) + 1).cast("int"))


def _pick_sql(options: list[str]) -> str:
    listed = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
    return f"([{listed}])[p_partkey % {len(options)} + 1]"


def q_shop_link_predicates(spark, sf_dir):
    """F1-F3 where products, gift cards in both modes and quick views occur."""
    p = read_table(spark, sf_dir, "part").select("p_partkey")
    href = F.replace(_pick(LINKS, F.col("p_partkey")), F.lit("{k}"), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", href.alias("href")).select(
        "p_partkey", "href", product_link(F.col("href")).alias("is_product"), gift_card(F.col("href"), "substring").alias("gift_sub"),
        gift_card(F.col("href"), "word").alias("gift_word"), quick_view(F.col("href")).alias("quick_view"))


def _texts(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.select("p_partkey", F.concat_ws(" ", "p_name", _pick(PHRASES, F.col("p_partkey"))).alias("text"))


_TEXTS_SQL = f"t AS (SELECT p_partkey, p_name || ' ' || {_pick_sql(PHRASES)} AS text FROM part)"


def q_shop_text_labels(spark, sf_dir):
    """Keyword category, coarse category and the gender chains over
    texts that reach several labels of each."""
    t = F.col("text")
    return _texts(spark, sf_dir).select(
        "p_partkey",
        C.keyword_category(t, None, "substring").alias("cat_substring"), C.keyword_category(t, None, "word").alias("cat_word"),
        C.coarse_category(t, "substring").alias("coarse_sub"), C.coarse_category(t, "word").alias("coarse_word"),
        C.gender_generic(t, "substring").alias("g_generic_sub"), C.gender_generic(t, "word").alias("g_generic_word"),
        C.gender_meta(t).alias("g_meta"),
        C.gender_description(t, "substring").alias("g_desc_sub"), C.gender_description(t, "word").alias("g_desc_word"))


def raw_records(spark, sf_dir):
    """Raw rows of which some lack a required field, one source without any good
    row, and some come under a second url with the same number."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    number = k.cast("string")
    url = F.concat(F.lit("https://shop.example.com/products/item-"), number)
    base = p.select(
        k.alias("p_partkey"), F.lit(1).alias("ord"),
        F.when(k % 13 != 1, F.col("p_brand")).alias("source"),
        F.when(k % 13 != 2, url).alias("product_url"),
        F.when(k % 13 != 3, F.concat(F.lit("https://cdn.example.com/files/"), number, F.lit(".jpg"))).alias("image_url"),
        F.when((k % 13 != 4) & (F.col("p_brand") != "Brand#11"), F.col("p_name")).alias("title"),
        F.lit("10 EUR").alias("price"))
    again = base.where(k % 17 == 0).withColumns({"ord": F.lit(2), "product_url": F.concat(F.lit("https://shop.example.com/products/old-"), number)})
    return base.unionByName(again)


_RAW_SQL = """base AS (
  SELECT p_partkey, 1 AS ord, CASE WHEN p_partkey % 13 <> 1 THEN p_brand END AS source,
    CASE WHEN p_partkey % 13 <> 2 THEN 'https://shop.example.com/products/item-' || p_partkey END AS product_url,
    CASE WHEN p_partkey % 13 <> 3 THEN 'https://cdn.example.com/files/' || p_partkey || '.jpg' END AS image_url,
    CASE WHEN p_partkey % 13 <> 4 AND p_brand <> 'Brand#11' THEN p_name END AS title
  FROM part
), raw AS (SELECT * FROM base UNION ALL
  SELECT p_partkey, 2, source, 'https://shop.example.com/products/old-' || p_partkey, image_url, title FROM base WHERE p_partkey % 17 = 0)"""


def q_reject_reasons(spark, sf_dir):
    """How many rows are rejected for which first reason."""
    f = format_products(raw_records(spark, sf_dir))
    return f.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q_failing_sites(spark, sf_dir):
    """A10: sources with and without an accepted row, and the run's verdict."""
    f = format_products(raw_records(spark, sf_dir)).where("source is not null")
    good = F.col("reject_reason").isNull()
    return f.groupBy("source").agg(F.sum(good.cast("int")).cast("bigint").alias("n_ok"), F.bool_or(good).alias("success"))


def q_external_id_clashes(spark, sf_dir):
    """(source, external id) pairs held by two products, with their urls."""
    f = format_products(raw_records(spark, sf_dir)).where("reject_reason is null")
    f = f.withColumn("external_id", external_id(F.col("product_url")))
    return uniqueness_report(f, ["source", "external_id"])


def q_distinct_products(spark, sf_dir):
    """A4 over raw rows: one row per (source, number), the first delivery of it."""
    f = format_products(raw_records(spark, sf_dir), keep=("ord",)).where("source is not null and product_url is not null")
    f = f.withColumn("external_id", external_id(F.col("product_url")))
    return keep_first(f, ["source", "external_id"], ["ord"]).select("source", "external_id", "product_url", "ord")


QUERIES = {
    "shop_link_predicates": q_shop_link_predicates,
    "shop_text_labels": q_shop_text_labels,
    "reject_reasons": q_reject_reasons,
    "failing_sites": q_failing_sites,
    "external_id_clashes": q_external_id_clashes,
    "distinct_products": q_distinct_products,
}

ORACLES = {
    "shop_link_predicates": f"""
SELECT p_partkey, href, coalesce(contains(href, '/products/'), false) AS is_product,
  {Q._has_any('href', ['giftcard', 'gift-card', 'card'], 'substring')} AS gift_sub,
  coalesce(regexp_matches(lower(href), '{Q._GIFT_WORD}'), false) AS gift_word,
  coalesce(contains(lower(href), 'quick-view'), false) AS quick_view
FROM (SELECT p_partkey, replace({_pick_sql(LINKS)}, '{{k}}', CAST(p_partkey AS VARCHAR)) AS href FROM part)""",
    "shop_text_labels": f"""WITH {_TEXTS_SQL}
SELECT p_partkey, {Q._kw_cat('text', 'substring')} AS cat_substring, {Q._kw_cat('text', 'word')} AS cat_word,
  {Q._first([(Q._has_any('text', t, 'substring'), c) for c, t in C.COARSE_TERMS])} AS coarse_sub,
  {Q._first([(Q._has_any('text', t, 'word'), c) for c, t in C.COARSE_TERMS])} AS coarse_word,
  {Q._gender_generic('text', 'substring')} AS g_generic_sub, {Q._gender_generic('text', 'word')} AS g_generic_word,
  {Q._first([(Q._has_any('text', C.META_WOMEN, 'substring'), 'women'), (Q._has_any('text', C.META_MEN, 'substring'), 'men')])} AS g_meta,
  {Q._gender_desc('text', 'substring')} AS g_desc_sub, {Q._gender_desc('text', 'word')} AS g_desc_word
FROM t""",
    "reject_reasons": f"""WITH {_RAW_SQL}
SELECT coalesce({S.reject_reason()}, 'accepted') AS reason, count(*) AS n FROM raw GROUP BY 1""",
    "failing_sites": f"""WITH {_RAW_SQL}
SELECT source, CAST(count(*) FILTER (WHERE good) AS BIGINT) AS n_ok, bool_or(good) AS success
FROM (SELECT source, {S.reject_reason()} IS NULL AS good FROM raw WHERE source IS NOT NULL) GROUP BY source""",
    "external_id_clashes": f"""WITH {_RAW_SQL}
SELECT source, CAST(p_partkey AS VARCHAR) AS external_id, count(*) AS n FROM raw WHERE {S.reject_reason()} IS NULL
GROUP BY source, p_partkey HAVING count(*) > 1""",
    "distinct_products": f"""WITH {_RAW_SQL}
SELECT source, external_id, product_url, ord FROM (
  SELECT source, CAST(p_partkey AS VARCHAR) AS external_id, product_url, ord,
    row_number() OVER (PARTITION BY source, p_partkey ORDER BY ord) AS nth
  FROM raw WHERE source IS NOT NULL AND product_url IS NOT NULL) WHERE nth = 1""",
}
