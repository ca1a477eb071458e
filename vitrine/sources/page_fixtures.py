"""Product and listing pages rendered by Spark from ``part`` (FIXTURES.md
``product_pages``), so that extraction can be checked against ``part``.

``% 6`` picks the price slot (class, data attribute, script, meta, JSON-LD
object, JSON-LD list), ``% 3`` the title slot, ``% 8`` the garment word, ``% 5``
and ``% 4`` the gender hints, ``% 7`` a sale price; ``% 5 = 4`` pages carry the
embedded product-state script of the first pipeline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.sources.tables import read_table, spread

SHOP = "https://shop.example.com"
GARMENTS = ["hoodie", "sneakers", "knit sweater", "t-shirt", "pants", "jacket", "dress", "cap"]
LISTING_SIZE = 20


def _lit(s: str) -> Column:
    return F.lit(s)


def _case(key: Column, mod: int, options: list[Column]) -> Column:
    out = None
    for i, o in enumerate(options):
        out = F.when(key % mod == i, o) if out is None else out.when(key % mod == i, o)
    return out


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rendered pages are ~50x the part rows: spread the small input first
    p = spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size",
                                                        "p_retailprice"), "p_partkey")
    k, n, t = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    sale = (F.col("p_retailprice") - 10).cast("decimal(18,2)").cast("string")
    slug = F.concat(F.regexp_replace(n, " ", "-"), _lit("-"), k.cast("string"))
    img = F.concat(_lit("//cdn.example.com/files/"), F.regexp_replace(F.initcap(n), " ", "_"), _lit("_"),
                   k.cast("string"))
    garment = _case(k, 8, [_lit(g) for g in GARMENTS])
    meta_desc = _case(k, 5, [F.concat(_lit("Model (man) wearing "), n), F.concat(_lit("Model (woman) wearing "), n)]
                      + [F.concat(n, _lit(" product page"))] * 3)
    desc_gender = _case(k, 4, [_lit("for men's wear"), _lit("for women's wear"), _lit("unisex fit"),
                               _lit("everyday piece")])
    head_price = _case(k, 6, [
        _lit(""), _lit(""),
        F.concat(_lit('<script>var product = {"price": "'), price, _lit(' EUR"};</script>')),
        F.concat(_lit('<meta property="product:price:amount" content="'), price, _lit('">')),
        F.concat(_lit('<script type="application/ld+json">{"@type": "Product", "offers": {"price" : "'), price,
                 _lit('", "priceCurrency": "EUR"}}</script>')),
        F.concat(_lit('<script type="application/ld+json">{"@type": "Product", "offers": [{"price" : "'), price,
                 _lit('"}]}</script>')),
    ])
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string")
    state = F.when(k % 5 == 4, F.concat(
        _lit('<script>window.sizeChartsRelentless = window.sizeChartsRelentless || {}; '
             'sizeChartsRelentless.product = {"title": "'), n, _lit('", "handle": "'), slug,
        _lit('", "description": "<p>'), n, _lit(' <b>made to last</b></p>", "price": '), cents,
        _lit(', "type": "Woman '), t, _lit('", "vendor": "Shop", "images": ["'),
        img, _lit('_1.jpg", "'), img, _lit('_2.jpg"], "variants": [{"title": "'), F.col("p_size").cast("string"),
        _lit('", "price": '), cents, _lit(', "sku": "SKU-'), k.cast("string"),
        _lit('", "available": true}, {"title": "Default Title", "price": '), cents,
        _lit(', "sku": "SKU-'), k.cast("string"), _lit('-D", "available": false}]};</script>'))).otherwise(_lit(""))
    og = F.when(k % 3 == 2, F.concat(_lit('<meta property="og:title" content="'), n, _lit('">'))).otherwise(_lit(""))
    title_html = _case(k, 3, [
        F.concat(_lit('<h1 class="product-title">'), n, _lit("</h1>")),
        F.concat(_lit('<h1>All Products</h1><div class="product-title">\n  '), n, _lit("\n</div>")),
        _lit("<h1>Collection</h1>"),
    ])
    body_price = _case(k, 6, [F.concat(_lit('<span class="price">'), price, _lit(" EUR</span>")),
                              F.concat(_lit('<span data-price="'), price, _lit('"></span>'))] + [_lit("")] * 4)
    sale_html = F.when(k % 7 == 0, F.concat(_lit('<span data-sale-price="1">'), sale, _lit(" EUR</span>"))) \
        .otherwise(_lit(""))
    html = F.concat(
        _lit("<html><head><title>"), n, _lit(" | Shop</title>"),
        _lit('<meta name="description" content="'), meta_desc, _lit('">'), og, head_price, state,
        _lit('</head><body><nav class="breadcrumb"><a href="/">Home</a> <a href="/collections/'), F.lower(t),
        _lit('">'), t, _lit("</a></nav><main><div class=\"product-single\">"), title_html, body_price, sale_html,
        _lit('<div class="product-gallery"><img src="'), img, _lit('_1.jpg" alt="'), n, _lit('"><img src="'), img,
        _lit('_2.jpg" alt="'), n, _lit('"><img src="'), img, _lit('_1.jpg" alt="'), n, _lit('"></div>'),
        _lit('<div class="sizes"><span class="size-option">'), F.col("p_size").cast("string"),
        _lit('</span><span class="size-option">'), (F.col("p_size") + 1).cast("string"), _lit("</span></div>"),
        _lit('<div class="product-description">'), n, _lit(" "), garment, _lit(" in "), t, _lit(", "), desc_gender,
        _lit('</div></div></main><footer><img src="/logo.png" class="logo" alt="Shop logo"></footer>'
             "</body></html>"),
    )
    return p.select(k.alias("page_id"), F.concat(_lit(SHOP + "/products/"), slug).alias("url"), html.alias("html"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category pages of ``LISTING_SIZE`` products each, with a next pointer."""
    p = spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), "p_partkey")
    k, n = F.col("p_partkey"), F.col("p_name")
    page_no = (k / LISTING_SIZE).cast("bigint")
    slug = F.concat(F.regexp_replace(n, " ", "-"), _lit("-"), k.cast("string"))
    price = F.regexp_replace(F.col("p_retailprice").cast("decimal(18,2)").cast("string"), r"\.", ",")
    sale = F.regexp_replace((F.col("p_retailprice") - 10).cast("decimal(18,2)").cast("string"), r"\.", ",")
    img = F.concat(_lit("//cdn.example.com/files/"), F.regexp_replace(F.initcap(n), " ", "_"), _lit("_"),
                   k.cast("string"), _lit("_1.jpg"))
    sale_html = F.when(k % 8 == 0, F.concat(_lit('<span class="sale-price">'), sale, _lit(" EUR</span>"))) \
        .otherwise(_lit(""))
    card = _case(k, 4, [
        F.concat(_lit('<div class="product-card"><a href="/products/'), slug, _lit('">'), n,
                 _lit('</a><span class="price">'), price, _lit(" EUR</span>"), sale_html, _lit('<img src="'), img,
                 _lit('" alt="'), n, _lit('"></div>')),
        F.concat(_lit('<li class="grid__item"><a href="' + SHOP + '/products/'), slug, _lit('?variant=1">'), n,
                 _lit("</a></li>")),
        F.concat(_lit('<div class="product-card"><a href="/products/'), slug, _lit('/quick-view">Quick view</a></div>'
                                                                               '<a href="/products/'), slug,
                 _lit('/quick-view">Quick view</a>')),
        F.concat(_lit('<p><a href="/products/gift-card-'), k.cast("string"), _lit('">Gift card</a> <a href="/products/'),
                 slug, _lit('">'), n, _lit("</a></p>")),
    ])
    cards = p.select(page_no.alias("page_no"), k.alias("k"), card.alias("card"))
    pages = cards.groupBy("page_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda s: s["card"]), "")
        .alias("cards"))
    nxt = F.concat(_lit("/collections/all?page="), (F.col("page_no") + 1).cast("string"))
    # Every page points on; the last one points at a page that does not exist.
    pointer = (F.when(F.col("page_no") % 3 == 0, F.concat(_lit('<button id="load-more" data-next-url="'), nxt,
                                                         _lit('">More</button>')))
               .when(F.col("page_no") % 3 == 1, F.concat(_lit('<button class="load-more" data-next-url="'), nxt,
                                                         _lit('">More</button>')))
               .otherwise(F.concat(_lit('<a rel="next" href="' + SHOP), nxt, _lit('">Next</a>'))))
    return pages.select(
        F.col("page_no").alias("page_id"),
        F.concat(_lit(SHOP + "/collections/all?page="), F.col("page_no").cast("string")).alias("url"),
        F.concat(_lit("<html><head><title>All products</title></head><body><div class=\"grid\">"), F.col("cards"),
                 _lit("</div>"), pointer, _lit("</body></html>")).alias("html"))
