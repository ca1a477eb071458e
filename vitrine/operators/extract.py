"""Page -> record extraction (E1-E12, E16-E25, W3-W5, J2) over ``elements``.

Each rule chain is an ordered list of selectors: every selector looks at its
first match only, a rejected match moves on to the next selector, and the
comma members of one selector share one priority (document order decides).
All of it is one ``groupBy(page)`` with ``min(struct(idx, value))`` per rule:
a page's elements come from one task, so the aggregate combines map-side and
only one row per page is shuffled. Elements no rule can use are filtered out
before the aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import classify as C
from vitrine.functions.images import product_image
from vitrine.functions.price import html_price, minor_units_eur, strip_blanks
from vitrine.functions.urls import absolutize, external_id, fix_protocol, product_handle, slug_title
from vitrine.functions.text import strip_tags
from vitrine.operators.elements import elements
from vitrine.operators.selectors import RAW, TEXT, TEXT_SP, apply_rules, matches, text_of


def _at(arr, i: int):
    """1-based array access that yields null when out of range (ANSI-safe)."""
    return F.try_element_at(arr, F.lit(i))


# ---- Fixed values that must equal the reference's for right results. ----
P2_TITLE = ["h1.product-title", ".product-title", "h1", '[class*="title"]', ".title"]
TITLE_SKIP = ["all products", "collection", "size guide"]
MIN_TITLE_LEN = 3
P2_PRICE = [".price", "[data-price]", ".product-price", '[class*="price"]', ".money"]
PRICE_SKIP = ["price", "low to high", "high to low", "filter", "sort", "new arrivals", "best sellers", "on sale"]
SCRIPT_PRICE = r'"price":\s*"([^"]+)"'
P2_SALE = [".sale-price", ".price--sale", "[data-sale-price]", ".compare-at-price", ".product-price--sale",
           '[class*="sale"]']
P2_IMAGES = ('main [class*="product"] img, main .product-gallery img, main .product-images img, '
             'main [class*="product-gallery"] img, main [class*="product__media"] img, '
             '.product [class*="media"] img, .product-gallery img, .product__media img, '
             '[class*="product-single"] img, [class*="product-media"] img')
P2_IMAGES_FALLBACK = 'img[src*="cdn"], img[src*="shopify"], img[src^="//"]'
P2_DESCRIPTION = ('.metafield-rich_text_field .rte, .metafield-rich_text_field p, .metafield-rich_text_field, '
                  '.product-description, .description, [data-description]')
P2_GENDER_DESC = '.product-description, .description, [class*="description"]'
BREADCRUMBS = '.breadcrumb, .breadcrumbs, [class*="breadcrumb"]'
DEFAULT_SIZES = ".size-option, [data-size]"
DEFAULT_GENDER = ".gender, .category"
P1_STATE_MARK = "sizeChartsRelentless.product"
P1_STATE = r"(?s)sizeChartsRelentless\.product\s*=\s*(\{.+?\});"
P1_PRICE = '.price, .product__price, [class*="price"]'
P1_IMAGE = "img.product__media img, img.product-featured-image"
P1_GALLERY = "img.product__media-thumbnail, img.product-thumbnail"
P1_BREADCRUMB = "nav.breadcrumb a, ol.breadcrumb a, div.breadcrumb a, ul.breadcrumb a"
P1_BREADCRUMB_SKIP = ["home", "inicio", "collections", "all"]
DEFAULT_VARIANT = "Default Title"
LINK_RULES = ["div.product-card a[href*='/products/']", "li.grid__item a[href*='/products/']",
              "a[href*='/products/']"]
NEXT_RULES = ["button#load-more", "button.load-more", "a[rel='next']"]
# ---- end of fixed values ----


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def _title_ok(t: Column, brand: str) -> Column:
    low = F.lower(t)
    bad = C.has_any(low, TITLE_SKIP + ([brand.lower()] if brand else []), "substring")
    return F.coalesce((F.length(t) > MIN_TITLE_LEN) & ~bad, F.lit(False))


def _price_ok(t: Column) -> Column:
    return F.coalesce(~C.has_any(t, PRICE_SKIP, "substring") & t.rlike(r"\d"), F.lit(False))


def _chain(cands: list[Column], ok) -> Column:
    return F.coalesce(*[F.when(ok(c), c) for c in cands])


def _jsonld_price() -> Column:
    v = F.try_parse_json(F.col("raw_text"))
    return F.coalesce(F.try_variant_get(v, "$.offers.price", "string"),
                      F.try_variant_get(v, "$.offers[0].price", "string"))


def _img_src() -> Column:
    return F.coalesce(F.nullif(_attr("src"), F.lit("")), F.nullif(_attr("data-src"), F.lit("")),
                      F.nullif(_attr("data-lazy-src"), F.lit("")))


_P2_CACHE: dict = {}


def product_records_p2(pages: DataFrame | None, selectors: dict | None = None, brand: str = "",
                       mode: str = "substring", els: DataFrame | None = None) -> DataFrame:
    """Product pages -> detail records (title, price, sale, images, sizes,
    gender, description, category, external id)."""
    from vitrine.operators.selectors import context_key

    selectors = selectors or {}
    key = (context_key(), tuple(sorted(selectors.items())), brand, mode)
    if key not in _P2_CACHE:
        # the rule Columns depend only on the spec: built once per spec and reused
        _P2_CACHE[key] = _p2_columns(selectors, brand, mode)
    rules, out_cols, category = _P2_CACHE[key]
    els = elements(pages) if els is None else els
    g = apply_rules(els, ["page_id", "url"], rules, cache_key=("p2",) + key[1:])
    return g.select(*out_cols).withColumn("category", category)


def _p2_columns(selectors: dict, brand: str, mode: str):
    sizes_sel = selectors.get("sizes", DEFAULT_SIZES)
    gender_sel = selectors.get("gender", DEFAULT_GENDER)
    script_price = F.regexp_extract(F.col("raw_text"), SCRIPT_PRICE, 1)
    norm_src = absolutize(_img_src(), F.col("url"))
    img_ok = product_image(norm_src, _attr("alt"), F.array_join(F.col("classes"), " "), brand)
    preds = {
        "script_price": (F.col("tag") == "script") & F.col("raw_text").rlike("price|Price") & (script_price != ""),
        "data_price": _attr("data-price").isNotNull(),
        "meta_price": (F.col("tag") == "meta") & (_attr("property") == "product:price:amount"),
        "jsonld": (F.col("tag") == "script") & (_attr("type") == "application/ld+json"),
        "og": (F.col("tag") == "meta") & (_attr("property") == "og:title"),
        "meta_desc": matches('meta[name="description"]'),
        "img": matches(P2_IMAGES) & norm_src.isNotNull() & img_ok,
        "img_fb": matches(P2_IMAGES_FALLBACK) & norm_src.isNotNull() & img_ok,
    }
    rules = (
        [(f"t{i}", matches(sel), TEXT, "first") for i, sel in enumerate(P2_TITLE)]
        + [(f"p{i}", matches(sel), TEXT, "first") for i, sel in enumerate(P2_PRICE)]
        + [(f"s{i}", matches(sel), TEXT, "first") for i, sel in enumerate(P2_SALE)]
        + [
            ("og_title", preds["og"], _attr("content"), "first"),
            ("script_price", preds["script_price"], script_price, "first"),
            ("data_price", preds["data_price"], _attr("data-price"), "first"),
            ("meta_price", preds["meta_price"], _attr("content"), "first"),
            ("jsonld_price", preds["jsonld"] & _jsonld_price().isNotNull(), _jsonld_price(), "first"),
            ("imgs", preds["img"], norm_src, "all"),
            ("imgs_fb", preds["img_fb"], norm_src, "all"),
            ("sizes", matches(sizes_sel), TEXT, "all"),
            ("meta_desc", preds["meta_desc"], _attr("content"), "first"),
            ("crumbs", matches(BREADCRUMBS), RAW, "all"),
            ("page_title", matches("title"), RAW, "first"),
            ("gender_text", matches(gender_sel), RAW, "first"),
            ("gender_desc", matches(P2_GENDER_DESC), RAW, "first"),
            ("description", matches(P2_DESCRIPTION), TEXT_SP, "first"),
        ])
    title = F.coalesce(
        _chain([F.col(f"t{i}") for i in range(len(P2_TITLE))], lambda t: _title_ok(t, brand)),
        F.nullif(strip_blanks(F.col("og_title")), F.lit("")),
        slug_title(F.col("url")))
    price = F.coalesce(
        _chain([F.col(f"p{i}") for i in range(len(P2_PRICE))], _price_ok),
        F.col("script_price"), F.nullif(F.col("data_price"), F.lit("")),
        F.nullif(F.col("meta_price"), F.lit("")), F.col("jsonld_price"))
    sale = F.coalesce(*[F.when(F.coalesce(F.col(f"s{i}").rlike(r"\d")
                                          & ~F.coalesce(F.col(f"s{i}") == price, F.lit(False)), F.lit(False)),
                               F.col(f"s{i}"))
                        for i in range(len(P2_SALE))])
    imgs = F.array_distinct(F.when(F.size("imgs") > 0, F.col("imgs")).otherwise(F.col("imgs_fb")))
    sizes = F.filter(F.col("sizes"), lambda s: s != "")
    crumb_gender = _at(F.filter(F.transform("crumbs", lambda c: C.gender_generic(c, mode)),
                                         lambda x: x.isNotNull()), 1)
    gender = F.coalesce(
        C.gender_generic(F.col("url"), mode),
        C.gender_meta(F.col("meta_desc")),
        crumb_gender,
        C.gender_title(F.col("page_title"), mode),
        C.gender_title(F.col("gender_text"), mode),
        C.gender_description(F.col("gender_desc"), mode))
    out_cols = [
        "page_id", F.col("url").alias("product_url"),
        external_id(F.col("url")).alias("external_id"),
        title.alias("title"), price.alias("price"), sale.alias("sale"),
        _at(imgs, 1).alias("image_url"),
        F.when(F.size(imgs) > 1, F.array_join(F.slice(imgs, 2, 1 << 20), ",")).alias("additional_images"),
        F.when(F.size(sizes) > 0, F.array_join(sizes, ", ")).alias("size"),
        gender.alias("gender"),
        F.nullif(F.col("description"), F.lit("")).alias("description"),
    ]
    return rules, out_cols, C.keyword_category(F.col("title"), F.col("description"))




_P1_CACHE: dict = {}


def product_records_p1(pages: DataFrame) -> DataFrame:
    """The first pipeline's page rules (embedded product state JSON first)."""
    from vitrine.operators.selectors import context_key

    key = context_key()
    if key not in _P1_CACHE:
        _P1_CACHE[key] = _p1_columns()        # fixed rules: Columns built once
    rules, rec_cols, meta = _P1_CACHE[key]
    g = apply_rules(elements(pages), ["page_id", "url"], rules, cache_key=("p1",))
    return g.select(*rec_cols).withColumn("metadata", meta).drop("sizes", "product_type", "vendor")


def _p1_columns():
    state_pred = (F.col("tag") == "script") & F.col("raw_text").contains(P1_STATE_MARK)
    state_txt = F.regexp_extract(F.col("raw_text"), P1_STATE, 1)
    rules = [
        ("state", state_pred & (state_txt != ""), state_txt, "first"),
        ("h1_product", matches("h1.product__title"), TEXT, "first"),
        ("h1", matches("h1"), TEXT, "first"),
        ("desc_html", matches("div.product__description"), TEXT, "first"),
        ("price_text", matches(P1_PRICE), TEXT, "first"),
        ("img_html", matches(P1_IMAGE), _attr("src"), "first"),
        ("gallery", matches(P1_GALLERY), _attr("src"), "all"),
        ("crumbs", matches(P1_BREADCRUMB), TEXT, "all"),
    ]
    js = F.try_parse_json(F.col("state"))
    jget = lambda path, t="string": F.try_variant_get(js, path, t)
    jtitle, jtype = F.nullif(jget("$.title"), F.lit("")), F.nullif(jget("$.type"), F.lit(""))
    jimages = F.transform(F.coalesce(jget("$.images", "array<string>"), F.array().cast("array<string>")),
                          fix_protocol)
    variants = F.coalesce(jget("$.variants", "array<struct<title:string,price:bigint,sku:string,available:boolean>>"),
                          F.array().cast("array<struct<title:string,price:bigint,sku:string,available:boolean>>"))
    sizes = F.array_sort(F.array_distinct(F.filter(F.transform(variants, lambda v: v["title"]),
                                                   lambda s: s.isNotNull() & (s != "") & (s != DEFAULT_VARIANT))))
    crumbs = F.filter(F.col("crumbs"), lambda t: (t != "") & ~F.lower(t).isin(*P1_BREADCRUMB_SKIP))
    # case-insensitive distinct keeping the first spelling
    crumbs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(crumbs), F.lit(1))),
                                  lambda i: F.when(~F.exists(F.slice(crumbs, 1, i - 1),
                                                             lambda p: F.lower(p) == F.lower(_at(crumbs, i))),
                                                   _at(crumbs, i))),
                      lambda x: x.isNotNull())
    html_p = html_price(F.coalesce(F.col("price_text"), F.lit("")))
    main_img = F.coalesce(_at(jimages, 1), fix_protocol(F.nullif(F.col("img_html"), F.lit(""))))
    gallery = F.array_distinct(F.filter(F.transform("gallery", fix_protocol),
                                        lambda s: s.isNotNull() & (s != "") & ~F.coalesce(s == main_img, F.lit(False))))
    extra = F.when(F.size(jimages) > 1, F.slice(jimages, 2, 1 << 20)).otherwise(gallery)
    # Variants flattened, minor units -> EUR text
    flat = F.transform(variants, lambda v: F.struct(
        v["title"].alias("title"), minor_units_eur(v["price"]).alias("price_eur"), v["sku"].alias("sku"),
        v["available"].alias("available")))
    rec_cols = [
        "page_id", F.col("url").alias("product_url"),
        product_handle(F.col("url"), jget("$.handle")).alias("handle"),
        F.coalesce(jtitle, F.col("h1_product"), F.col("h1"), F.lit("")).alias("title"),
        F.coalesce(strip_tags(F.nullif(jget("$.description"), F.lit(""))), F.col("desc_html"), F.lit(""))
        .alias("description"),
        F.coalesce(html_p, minor_units_eur(jget("$.price", "bigint")), F.lit("")).alias("price"),
        F.coalesce(main_img, F.lit("")).alias("image_url"),
        F.array_join(extra, " , ").alias("additional_images"),
        F.coalesce(C.gender_from_type(F.coalesce(jtype, F.lit("")), F.col("url")), F.lit("")).alias("gender"),
        F.coalesce(F.when(jtype.isNotNull(), C.category_from_type(jtype)),
                   F.array_join(crumbs, " , ")).alias("category"),
        F.when(F.size(sizes) > 0, F.array_join(sizes, ", ")).alias("size"),
        sizes.alias("sizes"),
        F.when(js.isNotNull(), F.coalesce(jtype, F.lit(""))).alias("product_type"),
        F.when(js.isNotNull(), F.coalesce(F.nullif(jget("$.vendor"), F.lit("")), F.lit(""))).alias("vendor"),
        F.when(js.isNotNull(), F.coalesce(jget("$.tags", "array<string>"), F.array().cast("array<string>")))
        .alias("tags"),
        F.when(F.size(variants) > 0, flat).alias("variants"),
    ]
    # Metadata JSON of the record (nested values kept as JSON)
    meta = F.to_json(F.struct(
        "title", "description", "price", "category", "gender", "sizes",
        F.array().cast("array<string>").alias("colors"), "product_type", "vendor", "tags", "variants"))
    return rules, rec_cols, meta


def product_links(pages: DataFrame) -> DataFrame:
    """E1 + A3 + O1: product links from the three link rules, absolutised,
    distinct over all pages."""
    els = elements(pages).where(F.col("tag") == "a")
    href = _attr("href")
    hit = ((matches(LINK_RULES[0]) | matches(LINK_RULES[1])) & href.contains("/products/")
           | matches(LINK_RULES[2]) & href.contains("/products/") & ~F.lower(href).contains("quick-view"))
    return (els.where(hit & (href != ""))
            .select(F.when(href.startswith("http"), href)
                    .otherwise(F.concat(F.regexp_extract(F.col("url"), r"^(https?://[^/?#]+)", 1), href))
                    .alias("product_url"))
            .distinct())


def next_pages(pages: DataFrame) -> DataFrame:
    """E5: next-page pointer: load-more button id, then class, then rel=next."""
    els = elements(pages)
    root = F.regexp_extract(F.col("url"), r"^(https?://[^/?#]+)", 1)
    g = apply_rules(els, ["page_id", "url"], [
        ("b1", matches(NEXT_RULES[0]), _attr("data-next-url"), "first"),
        ("b2", matches(NEXT_RULES[1]), _attr("data-next-url"), "first"),
        ("a", matches(NEXT_RULES[2]), F.coalesce(_attr("href"), F.lit("")), "first"),
    ])
    nxt = F.coalesce(F.when(F.coalesce(F.col("b1"), F.lit("")) != "", F.concat(root, F.col("b1"))),
                     F.when(F.coalesce(F.col("b2"), F.lit("")) != "", F.concat(root, F.col("b2"))),
                     F.col("a"))
    return g.select("page_id", "url", F.nullif(nxt, F.lit("")).alias("next_url"))


def _container_of(cont_sel: str) -> Column:
    """Index of the element's nearest ancestor matching the container selector."""
    from vitrine.operators.selectors import _compound

    def anc_pred(a):
        out = F.lit(False)
        for member in cont_sel.split(","):
            out = out | _compound(member.strip(), a["tag"], a["elem_id"], a["classes"], None)
        return out

    return _at(F.filter(F.col("ancestors"), anc_pred), -1)["idx"]


def _card_rules(selectors: dict) -> list[tuple]:
    link_sel = selectors.get("product_url", "a")
    title_sel = selectors.get("title", ".title, h3")
    price_sel = selectors.get("price", ".price")
    img_sel = selectors.get("image_url", "img")
    return [
        ("href", matches(link_sel), _attr("href"), "first"),
        ("title", matches(title_sel), TEXT, "first"),
        ("price", matches(price_sel), TEXT, "first"),
        ("img", matches(img_sel), F.coalesce(F.nullif(_attr("src"), F.lit("")), _attr("data-src")), "first"),
    ]


def _card_rows(g: DataFrame) -> DataFrame:
    url = absolutize(F.col("href"), F.col("url"))
    return g.where(F.coalesce(F.col("href"), F.lit("")) != "").select(
        "page_id", F.col("url").alias("page_url"), F.col("c_idx").alias("card_idx"), url.alias("product_url"),
        F.coalesce(F.nullif(external_id(url), F.lit("")), _at(F.split(url, "/"), -1)).alias("external_id"),
        "title", "price", absolutize(F.col("img"), F.col("url")).alias("image_url"))


def listing_cards(pages: DataFrame, selectors: dict, els: DataFrame | None = None) -> DataFrame:
    """E2 (and E4 without a browser): one record per listing container with
    url, external id, title, price and image. Each element finds its nearest
    container in its own ancestor list; all cards of a page come out of one
    per-page aggregate (no join, no second pass over the elements)."""
    from vitrine.operators.selectors import apply_grouped_rules

    els = elements(pages) if els is None else els
    cont = _container_of(selectors.get("products", ".product-item"))
    g = apply_grouped_rules(els, ["page_id", "url"], cont, _card_rules(selectors), group_name="c_idx")
    return _card_rows(g)


# ---- Fixed values that must equal the reference's for right results. ----
LINK_FALLBACK_LIMIT = 50   # L4: the caller passes it to get that feature
LINK_MIN_TITLE = 10
SIZE_TOKENS = r"\b(XS|S|M|L|XL|XXL|\d+)\b"
PARENT_PRICE = r"(\d+,\d+)\s*EUR"
# ---- end of fixed values ----


def _link_page_rules(selectors: dict, mode: str) -> list[tuple]:
    """Page-level rules for E3: product links (minus gift cards) with their
    text and parent ranges, and images with their ancestor indexes."""
    from vitrine.functions.urls import gift_card

    href = _attr("href")
    link_sel = selectors.get("product_url", "a[href*='/products/']")
    is_link = (matches(link_sel) & F.coalesce(href.contains("/products/"), F.lit(False)) & ~gift_card(href, mode))
    src = F.coalesce(F.nullif(_attr("src"), F.lit("")), _attr("data-src"))
    link = F.struct(F.col("idx").alias("i"), href.alias("href"), F.col("t0"), F.col("t1"),
                    F.col("parent_idx"), F.col("p_t0"), F.col("p_t1"))
    img = F.struct(F.col("idx").alias("i"), src.alias("src"), F.col("ancestors.idx").alias("anc"))
    return [("links", is_link, link, "all"), ("imgs", (F.col("tag") == "img") & src.isNotNull(), img, "all")]


def _link_rows(g: DataFrame, limit: int | None) -> DataFrame:
    """E3 records from per-page ``links``, ``imgs`` and ``_nodes``: first of
    each href (of these the first ``limit`` in document order when given: L4),
    title from the link text, price and image from the parent."""
    firsts = F.filter(F.col("links"), lambda l, k: ~F.exists(F.slice(F.col("links"), 1, k),
                                                             lambda o: o["href"] == l["href"]))
    top = firsts if limit is None else F.slice(firsts, 1, limit)
    nodes = F.col("_nodes")

    def record(l):
        text = text_of(nodes, F.struct(l["t0"].alias("t0"), l["t1"].alias("t1"), F.lit(False).alias("own_raw")), TEXT)
        parent = text_of(nodes, F.struct(l["p_t0"].alias("t0"), l["p_t1"].alias("t1"),
                                         F.lit(False).alias("own_raw")), RAW)
        pimg = _at(F.filter(F.col("imgs"), lambda im: F.array_contains(im["anc"], l["parent_idx"])), 1)["src"]
        return F.struct(l["i"].alias("card_idx"), l["href"].alias("href"), text.alias("text"),
                        F.coalesce(parent, F.lit("")).alias("parent_text"), pimg.alias("img"))

    rows = g.select("page_id", "url", F.explode(F.transform(top, record)).alias("r")).select("page_id", "url", "r.*")
    raw_title = F.substring_index(F.substring_index(F.col("text"), " EUR", 1), " +", 1)
    title = F.trim(F.regexp_replace(raw_title, SIZE_TOKENS, ""))
    price = F.regexp_extract(F.col("parent_text"), PARENT_PRICE, 1)
    url = absolutize(F.col("href"), F.col("url"))
    return rows.select(
        "page_id", "card_idx", url.alias("product_url"),
        F.coalesce(F.nullif(external_id(url), F.lit("")), _at(F.split(url, "/"), -1)).alias("external_id"),
        F.when((F.length("text") > LINK_MIN_TITLE) & (title != ""), title).alias("title"),
        F.when(price != "", F.concat(price, F.lit(" EUR"))).alias("price"),
        absolutize(F.col("img"), F.col("url")).alias("image_url"))


def link_records(pages: DataFrame | None, selectors: dict, mode: str = "substring",
                 limit: int | None = None, els: DataFrame | None = None) -> DataFrame:
    """Link-only records (one aggregate per page: links, images, the page
    text; no joins); every link unless ``limit`` is given (L4)."""
    els = elements(pages) if els is None else els
    g = apply_rules(els, ["page_id", "url"], _link_page_rules(selectors, mode), with_nodes=True)
    return _link_rows(g, limit)


def listing_page_records(pages: DataFrame, selectors: dict, mode: str = "substring",
                         limit: int | None = None) -> DataFrame:
    """Cards when a page has containers, else link-only records.
    One element pass and one aggregate per page; the one-row-per-page result
    is persisted and read by both branches."""
    from pyspark import StorageLevel

    from vitrine.operators.selectors import aggregate_grouped_rules, explode_groups

    cont_sel = selectors.get("products", ".product-item")
    page_rules = [("containers", matches(cont_sel), F.col("idx"), "all")] + _link_page_rules(selectors, mode)
    agg = aggregate_grouped_rules(elements(pages), ["page_id", "url"], _container_of(cont_sel),
                                  _card_rules(selectors), "c_idx", page_rules).persist(StorageLevel.MEMORY_AND_DISK)
    has_cards = F.size("containers") > 0
    cards = _card_rows(explode_groups(agg.where(has_cards), ["page_id", "url"]))
    links = _link_rows(agg.where(~has_cards), limit)
    return cards.unionByName(links, allowMissingColumns=True)


# ---- Fixed values that must equal the reference's for right results. ----
DYN_CONTAINER = ".product-block__inner"
DYN_TITLE = "h1, .product-title, .title"
DYN_PRICE = ".price, .product-price"
DYN_SALE = ".sale-price, .price--sale, [data-sale-price], .compare-at-price"
DYN_DESC = '.product-description, .description, [class*="description"]'
DYN_GENDER = ".gender, .category, .collection-title, h1"
TITLE_MEN = ["men's", "man's", "male", "for men", "men only"]
TITLE_WOMEN = ["women's", "woman's", "female", "for women", "women only"]
PATH_WOMEN = ["/collections/women", "/women"]
PATH_MEN = ["/collections/men", "/men"]
# ---- end of fixed values ----


def listing_cards_dynamic(pages: DataFrame, selectors: dict, mode: str = "substring") -> DataFrame:
    """E4 with E13 (gender) and E15 (coarse category) chains, F5 image filter
    and F10 (cards without a usable image are dropped). Works on saved
    snapshots of dynamically loaded listing pages."""
    from vitrine.functions.images import desired_image
    from vitrine.operators.selectors import _compound, apply_grouped_rules

    els = elements(pages)
    cont_sel = selectors.get("products", DYN_CONTAINER)
    link_sel = selectors.get("product_url", "a[href*='/products/']")
    title_sel = selectors.get("title", DYN_TITLE)
    price_sel = selectors.get("price", DYN_PRICE)
    sale_sel = selectors.get("sale", DYN_SALE)
    img_sel = selectors.get("image_url", "img")
    gender_sel = selectors.get("gender", DYN_GENDER)

    def anc_pred(a):
        out = F.lit(False)
        for member in cont_sel.split(","):
            out = out | _compound(member.strip(), a["tag"], a["elem_id"], a["classes"], None)
        return out

    src = F.coalesce(F.nullif(_attr("src"), F.lit("")), _attr("data-src"))
    cont = _at(F.filter(F.col("ancestors"), anc_pred), -1)["idx"]
    # cards and the page context (title, meta, breadcrumbs, gender element)
    # come out of one aggregate per page
    j = apply_grouped_rules(els, ["page_id", "url"], cont, [
        ("href", matches(link_sel), _attr("href"), "first"),
        ("title_raw", matches(title_sel), RAW, "first"),
        ("price_raw", matches(price_sel), RAW, "first"),
        ("sale_raw", matches(sale_sel), RAW, "first"),
        ("srcs", matches(img_sel) & src.isNotNull(), src, "all"),
        ("desc", matches(DYN_DESC), RAW, "first")], group_name="c_idx", page_rules=[
        ("page_title", matches("title"), RAW, "first"),
        ("meta_desc", matches('meta[name="description"]'), _attr("content"), "first"),
        ("crumbs", matches(BREADCRUMBS), RAW, "all"),
        ("gender_text", matches(gender_sel), RAW, "first")])
    url = absolutize(F.col("href"), F.col("url"))
    title = F.nullif(strip_blanks(F.col("title_raw")), F.lit(""))
    price = F.nullif(strip_blanks(F.col("price_raw")), F.lit(""))
    sale = F.nullif(strip_blanks(F.col("sale_raw")), F.lit(""))
    imgs = F.array_distinct(F.filter(F.transform("srcs", lambda s: absolutize(s, F.col("url"))), desired_image))
    crumb_g = _at(F.filter(F.transform("crumbs", lambda c: C.gender_generic(c, mode)), lambda x: x.isNotNull()), 1)
    crumb_c = _at(F.filter(F.transform("crumbs", lambda c: C.coarse_category(c, mode)), lambda x: x.isNotNull()), 1)
    low_title = F.lower(F.coalesce(F.col("title_raw"), F.lit("")))
    low_desc = F.lower(F.coalesce(F.col("desc"), F.lit("")))
    page_path = F.lower(F.col("url"))
    gender = F.coalesce(
        C.gender_generic(url, mode), C.gender_title(F.col("page_title"), mode), C.gender_meta(F.col("meta_desc")),
        crumb_g, C.gender_generic(F.col("gender_text"), mode),
        F.when(C.has_any(low_title, TITLE_WOMEN, "substring"), F.lit("women"))
         .when(C.has_any(low_title, TITLE_MEN, "substring"), F.lit("men")),
        F.when(C.has_any(low_desc, C.DESC_WOMEN, "substring"), F.lit("women"))
         .when(C.has_any(low_desc, C.DESC_MEN, "substring"), F.lit("men")),
        F.when(C.has_any(page_path, PATH_WOMEN, "substring"), F.lit("women"))
         .when(C.has_any(page_path, PATH_MEN, "substring"), F.lit("men")))
    category = F.coalesce(
        C.coarse_category(url, mode), C.coarse_category(F.col("page_title"), mode),
        C.coarse_category(F.col("meta_desc"), mode), crumb_c, C.coarse_category(F.col("gender_text"), mode),
        C.coarse_category(F.col("title_raw"), mode), C.coarse_category(F.col("desc"), mode),
        C.coarse_category_from_path(F.col("url")), C.keyword_category(title), F.lit("other"))
    out = j.where(F.coalesce(F.col("href"), F.lit("")) != "").select(
        "page_id", F.col("c_idx").alias("card_idx"), url.alias("product_url"),
        _at(F.split(url, "/"), -1).alias("external_id"),
        title.alias("title"), price.alias("price"),
        F.when(sale.isNotNull() & ~F.coalesce(sale == price, F.lit(False)), sale).alias("sale"),
        _at(imgs, 1).alias("image_url"),
        F.when(F.size(imgs) > 1, F.array_join(F.slice(imgs, 2, 1 << 20), ",")).alias("additional_images"),
        gender.alias("gender"), category.alias("category"))
    return out.where(F.col("image_url").isNotNull())      # F10
