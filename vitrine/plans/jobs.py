"""Composite jobs (W1 catalog run, W2 site run, W5 listing page).

Each is one DataFrame plan from pages to the next catalog version; the driver
handles only the site spec rows, version numbers and the run counters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.text import labelled_search_text, plain_search_text
from vitrine.operators.changes import classify, run_summary
from vitrine.operators.dedupe import keep_first_accepted
from vitrine.operators.elements import elements, elements_once
from vitrine.operators.embed import embed_column, embed_flagged, hashed_text_embedding
from vitrine.operators.extract import listing_cards, product_records_p1, product_records_p2
from vitrine.functions.urls import url_path
from vitrine.operators.merge import merge_catalog
from vitrine.operators.topk import top_n_per_group
from vitrine.operators.records import format_products
from vitrine.sources.catalog import CatalogTable, append_run_log, write_dead_letter
from vitrine.session import checkpoint_dir, materialize
from vitrine.sources.sites import load_spec

# Fixed values of the first pipeline (source, brand, constants).
P1_SOURCE = "scraper-shop"
P1_BRAND = "Shop"


def _embed(rows: DataFrame, image_fn: Callable | None, text_fn: Callable | None, dim: int,
           text_col: str = "search_text") -> DataFrame:
    """V1 + V2 on flagged rows only (C3): the plan splits into embed / keep
    branches, so unchanged rows never reach a model; the merge keeps the
    stored vectors for them."""
    rows = rows.drop("image_embedding", "info_embedding")
    if image_fn is not None:
        rows = embed_flagged(rows, "embed_image", "image_embedding",
                             lambda d: embed_column(d, "image_url", "image_embedding", image_fn, dim, error_col="image_error"))
    else:
        rows = rows.withColumns({"image_embedding": F.lit(None).cast("array<float>"), "image_error": F.lit(None).cast("string")})
    if text_fn is not None:
        stage = lambda d: embed_column(d, text_col, "info_embedding", text_fn, dim, error_col="text_error")
    else:
        stage = lambda d: hashed_text_embedding(d, text_col, "info_embedding", dim)
    rows = embed_flagged(rows, "embed_text", "info_embedding", stage)
    return rows if text_fn is not None else rows.withColumn("text_error", F.lit(None).cast("string"))


def catalog_run(spark: SparkSession, pages: DataFrame, table: CatalogTable, run: int, run_ts: str | None = None,
                source: str = P1_SOURCE, brand: str = P1_BRAND, max_products: int | None = None,
                image_fn: Callable | None = None, text_fn: Callable | None = None, dim: int = 768,
                dead_letter: str | None = None, run_log: str | None = None):
    """Product pages -> P1 records -> change status -> embeddings for the
    flagged rows -> merge (last seen, stale removal) -> version ``run``.

    Returns ``(merged, summary)``. ``max_products`` is the test-mode limit
    (L3), applied to URLs before the costly extraction. ``dead_letter`` and
    ``run_log`` name folders for the run's rejected rows (S7) and its counters
    (S8). A row whose model failed is stored without that vector (a later run asks
    again) and is listed among the rejected ones with the model's reason.
    """
    checkpoint_dir(spark)
    if max_products is not None:
        pages = pages.orderBy("url").limit(max_products)
    recs = product_records_p1(pages).withColumns({
        "source": F.lit(source), "brand": F.lit(brand), "second_hand": F.lit(False),
        "sale": F.col("price"),
    })
    fmt = format_products(recs)
    inc = keep_first_accepted(fmt, ["id"], ["product_url"])
    mine = table.read_base(run, [source])          # only this source's folder is read
    # computed once: the merge, the write and the counters all read it
    cls = materialize(classify(inc, mine, retry_missing=True), "classified")
    cols = {c: F.col(c) for c in cls.columns}
    cls = cls.withColumn("search_text", labelled_search_text(cols))
    # written once: the merge and the error list both read it, and the models run once
    embedded = materialize(_embed(cls, image_fn, text_fn, dim), "embedded")
    merged = merge_catalog(mine, embedded.drop("search_text", "image_error", "text_error"), run, run_ts, marks=True, buckets=table.buckets).cache()
    table.commit_changes(merged, run, [source])    # only what changed is written
    # the counters are one row: computed now, so the cached merge can be released
    summary = run_summary(cls, run, merged.where(F.col("action") == "delete"))
    summary = spark.createDataFrame(summary.collect(), summary.schema)
    merged.unpersist()
    merged = merged.drop("write")
    if dead_letter:
        failures = [F.when(F.col(c).isNotNull(), F.concat(F.lit(c + ": "), F.col(c))) for c in ("image_error", "text_error")]
        reason = F.coalesce("reject_reason", F.nullif(F.concat_ws("; ", *failures), F.lit("")))
        write_dead_letter(embedded.withColumn("reject_reason", reason).select(*inc.columns), dead_letter, run)
    if run_log:
        append_run_log(summary, run_log)
    return merged, summary


def _host(url: "Column"):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def _per_site(site_col, values: dict):
    """A constant per configured site (CASE over the spec; its size is the
    number of configured sites)."""
    out = None
    for name, v in values.items():
        out = F.when(site_col == name, F.lit(v)) if out is None else out.when(site_col == name, F.lit(v))
    return out


def site_records(spark: SparkSession, listing_pages: DataFrame, product_pages: DataFrame, spec,
                 persisted: list | None = None, limit: int | None = None) -> DataFrame:
    """W2 up to the sink: listing cards of every site (O4 union), details of
    the listed products only (semi join before the costly extraction), J2
    merge with detail priority, F13 site constants, E27 search text.

    Listing pages and the listed product pages are each parsed once for all
    sites; every site's selector rules then run on its own element rows
    (selected by host), so adding sites adds rule branches, not scans."""
    spec = load_spec(spec)
    hosts = {name: s.get("base_url", "").split("://", 1)[-1].split("/", 1)[0].lower() for name, s in spec.items()}
    keep = persisted if persisted is not None else []

    # persisted only when several site branches read the same element rows
    parse = elements_once if len(spec) > 1 else elements
    lp_els = parse(listing_pages.where(_host(F.col("url")).isin(*hosts.values())))
    keep.append(lp_els)
    card_parts = []
    for name, s in spec.items():   # one rule branch per configured site (config, not data)
        sel = s.get("selectors") or {}
        cards = listing_cards(None, sel, els=lp_els.where(_host(F.col("url")) == hosts[name]))
        cards = cards.withColumn("site", F.lit(name))
        if limit is not None:
            # L2: the first `limit` listings of each category (its listing
            # pages share the URL path), in page and document order
            cards = top_n_per_group(cards.withColumn("category", url_path(F.col("page_url"))), ["site", "category"],
                                    [F.col("page_id"), F.col("card_idx")], limit, "_rank").drop("_rank", "category")
        card_parts.append(cards)
    cards = card_parts[0]
    for c in card_parts[1:]:
        cards = cards.unionByName(c)

    wanted = cards.select(F.col("product_url").alias("url")).distinct()
    pp_els = parse(product_pages.join(wanted, "url", "left_semi"))
    keep.append(pp_els)
    det_parts = []
    for name, s in spec.items():
        det = product_records_p2(None, s.get("selectors") or {}, brand=s.get("brand") or "",
                                 els=pp_els.where(_host(F.col("url")) == hosts[name]))
        det_parts.append(det.drop("page_id").withColumn("site", F.lit(name)))
    det = det_parts[0]
    for d in det_parts[1:]:
        det = det.unionByName(d)

    listing = cards.select("site", "product_url", F.col("external_id").alias("l_external_id"),
                           F.col("title").alias("l_title"), F.col("price").alias("l_price"),
                           F.col("image_url").alias("l_image_url"))
    j = listing.join(det, ["site", "product_url"], "left")
    has_detail = F.col("title").isNotNull() | F.col("price").isNotNull()
    site = F.col("site")
    out = j.select(
        "site", "product_url",
        # each site's constants from its spec
        _per_site(site, {n: s.get("source") for n, s in spec.items()}).alias("source"),
        _per_site(site, {n: s.get("merchant_name") for n, s in spec.items()}).alias("merchant_name"),
        _per_site(site, {n: s.get("brand") for n, s in spec.items()}).alias("brand"),
        _per_site(site, {n: bool(s.get("second_hand", False)) for n, s in spec.items()}).alias("second_hand"),
        _per_site(site, {n: s.get("country", "eu") for n, s in spec.items()}).alias("country"),
        F.coalesce("external_id", "l_external_id").alias("external_id"),
        F.coalesce("title", "l_title").alias("title"),
        F.coalesce("price", "l_price").alias("price"),
        F.coalesce("image_url", "l_image_url").alias("image_url"),
        "sale", "additional_images", "size", "gender", "description", "category",
        has_detail.alias("has_detail"))
    cols = {c: F.col(c) for c in out.columns}
    meta = F.create_map(F.lit("merchant_name"), F.col("merchant_name"), F.lit("country"), F.col("country"))
    return out.withColumn("info_text", plain_search_text(cols, meta))


def site_run(spark: SparkSession, listing_pages: DataFrame, product_pages: DataFrame, spec,
             table: CatalogTable, run: int, run_ts: str | None = None, limit: int | None = None) -> DataFrame:
    """W2 with the sink (S4): formatted, deduplicated, merged into version ``run``."""
    from vitrine.sources.catalog import upsert

    persisted: list = []
    recs = site_records(spark, listing_pages, product_pages, spec, persisted, limit)
    fmt = format_products(recs)
    sources = [s.get("source") for s in load_spec(spec).values() if s.get("source")]
    merged = upsert(table, keep_first_accepted(fmt, ["id"], ["product_url"]), run, run_ts, sources=sources)
    for df in persisted:          # the version is committed: release the element rows
        df.unpersist()
    return merged


def listing_page_records(pages: DataFrame, selectors: dict) -> DataFrame:
    """Cards when a page has containers; else link-only records."""
    from vitrine.operators.extract import listing_page_records as records

    return records(pages, selectors)
