"""Registered composite jobs: the site run up to the sink (W2, J2, F13, E27),
the catalog run (W1) and micro-batch ingestion (T1). The two writers use a
fresh folder under the session's shared checkpoint folder per call."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitrine.plans import sqlparts as S
from vitrine.plans.jobs import catalog_run, site_records
from vitrine.plans.page_queries import _IMG, _P, _U
from vitrine.session import checkpoint_dir
from vitrine.sources.catalog import CatalogTable
from vitrine.sources.page_fixtures import listing_pages, product_pages
from vitrine.sources.sites import DEFAULT_SPEC_PATH, load_spec
from vitrine.streaming.incremental import stream_pages_into_catalog

RUN_TS = "2024-06-01 00:00:00"
STREAM_FILES = 3


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def q_site_run_records(spark, sf_dir):
    r = site_records(spark, listing_pages(spark, sf_dir), product_pages(spark, sf_dir), DEFAULT_SPEC_PATH)
    return r.select("site", "source", "brand", "country", "product_url", "external_id", "title", "price",
                    "image_url", "has_detail")


def q_catalog_run_summary(spark, sf_dir):
    table = CatalogTable(spark, _scratch(spark, "catalog-w1"))
    _, summary = catalog_run(spark, product_pages(spark, sf_dir), table, run=1, run_ts=RUN_TS, dim=16)
    return summary


def q_stream_catalog(spark, sf_dir):
    root = _scratch(spark, "stream-t1")
    inbox = f"{root}/inbox"
    product_pages(spark, sf_dir).repartition(STREAM_FILES, "page_id").write.parquet(inbox)
    spec = load_spec(DEFAULT_SPEC_PATH)["shop"]
    table = CatalogTable(spark, f"{root}/catalog")
    stream_pages_into_catalog(spark, inbox, table, f"{root}/checkpoint", spec["selectors"], spec["source"],
                              spec["brand"], files_per_batch=1, run_ts=RUN_TS, skip_unchanged=False)
    return table.read().select("id", "title", "price")


def repeated_deliveries(spark, sf_dir):
    """Three deliveries of the product pages: as they are; with other prices (every
    sixth page) and other markup (every sixth but one); and the same once more."""
    pages = product_pages(spark, sf_dir)
    nth = F.col("page_id") % 6
    html = (F.when(nth == 0, F.replace(F.col("html"), F.lit(" EUR</span>"), F.lit(" USD</span>")))
            .when(nth == 1, F.concat(F.col("html"), F.lit("<!-- rebuilt -->"))).otherwise(F.col("html")))
    later = pages.withColumn("html", html)
    return [pages, later, later]


def q_stream_changes(spark, sf_dir):
    """T1 with state: what each delivery of the same pages writes."""
    root = _scratch(spark, "stream-repeats")
    spec = load_spec(DEFAULT_SPEC_PATH)["shop"]
    table = CatalogTable(spark, f"{root}/catalog")
    for pages in repeated_deliveries(spark, sf_dir):
        pages.write.mode("append").parquet(f"{root}/inbox")
        stream_pages_into_catalog(spark, f"{root}/inbox", table, f"{root}/checkpoint", spec["selectors"], spec["source"],
                                  spec["brand"], files_per_batch=1_000_000, run_ts=RUN_TS)
    return table.history().select("version", "kind", "n")


def q_catalog_rerun_summary(spark, sf_dir):
    """W1 over a stored catalog: run 1 met the pages of 6 parts in 7; run 3 meets
    all but every eleventh, every third with another title."""
    table = CatalogTable(spark, _scratch(spark, "catalog-w1"))
    pages = product_pages(spark, sf_dir)
    k = F.col("page_id")
    first = pages.where(k % 7 != 0)
    later = pages.where(k % 11 != 0).withColumn(
        "html", F.when(k % 3 == 0, F.replace(F.col("html"), F.lit('"title": "'), F.lit('"title": "New '))).otherwise(F.col("html")))
    catalog_run(spark, first, table, run=1, run_ts=RUN_TS, dim=16)
    _, summary = catalog_run(spark, later, table, run=3, run_ts=RUN_TS, dim=16)
    return summary


QUERIES = {
    "stream_changes": q_stream_changes,
    "catalog_rerun_summary": q_catalog_rerun_summary,
    "site_run_records": q_site_run_records,
    "catalog_run_summary": q_catalog_run_summary,
    "stream_catalog": q_stream_catalog,
}

_RAW_P2_PRICE = f"CASE p_partkey % 6 WHEN 0 THEN {_P} || ' EUR' WHEN 2 THEN {_P} || ' EUR' ELSE {_P} END"

ORACLES = {
    "stream_changes": """
WITH p AS (SELECT p_partkey % 6 = 0 AS changed FROM part)
SELECT 1 AS version, 'row' AS kind, count(*) AS n FROM p
UNION ALL SELECT 2, 'row', count(*) FROM p WHERE changed
UNION ALL SELECT 2, 'seen', count(*) FROM p WHERE NOT changed
UNION ALL SELECT 3, 'seen', count(*) FROM p""",
    # only parts with a product-state script are accepted; a title edit is one in that script
    "catalog_rerun_summary": """
WITH p AS (SELECT p_partkey AS k, p_partkey % 5 = 4 AS good FROM part)
SELECT CAST(count(*) FILTER (WHERE good AND k % 11 <> 0 AND k % 7 = 0) AS BIGINT) AS new_count,
       CAST(count(*) FILTER (WHERE good AND k % 11 <> 0 AND k % 7 <> 0 AND k % 3 = 0) AS BIGINT) AS updated_count,
       CAST(count(*) FILTER (WHERE good AND k % 11 <> 0 AND k % 7 <> 0 AND k % 3 <> 0) AS BIGINT) AS unchanged_count,
       CAST(count(*) FILTER (WHERE NOT good AND k % 11 <> 0) AS BIGINT) AS failed_count,
       CAST(count(*) FILTER (WHERE good AND k % 11 = 0 AND k % 7 <> 0) AS BIGINT) AS deleted_count,
       CAST(3 AS INTEGER) AS run
FROM p""",
    "site_run_records": f"""
SELECT 'shop' AS site, 'shop-example' AS source, 'Shop' AS brand, 'eu' AS country,
  CASE WHEN p_partkey % 4 = 0 THEN {_U} ELSE {_U} || '/quick-view' END AS product_url,
  CAST(p_partkey AS VARCHAR) AS external_id,
  CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE 'Quick view' END AS title,
  CASE WHEN p_partkey % 4 = 0 THEN {_RAW_P2_PRICE} END AS price,
  CASE WHEN p_partkey % 4 = 0 THEN {_IMG} || '_1.jpg' END AS image_url,
  p_partkey % 4 = 0 AS has_detail
FROM part WHERE p_partkey % 4 IN (0, 2)""",
    "catalog_run_summary": """
SELECT CAST(count(*) FILTER (WHERE p_partkey % 5 = 4) AS BIGINT) AS new_count,
       CAST(0 AS BIGINT) AS updated_count, CAST(0 AS BIGINT) AS unchanged_count,
       CAST(count(*) FILTER (WHERE p_partkey % 5 <> 4) AS BIGINT) AS failed_count,
       CAST(0 AS BIGINT) AS deleted_count, CAST(1 AS INTEGER) AS run
FROM part""",
    "stream_catalog": f"""
SELECT {S.row_id("'shop-example'", _U)} AS id, p_name AS title, {S.normalize_price(_RAW_P2_PRICE)} AS price
FROM part""",
}
