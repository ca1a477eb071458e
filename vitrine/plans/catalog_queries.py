"""Registered catalog queries (change, merge, staleness, dedupe, limits) with
their DuckDB oracles. Every query reads the given tables through the
fixtures, so its work grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.price import normalize_price, price_suspect
from vitrine.functions.text import labelled_search_text, plain_search_text
from vitrine.functions.urls import external_id
from vitrine.operators.changes import classify, run_summary, status_counts
from vitrine.operators.dedupe import keep_first, keep_last
from vitrine.operators.merge import (deleted_count, delete_keys, merge_catalog, stale_rows,
                                     touch_last_seen, uniqueness_report)
from vitrine.operators.records import format_products
from vitrine.operators.topk import newest_n, top_n_per_group
from vitrine.plans import sqlparts as S
from vitrine.sources.fixtures import catalog_new, catalog_old, price_texts, sightings, with_fixtures
from vitrine.sources.tables import read_table

# Parameters of the registered runs.
CURRENT_RUN = 5          # run number passed to the catalog run (Q2: explicit)
SIGHTING_RUN = 80        # 2001-09 in months since 1995-01, one past the data
RUN_TS = "2024-06-01 00:00:00"
PER_CATEGORY = 5
TEST_MODE_LIMIT = 3


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """This run's rows: formatted (F14, X1, X7, F4) and one per id (A4)."""
    fmt = format_products(catalog_new(spark, sf_dir), keep=("ord",))
    return keep_first(fmt, ["id"], ["ord"]).drop("ord")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_products(catalog_old(spark, sf_dir)).drop("reject_reason")


# ---------------------------------------------------------------- Spark side

def q_change_status_counts(spark, sf_dir):
    return status_counts(classify(incoming(spark, sf_dir), stored(spark, sf_dir)))


def q_change_classify(spark, sf_dir):
    c = classify(incoming(spark, sf_dir), stored(spark, sf_dir))
    return c.select("id", "status", "reason",
                    F.array_join("changed_fields", ",").alias("changed"),
                    "embed_image", "embed_text")


def q_price_normalize(spark, sf_dir):
    p = price_texts(spark, sf_dir)
    return p.select("p_partkey", normalize_price(F.col("s")).alias("price"),
                    price_suspect(F.col("s")).alias("suspect"))


def q_format_reject(spark, sf_dir):
    f = format_products(catalog_new(spark, sf_dir), keep=("ord",))
    return f.select("id", "ord", "price", "reject_reason", "second_hand")


def q_dedupe_keep_first(spark, sf_dir):
    f = format_products(catalog_new(spark, sf_dir), keep=("ord",))
    return keep_first(f, ["id"], ["ord"]).select("id", "ord", "size")


def q_dedupe_keep_last(spark, sf_dir):
    f = format_products(catalog_new(spark, sf_dir), keep=("ord",))
    return keep_last(f, ["id"], ["ord"]).select("id", "ord", "size")


def q_merge_catalog(spark, sf_dir):
    m = merge_catalog(stored(spark, sf_dir), incoming(spark, sf_dir), CURRENT_RUN, RUN_TS)
    return m.select("id", "title", "price", "image_url", "last_seen_run", "action",
                    F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def q_merge_action_counts(spark, sf_dir):
    m = merge_catalog(stored(spark, sf_dir), incoming(spark, sf_dir), CURRENT_RUN, RUN_TS)
    return m.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def q_stale_products(spark, sf_dir):
    st = stale_rows(stored(spark, sf_dir), incoming(spark, sf_dir).where(F.col("reject_reason").isNull()),
                    CURRENT_RUN)
    return st.select("id", "source", "product_url", "last_seen_run")


def q_touch_last_seen(spark, sf_dir):
    t = touch_last_seen(stored(spark, sf_dir), incoming(spark, sf_dir).where(F.col("reject_reason").isNull()),
                        CURRENT_RUN)
    return t.select("id", "title", "price", "last_seen_run")


def q_delete_stale(spark, sf_dir):
    cat = stored(spark, sf_dir)
    keys = stale_rows(cat, incoming(spark, sf_dir).where(F.col("reject_reason").isNull()), CURRENT_RUN)
    return delete_keys(cat, keys).select("id", "source", "product_url")


def q_delete_count(spark, sf_dir):
    cat = stored(spark, sf_dir)
    keys = stale_rows(cat, incoming(spark, sf_dir).where(F.col("reject_reason").isNull()), CURRENT_RUN)
    return deleted_count(cat, keys)


def q_last_seen_sightings(spark, sf_dir):
    """C5 over sightings: last run each part was seen and whether it is stale."""
    s = sightings(spark, sf_dir)
    last = s.groupBy("l_partkey").agg(F.max("run").alias("last_seen_run"),
                                      F.count(F.lit(1)).alias("n_sightings"))
    return last.withColumn("stale", (F.lit(SIGHTING_RUN) - F.col("last_seen_run")) >= 2)


def q_uniqueness_url(spark, sf_dir):
    f = format_products(catalog_new(spark, sf_dir), keep=("ord",))
    return uniqueness_report(f, ["source", "product_url"])


def q_uniqueness_external_id(spark, sf_dir):
    f = catalog_old(spark, sf_dir).withColumn("external_id", external_id(F.col("product_url")))
    return uniqueness_report(f, ["source", "external_id"])


def q_product_count(spark, sf_dir):
    """A1: count per source of the stored catalog."""
    return stored(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def q_site_success(spark, sf_dir):
    """A10: per source accepted / rejected rows and success (any accepted)."""
    f = format_products(catalog_new(spark, sf_dir))
    ok = F.col("reject_reason").isNull()
    return f.groupBy("source").agg(
        F.sum(ok.cast("int")).cast("bigint").alias("n_ok"),
        F.sum((~ok).cast("int")).cast("bigint").alias("n_rejected"),
        (F.sum(ok.cast("int")) > 0).alias("success"))


def q_all_sites_success(spark, sf_dir):
    """A10: the run succeeds only if every site produced an accepted row."""
    per_site = q_site_success(spark, sf_dir)
    return per_site.agg(F.bool_and("success").alias("all_success"),
                        F.count(F.lit(1)).alias("sites"),
                        F.sum(F.col("success").cast("int")).cast("bigint").alias("sites_ok"))


def q_run_summary(spark, sf_dir):
    cat = stored(spark, sf_dir)
    inc = incoming(spark, sf_dir)
    c = classify(inc, cat)
    dead = stale_rows(cat, inc.where(F.col("reject_reason").isNull()), CURRENT_RUN)
    return run_summary(c, CURRENT_RUN, dead)


def q_limit_per_category(spark, sf_dir):
    return top_n_per_group(incoming(spark, sf_dir), ["category"], [F.col("product_url")], PER_CATEGORY).select(
        "category", "product_url", "rank")


def q_test_mode_limit(spark, sf_dir):
    f = incoming(spark, sf_dir)
    return f.orderBy("product_url").limit(TEST_MODE_LIMIT).select("product_url")


def q_recent_events(spark, sf_dir):
    """L1: newest 10 of one event type (the 'source'), id as tie-break."""
    ev = read_table(spark, sf_dir, "events")
    return newest_n(ev.where(F.col("event_type") == "purchase"), "ts", "event_id", 10).select(
        "event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


def q_search_text(spark, sf_dir):
    f = incoming(spark, sf_dir).where(F.col("reject_reason").isNull())
    cols = {c: F.col(c) for c in f.columns}
    return f.select("id", labelled_search_text(cols).alias("labelled"),
                    plain_search_text(cols).alias("plain"))


QUERIES = {
    "change_status_counts": q_change_status_counts,
    "change_classify": q_change_classify,
    "price_normalize": q_price_normalize,
    "format_reject": q_format_reject,
    "dedupe_keep_first": q_dedupe_keep_first,
    "dedupe_keep_last": q_dedupe_keep_last,
    "merge_catalog": q_merge_catalog,
    "merge_action_counts": q_merge_action_counts,
    "stale_products": q_stale_products,
    "touch_last_seen": q_touch_last_seen,
    "delete_stale": q_delete_stale,
    "delete_count": q_delete_count,
    "last_seen_sightings": q_last_seen_sightings,
    "uniqueness_url": q_uniqueness_url,
    "uniqueness_external_id": q_uniqueness_external_id,
    "product_count": q_product_count,
    "site_success": q_site_success,
    "all_sites_success": q_all_sites_success,
    "run_summary": q_run_summary,
    "limit_per_category": q_limit_per_category,
    "test_mode_limit": q_test_mode_limit,
    "recent_events": q_recent_events,
    "search_text": q_search_text,
}

# ---------------------------------------------------------------- DuckDB side

_FMT = f"""fmt AS (
  SELECT {S.row_id('source', 'product_url')} AS id, source, product_url, image_url, title, category, size,
         coalesce({S.normalize_price('price')}, '') AS price, ord, {S.reject_reason()} AS reject_reason
  FROM catalog_new)"""
_INC = "inc AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM fmt) WHERE rn = 1)"
_OLD = f"""old AS (
  SELECT {S.row_id('source', 'product_url')} AS id, source, product_url, image_url, title, category, size,
         coalesce({S.normalize_price('price')}, '') AS price, last_seen_run
  FROM catalog_old)"""
_FIELDS = ["title", "price", "image_url", "category", "size"]


def _changed_list(a: str, b: str) -> str:
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN NOT {S.same_text(f'{a}.{f}', f'{b}.{f}')} THEN '{f}' END"
        for f in ["title", "price", "sale", "image_url", "description", "category", "gender", "size",
                  "additional_images"] if f in _FIELDS) + ")"


def _all_same(a: str, b: str) -> str:
    return " AND ".join(S.same_text(f"{a}.{f}", f"{b}.{f}") for f in _FIELDS)


_CLS = f"""cls AS (
  SELECT i.id, i.image_url, o.image_url AS old_image_url, i.reject_reason AS reason, o.id AS old_id,
    CASE WHEN i.reject_reason IS NOT NULL THEN 'failed' WHEN o.id IS NULL THEN 'new'
         WHEN {_all_same('i', 'o')} THEN 'unchanged' ELSE 'updated' END AS status,
    CASE WHEN o.id IS NOT NULL AND i.reject_reason IS NULL THEN {_changed_list('i', 'o')} END AS changed
  FROM inc i LEFT JOIN old o ON i.id = o.id)"""
_SEEN = "seen AS (SELECT id FROM inc WHERE reject_reason IS NULL)"
_STALE = f"stale AS (SELECT o.* FROM old o WHERE o.id NOT IN (SELECT id FROM seen) AND {CURRENT_RUN} - coalesce(o.last_seen_run, 0) >= 2)"
_MERGE = f"""m AS (
  SELECT coalesce(o.id, i.id) AS id,
    CASE WHEN i.id IS NOT NULL AND i.reject_reason IS NULL AND o.id IS NULL THEN 'insert'
         WHEN i.id IS NOT NULL AND i.reject_reason IS NULL AND NOT ({_all_same('o', 'i')}) THEN 'update'
         WHEN i.id IS NOT NULL AND i.reject_reason IS NULL THEN 'touch'
         WHEN o.id IS NOT NULL AND {CURRENT_RUN} - coalesce(o.last_seen_run, 0) >= 2 THEN 'delete'
         WHEN o.id IS NOT NULL THEN 'keep' END AS action,
    o.title AS o_title, o.price AS o_price, o.image_url AS o_image_url, o.last_seen_run AS o_last,
    i.title AS i_title, i.price AS i_price, i.image_url AS i_image_url,
    (i.id IS NOT NULL AND i.reject_reason IS NULL) AS seen
  FROM old o FULL OUTER JOIN inc i ON o.id = i.id)"""


def _w(*names: str) -> str:
    return with_fixtures(*names)


ORACLES = {
    "change_status_counts": _w("catalog_old", "catalog_new") + f""", {_FMT}, {_INC}, {_OLD}, {_CLS}
SELECT s.status, CAST(count(c.status) AS BIGINT) AS n
FROM (VALUES ('new'), ('updated'), ('unchanged'), ('failed')) s(status) LEFT JOIN cls c ON c.status = s.status
GROUP BY s.status""",
    "change_classify": _w("catalog_old", "catalog_new") + f""", {_FMT}, {_INC}, {_OLD}, {_CLS}
SELECT id, status, reason, changed,
  CASE WHEN status = 'new' THEN image_url IS NOT NULL
       WHEN status = 'updated' THEN NOT coalesce(image_url = old_image_url, false) ELSE false END AS embed_image,
  status IN ('new', 'updated') AS embed_text
FROM cls""",
    "price_normalize": _w("price_texts") + f"""
SELECT p_partkey, {S.normalize_price('s')} AS price,
       coalesce(regexp_matches(s, '\\d{{1,3}}([.,]\\d{{3}})+([.,]\\d+)?'), false) AS suspect
FROM price_texts""",
    "format_reject": _w("catalog_new") + f""", {_FMT}
SELECT id, ord, price, reject_reason, false AS second_hand FROM fmt""",
    "dedupe_keep_first": _w("catalog_new") + f""", {_FMT}
SELECT id, ord, size FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) rn FROM fmt) WHERE rn = 1""",
    "dedupe_keep_last": _w("catalog_new") + f""", {_FMT}
SELECT id, ord, size FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) rn FROM fmt) WHERE rn = 1""",
    "merge_catalog": _w("catalog_old", "catalog_new") + f""", {_FMT}, {_INC}, {_OLD}, {_MERGE}
SELECT id,
  CASE WHEN action IN ('insert', 'update') THEN i_title ELSE o_title END AS title,
  CASE WHEN action IN ('insert', 'update') THEN i_price ELSE o_price END AS price,
  CASE WHEN action IN ('insert', 'update') THEN i_image_url ELSE o_image_url END AS image_url,
  CAST(CASE WHEN seen THEN {CURRENT_RUN} ELSE o_last END AS INTEGER) AS last_seen_run,
  action,
  CASE WHEN action IN ('insert', 'update') THEN '{RUN_TS}' END AS updated_at
FROM m WHERE action IS NOT NULL""",
    "merge_action_counts": _w("catalog_old", "catalog_new") + f""", {_FMT}, {_INC}, {_OLD}, {_MERGE}
SELECT action, count(*) AS n FROM m WHERE action IS NOT NULL GROUP BY action""",
    "stale_products": _w("catalog_old", "catalog_new") + f""", {_FMT}, {_INC}, {_OLD}, {_SEEN}, {_STALE}
SELECT id, source, product_url, last_seen_run FROM stale""",
    "touch_last_seen": _w("catalog_old", "catalog_new") + f""", {_FMT}, {_INC}, {_OLD}, {_SEEN}
SELECT id, title, price, CAST({CURRENT_RUN} AS INTEGER) AS last_seen_run FROM old WHERE id IN (SELECT id FROM seen)""",
    "delete_stale": _w("catalog_old", "catalog_new") + f""", {_FMT}, {_INC}, {_OLD}, {_SEEN}, {_STALE}
SELECT id, source, product_url FROM old o
WHERE NOT EXISTS (SELECT 1 FROM stale s WHERE s.source = o.source AND s.product_url = o.product_url)""",
    "delete_count": _w("catalog_old", "catalog_new") + f""", {_FMT}, {_INC}, {_OLD}, {_SEEN}, {_STALE}
SELECT count(*) AS deleted FROM old o
WHERE EXISTS (SELECT 1 FROM stale s WHERE s.source = o.source AND s.product_url = o.product_url)""",
    "last_seen_sightings": _w("sightings") + f"""
SELECT l_partkey, max(run) AS last_seen_run, count(*) AS n_sightings, ({SIGHTING_RUN} - max(run)) >= 2 AS stale
FROM sightings GROUP BY l_partkey""",
    "uniqueness_url": _w("catalog_new") + f""", {_FMT}
SELECT source, product_url, count(*) AS n FROM fmt GROUP BY source, product_url HAVING count(*) > 1""",
    "uniqueness_external_id": _w("catalog_old") + """
SELECT source, external_id, count(*) AS n FROM (
  SELECT source, CASE WHEN regexp_extract(product_url, '/products/([^/?#]+)', 1) <> ''
    THEN coalesce(nullif(regexp_extract(regexp_extract(product_url, '/products/([^/?#]+)', 1), '(\\d+)', 1), ''),
                  regexp_extract(product_url, '/products/([^/?#]+)', 1)) END AS external_id
  FROM catalog_old) GROUP BY source, external_id HAVING count(*) > 1""",
    "product_count": _w("catalog_old") + """
SELECT source, count(*) AS n FROM catalog_old GROUP BY source""",
    "site_success": _w("catalog_new") + f""", {_FMT}
SELECT source, CAST(sum(CASE WHEN reject_reason IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_ok,
       CAST(sum(CASE WHEN reject_reason IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_rejected,
       sum(CASE WHEN reject_reason IS NULL THEN 1 ELSE 0 END) > 0 AS success
FROM fmt GROUP BY source""",
    "all_sites_success": _w("catalog_new") + f""", {_FMT}, per_site AS (
  SELECT source, sum(CASE WHEN reject_reason IS NULL THEN 1 ELSE 0 END) > 0 AS success FROM fmt GROUP BY source)
SELECT bool_and(success) AS all_success, count(*) AS sites,
       CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS sites_ok FROM per_site""",
    "run_summary": _w("catalog_old", "catalog_new") + f""", {_FMT}, {_INC}, {_OLD}, {_CLS}, {_SEEN}, {_STALE}
SELECT CAST(count(*) FILTER (WHERE status = 'new') AS BIGINT) AS new_count,
       CAST(count(*) FILTER (WHERE status = 'updated') AS BIGINT) AS updated_count,
       CAST(count(*) FILTER (WHERE status = 'unchanged') AS BIGINT) AS unchanged_count,
       CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed_count,
       CAST((SELECT count(*) FROM stale) AS BIGINT) AS deleted_count,
       CAST({CURRENT_RUN} AS INTEGER) AS run
FROM cls""",
    "limit_per_category": _w("catalog_new") + f""", {_FMT}, {_INC}
SELECT category, product_url, rank FROM (
  SELECT category, product_url, CAST(row_number() OVER (PARTITION BY category ORDER BY product_url) AS INTEGER) AS rank
  FROM inc) WHERE rank <= {PER_CATEGORY}""",
    "test_mode_limit": _w("catalog_new") + f""", {_FMT}, {_INC}
SELECT product_url FROM inc ORDER BY product_url LIMIT {TEST_MODE_LIMIT}""",
    "recent_events": """
SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts
FROM events WHERE event_type = 'purchase' ORDER BY events.ts DESC, event_id DESC LIMIT 10""",
    "search_text": _w("catalog_new") + f""", {_FMT}, {_INC}
SELECT id,
  concat_ws(' | ', CASE WHEN coalesce(title, '') <> '' THEN 'Title: ' || title END,
                   CASE WHEN coalesce(category, '') <> '' THEN 'Category: ' || category END,
                   CASE WHEN coalesce(price, '') <> '' THEN 'Price: ' || price END,
                   CASE WHEN coalesce(size, '') <> '' THEN 'Sizes: ' || size END) AS labelled,
  concat_ws(' ', {S.blank_to_null('title')}, {S.blank_to_null('category')}, {S.blank_to_null('price')},
                 {S.blank_to_null('size')}) AS plain
FROM inc WHERE reject_reason IS NULL""",
}
