"""Catalog operators: formatting, dedupe, change status, merge invariants,
versioned table (write, replay, delete, scan)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vitrine.operators.changes import classify, status_counts
from vitrine.operators.dedupe import keep_first, keep_last
from vitrine.operators.merge import merge_catalog, next_version
from vitrine.operators.records import UPSERT_COLUMNS, format_products
from vitrine.plans.catalog_queries import incoming, stored
from vitrine.sources.catalog import CatalogTable, delete_products, upsert


def test_sink_payload_drops_unknown_columns(spark):
    """The sink writes only whitelisted columns: a stray 'embedding' is gone."""
    rows = spark.createDataFrame(
        [("test", "https://example.com/p/1", "https://example.com/img1.jpg", "Product 1", [0.1] * 4, [0.2] * 4, None),
         ("test", "https://example.com/p/2", "https://example.com/img2.jpg", "Product 2", None, None, [0.99] * 4)],
        "source string, product_url string, image_url string, title string, image_embedding array<float>, "
        "info_embedding array<float>, embedding array<float>")
    out = format_products(rows)
    assert "embedding" not in out.columns
    assert set(UPSERT_COLUMNS) <= set(out.columns)
    r = {x.product_url: x for x in out.collect()}
    assert r["https://example.com/p/1"].image_embedding is not None
    assert r["https://example.com/p/2"].price == ""          # price is never null at the sink
    assert r["https://example.com/p/2"].second_hand is False


def test_reject_reasons(spark):
    rows = spark.createDataFrame([("s", "u1", "i", None), ("s", "u2", None, "t"), ("s", "u3", "i", "t")],
                                 "source string, product_url string, image_url string, title string")
    got = {r.product_url: r.reject_reason for r in format_products(rows).collect()}
    assert got == {"u1": "no_title", "u2": "no_image_url", "u3": None}


def test_keep_first_last_with_hot_key(spark):
    """A key holding most rows still yields one row, chosen by the order."""
    rows = [("hot", i, f"v{i}") for i in range(500)] + [("cold", 1, "c")]
    df = spark.createDataFrame(rows, "k string, ord int, v string")
    first = {r.k: r.v for r in keep_first(df, ["k"], ["ord"]).collect()}
    last = {r.k: r.v for r in keep_last(df, ["k"], ["ord"]).collect()}
    assert first == {"hot": "v0", "cold": "c"} and last == {"hot": "v499", "cold": "c"}


def test_status_counts_add_up(spark):
    inc = incoming(spark, SF_SMALL)
    c = classify(inc, stored(spark, SF_SMALL))
    counts = {r.status: r.n for r in status_counts(c).collect()}
    assert sum(counts.values()) == inc.count()
    assert set(counts) == {"new", "updated", "unchanged", "failed"}


def test_merge_one_row_per_id_and_actions(spark):
    m = merge_catalog(stored(spark, SF_SMALL), incoming(spark, SF_SMALL), 5, "2024-06-01 00:00:00")
    v = next_version(m)
    assert v.count() == v.select("id").distinct().count()
    acts = {r.action: r["count"] for r in m.groupBy("action").count().collect()}
    assert acts.get("delete", 0) > 0 and acts.get("insert", 0) > 0
    # touched rows keep their stored values except last_seen_run (Q1)
    t = m.where(F.col("action") == "touch").select("last_seen_run").distinct().collect()
    assert [r.last_seen_run for r in t] == [5]


def test_merge_is_idempotent(spark):
    s, i = stored(spark, SF_SMALL), incoming(spark, SF_SMALL)
    once = next_version(merge_catalog(s, i, 5, "2024-06-01 00:00:00"))
    twice = next_version(merge_catalog(once, i, 5, "2024-06-01 00:00:00"))
    cols = ["id", "title", "price", "image_url", "last_seen_run"]
    assert sorted(once.select(*cols).collect()) == sorted(twice.select(*cols).collect())


def test_versioned_table_replay_and_delete(spark, scratch):
    t = CatalogTable(spark, f"{scratch}/catalog")
    inc = incoming(spark, SF_SMALL)
    upsert(t, inc, 1, "2024-06-01 00:00:00")
    upsert(t, inc, 2, "2024-06-02 00:00:00")
    v2 = sorted(t.read().select("id", "title", "last_seen_run").collect())
    upsert(t, inc, 2, "2024-06-02 00:00:00")            # replay of run 2 rewrites the same version
    assert t.versions() == [1, 2]
    assert sorted(t.read().select("id", "title", "last_seen_run").collect()) == v2
    src = t.read().select("source").first().source
    assert t.scan_source(src).where(F.col("source") != src).count() == 0
    keys = t.read().where(F.col("source") == src).select("source", "product_url")
    n_src = keys.count()
    removed = delete_products(t, keys, 3)
    assert removed == n_src
    assert t.read().where(F.col("source") == src).count() == 0


def test_run_rewrites_only_touched_sources(spark, scratch):
    t = CatalogTable(spark, f"{scratch}/catalog")
    inc = incoming(spark, SF_SMALL).where(F.col("reject_reason").isNull())
    upsert(t, inc, 1, "2024-06-01 00:00:00")
    before = t.snapshot()
    one = sorted(before)[0]
    upsert(t, inc.where(F.col("source") == one), 2, "2024-06-02 00:00:00", expire=False)
    after = t.snapshot()
    assert after[one] == 2
    assert {s: v for s, v in after.items() if s != one} == {s: v for s, v in before.items() if s != one}
    assert t.read().count() == inc.count()


def test_dead_letter_and_run_log(spark, scratch):
    from vitrine.operators.changes import run_summary
    from vitrine.sources.catalog import append_run_log, write_dead_letter

    fmt = format_products(spark.createDataFrame(
        [("s", "u1", "i", None), ("s", "u2", "i", "t")],
        "source string, product_url string, image_url string, title string"))
    write_dead_letter(fmt, f"{scratch}/dead", 7)
    dead = spark.read.json(f"{scratch}/dead/run=000007").collect()
    assert [(r.product_url, r.reject_reason) for r in dead] == [("u1", "no_title")]
    inc = incoming(spark, SF_SMALL)
    summary = run_summary(classify(inc, stored(spark, SF_SMALL)), 7)
    append_run_log(summary, f"{scratch}/runlog")
    append_run_log(summary, f"{scratch}/runlog")
    log = spark.read.parquet(f"{scratch}/runlog").collect()
    assert len(log) == 2 and log[0].run == 7
    assert sum(log[0][c] for c in ("new_count", "updated_count", "unchanged_count", "failed_count")) == inc.count()


def test_absent_fields_keep_stored_values(spark):
    """Q4: an update without a description keeps the stored one; sale clears."""
    stored_rows = format_products(spark.createDataFrame(
        [("s", "u1", "i1", "T", "old desc", "10 EUR", "9 EUR")],
        "source string, product_url string, image_url string, title string, description string, "
        "price string, sale string")).drop("reject_reason")
    new_rows = format_products(spark.createDataFrame(
        [("s", "u1", "i2", "T", None, "11 EUR", None)],
        "source string, product_url string, image_url string, title string, description string, "
        "price string, sale string"))
    r = merge_catalog(stored_rows, new_rows, 2, "2024-06-01 00:00:00").first()
    assert r.action == "update" and r.description == "old desc" and r.sale is None and r.price == "11EUR"


def test_catalog_run_test_mode_and_second_run(spark, scratch):
    """W1 with the test-mode limit (L3), then a second full run: the first
    run's rows are unchanged or updated, never new again."""
    from vitrine.plans.jobs import P1_SOURCE, catalog_run
    from vitrine.sources.page_fixtures import product_pages

    t = CatalogTable(spark, f"{scratch}/catalog")
    pages = product_pages(spark, SF_SMALL)
    _, s1 = catalog_run(spark, pages, t, 1, "2024-06-01 00:00:00", max_products=3, dim=8)
    r1 = s1.first()
    assert r1.new_count + r1.failed_count == 3
    _, s2 = catalog_run(spark, pages, t, 2, "2024-06-02 00:00:00", dim=8)
    r2 = s2.first()
    assert r2.new_count + r2.updated_count + r2.unchanged_count + r2.failed_count == pages.count()
    assert r2.unchanged_count + r2.updated_count == r1.new_count
    assert t.snapshot() == {P1_SOURCE: 2}


def test_site_run_commits_the_site_source(spark, scratch):
    from vitrine.plans.jobs import site_run
    from vitrine.sources.page_fixtures import listing_pages, product_pages
    from vitrine.sources.sites import DEFAULT_SPEC_PATH

    t = CatalogTable(spark, f"{scratch}/catalog")
    site_run(spark, listing_pages(spark, SF_SMALL), product_pages(spark, SF_SMALL), DEFAULT_SPEC_PATH, t, 1,
             "2024-06-01 00:00:00")
    assert t.snapshot() == {"shop-example": 1}
    rows = t.read()
    assert rows.count() == rows.select("id").distinct().count() > 0
    assert rows.where(F.col("metadata").isNull()).count() == 0        # merchant/country default (Q3)


def test_site_records_limit_per_category(spark):
    from vitrine.plans.jobs import site_records
    from vitrine.sources.page_fixtures import listing_pages, product_pages
    from vitrine.sources.sites import DEFAULT_SPEC_PATH

    recs = site_records(spark, listing_pages(spark, SF_SMALL), product_pages(spark, SF_SMALL), DEFAULT_SPEC_PATH,
                        limit=3).collect()
    assert len(recs) == 3
    assert [r.external_id for r in sorted(recs, key=lambda r: int(r.external_id))] == ["0", "2", "4"]


def test_site_records_two_sites_one_parse(spark):
    from vitrine.plans.jobs import site_records

    spec = {
        "a": {"source": "src-a", "base_url": "https://a.example", "brand": "Acme", "country": "es",
              "selectors": {"products": ".card", "product_url": "a", "title": "a", "price": ".p"}},
        "b": {"source": "src-b", "base_url": "https://b.example", "brand": "Bolt",
              "selectors": {"products": ".tile", "product_url": "a.go", "title": ".name", "price": ".cost"}},
    }
    listing = spark.createDataFrame([
        (1, "https://a.example/collections/x", "<div class='card'><a href='/products/aa-1'>Alpha one</a>"
                                               "<span class='p'>10,00 EUR</span></div>"),
        (2, "https://b.example/c/y", "<div class='tile'><span class='name'>Beta two</span>"
                                     "<a class='go' href='/products/bb-2'>go</a><b class='cost'>20 USD</b></div>"),
    ], "page_id bigint, url string, html string")
    product = spark.createDataFrame([(11, "https://a.example/products/aa-1",
                                      "<h1 class='product-title'>Alpha One Detail</h1>")],
                                    "page_id bigint, url string, html string")
    rows = {r.site: r for r in site_records(spark, listing, product, spec).collect()}
    assert rows["a"].source == "src-a" and rows["a"].country == "es" and rows["a"].has_detail
    assert rows["a"].title == "Alpha One Detail" and rows["a"].price == "10,00 EUR"
    assert rows["b"].source == "src-b" and rows["b"].country == "eu" and not rows["b"].has_detail
    assert rows["b"].title == "Beta two" and rows["b"].price == "20 USD"
    assert rows["b"].product_url == "https://b.example/products/bb-2"


def test_delete_keys_ignore_null_parts(spark):
    from vitrine.operators.merge import delete_keys, deleted_count

    cat = spark.createDataFrame([("s", "u1"), ("s", "u2"), ("t", "u1")], "source string, product_url string")
    keys = spark.createDataFrame([("s", "u1"), (None, "u2"), ("t", None)], "source string, product_url string")
    assert sorted(tuple(r) for r in delete_keys(cat, keys).collect()) == [("s", "u2"), ("t", "u1")]
    assert deleted_count(cat, keys).first().deleted == 1


def test_read_older_versions_and_scan_source(spark, scratch):
    t = CatalogTable(spark, f"{scratch}/catalog")
    inc = incoming(spark, SF_SMALL).where(F.col("reject_reason").isNull())
    one = sorted(r.source for r in inc.select("source").distinct().collect())[0]
    upsert(t, inc.where(F.col("source") == one), 1, "2024-06-01 00:00:00")
    upsert(t, inc, 2, "2024-06-02 00:00:00")
    assert t.read(1).count() == inc.where(F.col("source") == one).count()
    assert t.read(2).count() == t.read().count() == inc.count()
    scan = t.scan_source(one)
    assert scan.count() == scan.select("product_url").distinct().count() == inc.where(F.col("source") == one).count()
    assert scan.where(F.col("source") != one).count() == 0


# ---- rows must not be lost: rejects, unnamed sources, retries, shared versions ----
def _raw(rows):
    return [dict(dict(source="a", product_url=None, image_url=None, title=None, price="10 EUR", category=None), **r) for r in rows]


_RAW = "source string, product_url string, image_url string, title string, price string, category string"


def _formatted(spark, rows):
    from vitrine.operators.records import format_products
    return format_products(spark.createDataFrame(_raw(rows), _RAW))


def test_rejected_copy_does_not_replace_an_accepted_row(spark, scratch):
    from vitrine.operators.dedupe import keep_first_accepted
    from vitrine.sources.catalog import CatalogTable, upsert

    rows = _formatted(spark, [
        dict(product_url="https://s/p/1", title="one", image_url=None), dict(product_url="https://s/p/1", title="one", image_url="https://s/1.jpg"),
        dict(product_url=None, title="x"), dict(product_url=None, title="y"), dict(source=None, product_url="https://s/p/2", title="z")])
    kept = keep_first_accepted(rows, ["id"], ["product_url"])
    assert kept.where("reject_reason is null").count() == 1 and kept.where("reject_reason is not null").count() == 4
    table = CatalogTable(spark, scratch + "/t")
    upsert(table, kept, 1, "2024-01-01 00:00:00")
    assert [(r.title, r.image_url) for r in table.read().collect()] == [("one", "https://s/1.jpg")]


def test_rows_of_unnamed_sources_are_stored_or_refused(spark, scratch):
    import pytest

    from vitrine.operators.records import accepted
    from vitrine.sources.catalog import CatalogTable, upsert

    rows = _formatted(spark, [dict(source=s, product_url=f"https://{s}/1", title="t", image_url="https://x/i.jpg") for s in ("a", "b")])
    table = CatalogTable(spark, scratch + "/t")
    upsert(table, rows, 1, "2024-01-01 00:00:00", sources=["a", "c"])
    assert sorted(r.source for r in table.read().collect()) == ["a", "b"] and table.sources() == ["a", "b", "c"]
    with pytest.raises(ValueError):
        table.commit(accepted(rows), 2, ["a"])
    assert table.versions() == [1]


def test_page_seen_without_image_is_not_expired(spark, scratch):
    from vitrine.sources.catalog import CatalogTable, upsert

    table = CatalogTable(spark, scratch + "/t")
    full = [dict(product_url=f"https://s/p/{k}", title=f"t{k}", image_url="https://s/i.jpg") for k in (1, 2)]
    upsert(table, _formatted(spark, full), 1, "2024-01-01 00:00:00")
    for run in (2, 3, 4):   # page 1 comes without its image, page 2 not at all
        merged = upsert(table, _formatted(spark, [dict(product_url="https://s/p/1", title="t1")]), run, "2024-01-02 00:00:00")
        assert {r.action for r in merged.collect()} <= {"keep", "delete"}
    assert [(r.product_url, r.last_seen_run, r.image_url) for r in table.read().collect()] == [("https://s/p/1", 4, "https://s/i.jpg")]


def test_absent_optional_field_is_no_endless_update(spark, scratch):
    from vitrine.operators.changes import classify
    from vitrine.sources.catalog import CatalogTable, upsert

    table = CatalogTable(spark, scratch + "/t")
    row = dict(product_url="https://s/p/1", title="t", image_url="https://s/i.jpg")
    upsert(table, _formatted(spark, [dict(row, category="bags")]), 1, "2024-01-01 00:00:00")
    for run in (2, 3):
        rows = _formatted(spark, [row])
        assert [r.status for r in classify(rows, table.read()).collect()] == ["unchanged"]
        assert [r.action for r in upsert(table, rows, run, "2024-01-02 00:00:00").collect()] == ["touch"]
    assert [r.category for r in table.read().collect()] == ["bags"]


def test_missing_vectors_are_flagged_again(spark, scratch):
    from vitrine.operators.changes import classify
    from vitrine.sources.catalog import CatalogTable, upsert

    table = CatalogTable(spark, scratch + "/t")
    rows = _formatted(spark, [dict(product_url="https://s/p/1", title="t", image_url="https://s/i.jpg")])
    upsert(table, rows, 1, "2024-01-01 00:00:00")
    r = classify(rows, table.read(), retry_missing=True).collect()[0]
    assert (r.status, r.embed_image, r.embed_text) == ("unchanged", True, True)
    from pyspark.sql import functions as F
    vec = F.array(F.lit(1.0).cast("float"))
    upsert(table, rows.withColumn("image_embedding", vec).withColumn("info_embedding", vec), 2, "2024-01-02 00:00:00")
    r = classify(rows, table.read(), retry_missing=True).collect()[0]
    assert (r.status, r.embed_image, r.embed_text) == ("unchanged", False, False)


def test_streams_do_not_share_versions(spark, scratch):
    from vitrine.sources.catalog import CatalogTable, upsert

    table = CatalogTable(spark, scratch + "/t")
    def put(stream, batch, key):
        v = table.reserve(stream, batch)
        upsert(table, _formatted(spark, [dict(product_url=f"https://s/p/{key}", title=key, image_url="https://s/i.jpg")]), v,
               "2024-01-01 00:00:00", expire=False)
        return v
    assert [put("one", 0, "u1"), put("one", 1, "u2"), put("two", 0, "fresh"), put("one", 1, "u2")] == [1, 2, 3, 2]
    assert put("two", 1, "more") == 4 and table.next_free() == 5
    assert sorted(r.title for r in table.read().collect()) == ["fresh", "more", "u1", "u2"]


def test_brandless_site_keeps_its_images(spark):
    from pyspark.sql import functions as F

    from vitrine.functions.images import product_image
    df = spark.createDataFrame([("https://cdn.example.com/some/long/path/red.jpg", "Red shoe")], "src string, alt string")
    got = df.select(product_image(F.col("src"), F.col("alt"), F.lit(""), "").alias("a"),
                    product_image(F.col("src"), F.col("alt"), F.lit(""), "Shoe").alias("b")).collect()[0]
    assert got.a and not got.b


def test_catalog_run_writes_rejects_and_log(spark, scratch):
    from vitrine.plans.jobs import catalog_run
    from vitrine.sources.catalog import CatalogTable
    from vitrine.sources.page_fixtures import product_pages

    pages = product_pages(spark, "/root/testdata/sf0.001")
    table = CatalogTable(spark, scratch + "/t")
    for run in (1, 2):
        _, summary = catalog_run(spark, pages, table, run, "2024-01-01 00:00:00", dim=4, dead_letter=scratch + "/dead",
                                 run_log=scratch + "/log")
    last = summary.first()
    assert (last.new_count, last.updated_count) == (0, 0) and last.unchanged_count > 0
    dead = spark.read.json(f"{scratch}/dead/run=000002")
    assert dead.count() == last.failed_count > 0 and dead.where("reject_reason is null").count() == 0
    log = {r.run: r for r in spark.read.parquet(scratch + "/log").collect()}
    assert log[1].new_count == last.unchanged_count and log[2].failed_count == last.failed_count


def test_model_errors_reach_the_dead_letters(spark, scratch):
    from vitrine.plans.jobs import catalog_run
    from vitrine.sources.catalog import CatalogTable
    from vitrine.sources.page_fixtures import product_pages

    def model(items):
        if any("_4_" in x for x in items):
            raise RuntimeError("broken image")
        return [[1.0] * 4 for _ in items]

    table = CatalogTable(spark, scratch + "/t")
    pages = product_pages(spark, "/root/testdata/sf0.001").where("page_id < 40 and page_id % 5 = 4")
    catalog_run(spark, pages, table, 1, "2024-01-01 00:00:00", image_fn=model, dim=4, dead_letter=scratch + "/dead")
    dead = {r.product_url: r.reject_reason for r in spark.read.json(f"{scratch}/dead/run=000001").collect()}
    stored = {r.product_url: r.image_embedding for r in table.read().collect()}
    assert set(dead.values()) == {"image_error: RuntimeError: broken image"}
    assert {u for u, v in stored.items() if v is None} == set(dead) and len(stored) == 8 and len(dead) == 1
