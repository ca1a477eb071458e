"""Micro-batch ingestion (T1) against the batch result; page walk."""

from __future__ import annotations

from tests.conftest import SF_SMALL
from vitrine.sources.catalog import CatalogTable
from vitrine.sources.page_fixtures import product_pages
from vitrine.sources.sites import DEFAULT_SPEC_PATH, load_spec
from vitrine.streaming.incremental import batch_records, stream_pages_into_catalog
from vitrine.streaming import incremental, page_walk
from vitrine.streaming.page_walk import chain_heads, walk, walk_all, walk_starts


def test_stream_equals_batch_and_replays(spark, scratch):
    spec = load_spec(DEFAULT_SPEC_PATH)["shop"]
    pages = product_pages(spark, SF_SMALL)
    pages.repartition(3, "page_id").write.parquet(f"{scratch}/inbox")
    table = CatalogTable(spark, f"{scratch}/catalog")
    stream_pages_into_catalog(spark, f"{scratch}/inbox", table, f"{scratch}/ckpt", spec["selectors"],
                              spec["source"], spec["brand"], run_ts="2024-06-01 00:00:00")
    assert len(table.versions()) == 3
    cols = ["id", "title", "price", "image_url"]
    streamed = sorted(table.read().select(*cols).collect())
    batch = batch_records(pages, spec["selectors"], spec["source"], spec["brand"])
    assert streamed == sorted(batch.where("reject_reason is null").select(*cols).collect())
    # a restarted query with the same checkpoint finds nothing new and changes nothing
    stream_pages_into_catalog(spark, f"{scratch}/inbox", table, f"{scratch}/ckpt", spec["selectors"],
                              spec["source"], spec["brand"], run_ts="2024-06-01 00:00:00")
    assert sorted(table.read().select(*cols).collect()) == streamed


def test_batch_with_many_splits_is_dealt_anew(spark, scratch, monkeypatch):
    """A delivered file may have many splits of which few hold rows: pages are parsed in a fixed number of parts."""
    seen = []
    monkeypatch.setattr(incremental, "upsert", lambda table, rows, *_, **__: seen.append(rows))
    monkeypatch.setattr(incremental, "batch_records",
                        lambda pages, *_: [pages.rdd.getNumPartitions(), pages.rdd.glom().map(len).collect()])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # one file of one row group, read in more splits than there are cores
    spark.range(400).selectExpr("id as page_id", "concat('u', id) as url", "repeat(sha2(string(id), 256), 40) as html").coalesce(1).write.parquet(
        f"{scratch}/inbox")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        stream_pages_into_catalog(spark, f"{scratch}/inbox", CatalogTable(spark, f"{scratch}/catalog"), f"{scratch}/ckpt",
                                  {}, "s", "b", skip_unchanged=False)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (n, sizes), = seen
    assert n == parts and sum(sizes) == 400 and max(sizes) < 400


def test_walk_stops_on_cycles_and_self_links(spark):
    chain = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("s", "s"), ("x", "y"), ("y", None)],
        "url string, next_url string")
    heads = {r.url for r in chain_heads(chain).collect()}
    assert heads == {"s", "x"}
    starts = spark.createDataFrame([("a",), ("s",), ("x",)], "url string")
    got = sorted((r.start, r.url, r.depth) for r in walk(chain, starts).collect())
    assert got == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("s", "s", 0), ("x", "x", 0), ("x", "y", 1)]
    capped = sorted((r.start, r.url) for r in walk(chain, starts, max_pages=2).collect())
    assert ("a", "c") not in capped and ("a", "b") in capped


def test_walk_with_several_pointers_per_page(spark):
    chain = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")],
                                  "url string, next_url string")
    starts = spark.createDataFrame([("a",)], "url string")
    got = sorted((r.url, r.depth) for r in walk(chain, starts).collect())
    assert got == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def _followed(chain, starts, max_pages=None):
    nxt = {a: b for a, b in chain if b is not None and b != a}
    out = []
    for s in starts:
        at, seen = s, {}
        while at is not None and at not in seen and (max_pages is None or len(seen) < max_pages):
            seen[at] = len(seen)
            at = nxt.get(at)
        out += [(s, u, d) for u, d in seen.items()]
    return sorted(out)


def _graph():
    """Chains that merge, cycles with and without a way in, self-links, gaps."""
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(20)] + [("m1", "c10"), ("m2", "m1"), ("end", None), ("self", "self"), ("gap", "nowhere")]
    chain += [(f"p{i}", f"p{(i + 1) % 5}") for i in range(5)]                                    # pure cycle
    chain += [("two1", "two2"), ("two2", "two1")]
    chain += [(f"r{i:02d}", f"r{i + 1:02d}") for i in range(13)] + [("r13", "r06"), ("t1", "r09"), ("t2", "t1")]   # cycle r06..r13
    return chain


def test_walk_by_doubling_against_following(spark):
    chain = _graph()
    df = spark.createDataFrame(chain, "url string, next_url string")
    heads = {r.url for r in walk_starts(df).collect()}
    assert heads == {"c00", "m2", "end", "self", "gap", "r00", "t2", "p0", "two1"}
    assert sorted(map(tuple, walk_all(df).select("start", "url", "depth").collect())) == _followed(chain, heads)
    every = sorted({u for u, _ in chain} | {"nowhere"})
    starts = spark.createDataFrame([(u,) for u in every], "url string")
    for most in (None, 1, 2, 5, 9):
        got = sorted(map(tuple, walk(df, starts, max_pages=most).select("start", "url", "depth").collect()))
        assert got == _followed(chain, every, most), most


def test_walk_rounds_are_logarithmic(spark, monkeypatch):
    rounds = []
    keep = page_walk.materialize
    monkeypatch.setattr(page_walk, "materialize", lambda df, name: rounds.append(name) or keep(df, name))
    chain = [(f"c{i:02d}", f"c{i + 1:02d}" if i < 47 else None) for i in range(48)]
    got = walk_all(spark.createDataFrame(chain, "url string, next_url string"))
    assert sorted(map(tuple, got.collect())) == _followed(chain, ["c00"])
    assert rounds.count("walk-jumps") <= 7


def test_walk_of_no_pages(spark):
    assert walk_all(spark.createDataFrame([], "url string, next_url string")).count() == 0


def test_unchanged_pages_are_not_parsed_again(spark, scratch, monkeypatch):
    """The digests survive a restart; a repeated page only moves last_seen_run."""
    from vitrine.streaming import incremental

    parsed = []
    keep = incremental.batch_records
    monkeypatch.setattr(incremental, "batch_records", lambda pages, *a: parsed.append(sorted(r.page_id for r in pages.collect())) or keep(pages, *a))

    def page(i, price, extra=""):
        return (i, f"https://s/products/p-{i}", f"<h1 class='product-title'>Item {i}</h1><span class='price'>{price} EUR</span>{extra}"
                f"<main><div class='product-gallery'><img src='https://cdn.example.com/files/a_long_name/Red_Knit_{i}.jpg'></div></main>")

    table = CatalogTable(spark, f"{scratch}/catalog", buckets=2)
    waves = [[page(1, 10), page(2, 20), page(3, 30)], [page(1, 10), page(2, 25), page(2, 25)], [page(2, 25), page(1, 10, "<!--x-->")],
             [page(2, 20), page(3, 30)]]
    for rows in waves:
        spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.mode("append").parquet(f"{scratch}/inbox")
        stream_pages_into_catalog(spark, f"{scratch}/inbox", table, f"{scratch}/ckpt", {}, "s", "B", run_ts="2024-06-01 00:00:00")
    assert parsed == [[1, 2, 3], [2], [1], [2]]
    assert sorted((r.product_url[-1], r.price, r.last_seen_run) for r in table.read().collect()) == [
        ("1", "10EUR", 3), ("2", "20EUR", 4), ("3", "30EUR", 4)]
    assert sorted((r.version, r.kind, r.n) for r in table.history().collect()) == [
        (1, "row", 3), (2, "row", 1), (2, "seen", 1), (3, "seen", 2), (4, "row", 1), (4, "seen", 1)]


def test_page_digests_are_joined_and_folded(spark, scratch, monkeypatch):
    """A batch meets the last digest of each url by a join, over missing urls, several
    pages of a url, replays and folded batches; no Python step runs per url."""
    from vitrine.streaming import incremental

    monkeypatch.setattr(incremental, "FOLD_AFTER", 2)
    seen = incremental.SeenPages(spark, f"{scratch}/ckpt")
    a, b, none = (1, "a", "x"), (2, "b", "y"), (None, None, "z")
    waves = [
        ([a, a, b, none], {a, b, none}, []),
        ([a, none], set(), ["a", None]),
        ([(7, "a", "x"), (2, "b", "w")], {(2, "b", "w")}, ["a"]),                  # the id of a page is no content
        ([(1, "a", "x"), (8, "a", "x")], {(1, "a", "x"), (8, "a", "x")}, []),      # now two pages of one url
        ([(8, "a", "x"), (1, "a", "x"), b, (3, "c", None)], {b, (3, "c", None)}, ["a"]),
        ([b, (3, "c", ""), none], set(), ["b", "c", None]),
    ]
    for number, (rows, changed, again) in enumerate(waves):
        for _ in range(2):                                                        # every batch twice, as after a failure
            new, old = seen.batch(spark.createDataFrame(rows, incremental.PAGE_SCHEMA), number)
            got = [tuple(r) for r in new.collect()]
            assert sorted(got, key=repr) == sorted(changed, key=repr), number
            assert sorted((r.url for r in old.collect()), key=repr) == sorted(again, key=repr), number
            plan = new._jdf.queryExecution().toString()
            assert "InPandas" not in plan and "WithState" not in plan
    assert seen._numbers("c", 99) and len(seen._last(6)[1]) <= 3
