"""The catalog table's delta files: what is written, what is read, compaction."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from vitrine.operators.merge import merge_catalog
from vitrine.operators.records import format_products
from vitrine.sources import catalog
from vitrine.sources.catalog import CatalogTable, delete_products, upsert

RAW = "source string, product_url string, image_url string, title string, price string, category string"
TS = "2024-01-01 00:00:00"


def formatted(spark, keys, source="a", price="10 EUR"):
    rows = [(source, f"https://s/p/{k}", f"https://s/{k}.jpg", f"title {k}", price, "bags") for k in keys]
    return format_products(spark.createDataFrame(rows, RAW))


def files(root, version, kind):
    out = []
    for folder, _, names in os.walk(f"{root}/rows"):
        if f"/v={2 * version}/k={kind}/" in folder + "/":
            out += [os.path.join(folder, n) for n in names if n.endswith(".parquet")]
    return out


def stored_rows(spark, root, version, kind):
    return sum(spark.read.parquet(f).count() for f in files(root, version, kind))


def state(table, version=None):
    return sorted((r.product_url, r.price, r.last_seen_run) for r in table.read(version).collect())


def test_a_run_writes_only_what_it_changes(spark, scratch):
    t = CatalogTable(spark, scratch + "/t", buckets=4)
    upsert(t, formatted(spark, range(60)), 1, TS)
    assert stored_rows(spark, t.root, 1, "row") == 60 and not files(t.root, 1, "seen")
    wide = sum(map(os.path.getsize, files(t.root, 1, "row")))
    upsert(t, formatted(spark, range(60)), 2, TS)                      # only seen again: no wide row
    assert not files(t.root, 2, "row") and stored_rows(spark, t.root, 2, "seen") == 60
    changed = formatted(spark, range(3), price="11 EUR").unionByName(formatted(spark, range(3, 60)))
    upsert(t, changed, 3, TS)
    assert stored_rows(spark, t.root, 3, "row") == 3 and stored_rows(spark, t.root, 3, "seen") == 57
    assert sum(map(os.path.getsize, files(t.root, 3, "row"))) < wide
    assert state(t) == sorted((f"https://s/p/{k}", "11EUR" if k < 3 else "10EUR", 3) for k in range(60))
    assert state(t, 2) == sorted((f"https://s/p/{k}", "10EUR", 2) for k in range(60))


def test_stale_and_deleted_products_leave_and_return(spark, scratch):
    t = CatalogTable(spark, scratch + "/t", buckets=4)
    upsert(t, formatted(spark, range(10)), 1, TS)
    upsert(t, formatted(spark, range(5)), 2, TS)
    upsert(t, formatted(spark, range(5)), 3, TS)                       # 5..9 missed twice: gone
    assert stored_rows(spark, t.root, 3, "row") == 5 and [r[0][-1] for r in state(t)] == list("01234")
    keys = spark.createDataFrame([("a", "https://s/p/1"), ("a", "nothing"), (None, "https://s/p/2")], "source string, product_url string")
    assert delete_products(t, keys, 4) == 1 and [r[0][-1] for r in state(t)] == list("0234")
    upsert(t, formatted(spark, [1, 7]), 5, TS, expire=False)
    assert [(r[0][-1], r[2]) for r in state(t)] == [("0", 3), ("1", 5), ("2", 3), ("3", 3), ("4", 3), ("7", 5)]
    created = {r.product_url[-1]: r.updated_at for r in t.read().collect()}
    assert set(created) == set("012347")


def test_compaction_keeps_the_rows_and_bounds_the_files(spark, scratch, monkeypatch):
    monkeypatch.setattr(catalog, "COMPACT_AFTER", 3)
    t = CatalogTable(spark, scratch + "/t", buckets=2)
    want = {}
    for run in range(1, 9):
        keys = range(run, run + 6)
        upsert(t, formatted(spark, keys, price=f"{run} EUR"), run, TS, expire=False)
        want |= {k: run for k in keys}
        assert state(t) == sorted((f"https://s/p/{k}", f"{r}EUR", r) for k, r in want.items())
    log = os.listdir(f"{t.root}/_log/source=a")
    assert any(n.startswith("c=") for n in log)
    orders, start = t._entries("a", 10 ** 6)
    assert all(sum(o > s for o in orders) <= 4 for s in start.values())
    past = state(t, 5)
    assert {int(u.rsplit("/", 1)[1]): r for u, _, r in past} == {k: min(k, 5) for k in range(1, 11)}
    # replaying a compacted run, and reading with a new handle, give the same rows
    upsert(t, formatted(spark, range(8, 14), price="8 EUR"), 8, TS, expire=False)
    assert state(CatalogTable(spark, t.root)) == sorted((f"https://s/p/{k}", f"{r}EUR", r) for k, r in want.items())
    assert CatalogTable(spark, t.root, buckets=9).buckets == 2


def test_compaction_folds_touched_buckets_only(spark, scratch):
    t = CatalogTable(spark, scratch + "/t", buckets=4)
    upsert(t, formatted(spark, range(40)), 1, TS)
    one = t.read().withColumn("b", F.pmod(F.hash("id"), F.lit(4))).where("b = 2").first().product_url.rsplit("/", 1)[1]
    for run in (2, 3):
        upsert(t, formatted(spark, [int(one)], price=f"{run} EUR"), run, TS, expire=False)
    assert t.compact("a", 3, after=3) == [2] and t.compact("a", 3, after=3) == []
    folder = f"{t.root}/rows/src=a/v=7/k=row"
    assert [n for n in os.listdir(folder) if n.startswith("b=")] == ["b=2"]
    assert len(state(t)) == 40 and dict((r[0].rsplit("/", 1)[1], r[1]) for r in state(t))[one] == "3EUR"


def test_stored_side_of_the_merge_is_not_exchanged(spark, scratch):
    t = CatalogTable(spark, scratch + "/t", buckets=4)
    for run in (1, 2):
        upsert(t, formatted(spark, range(30)), run, TS)
    merged = merge_catalog(t.read_base(3), formatted(spark, range(40)), 3, TS, buckets=t.buckets)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Bucketed: true" in plan
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0]      # the incoming rows only
    scan = [line for line in plan.splitlines() if "Bucketed: true" in line][0]
    assert "PartitionFilters: [" in scan and "v#" in scan


def test_sources_with_odd_names(spark, scratch):
    t = CatalogTable(spark, scratch + "/it's", buckets=2)
    for s in ("a b/c", "x=1%", "ü'"):
        upsert(t, formatted(spark, range(3), source=s), 1, TS)
    assert t.sources() == sorted(["a b/c", "x=1%", "ü'"]) and t.read().count() == 9
    assert t.scan_source("x=1%").count() == 3 and t.scan_source("none").count() == 0


def test_a_lost_attempt_leaves_nothing(spark, scratch):
    """Files of a run that died before its log entry do not count, and go when it is repeated."""
    t = CatalogTable(spark, scratch + "/t", buckets=2)
    upsert(t, formatted(spark, range(4)), 1, TS)
    dead = merge_catalog(t.read_base(2), formatted(spark, range(100, 104)), 2, TS, marks=True)
    t._append(dead.where("write = 'row'").withColumns({"gone": F.lit(False), "k": F.lit("row")}), 4)
    assert len(state(t)) == 4
    upsert(t, formatted(spark, range(5)), 2, TS)
    assert len(state(t)) == 5
