"""Catalog maintenance: merge on id, last-seen update, staleness, delete,
uniqueness report (C4-C8, S6, J3-J5, O3).

The merge is one full-outer join of the stored table and this run's rows on
``id``; every output row carries an ``action`` so one plan yields the
next state, the counters and what has to be written. Plain parquet tables refuse
MERGE/DELETE, so changes are written beside the stored rows and merged on read
(see ``vitrine.sources.catalog``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.changes import CHANGE_FIELDS, KEEP_IF_ABSENT
from vitrine.operators.records import CATALOG_COLUMNS
from vitrine.functions.price import normalize_price
from vitrine.functions.text import same_text

# Fixed value: a product missed for this many runs is removed.
STALE_AFTER_RUNS = 2

ACTIONS = ["insert", "update", "touch", "keep", "delete"]


def is_stale(last_seen_run: Column, current_run: Column | int) -> Column:
    """C5 predicate; a missing ``last_seen_run`` counts as run 0."""
    cur = current_run if isinstance(current_run, Column) else F.lit(current_run)
    return (cur - F.coalesce(last_seen_run, F.lit(0))) >= STALE_AFTER_RUNS


def merge_catalog(stored: DataFrame, incoming: DataFrame, run: int, run_ts: str | None = None,
                  expire: bool = True, marks: bool = False, buckets: int | None = None) -> DataFrame:
    """C6 + C4 + C5 + C7.

    ``stored``: catalog schema B rows. ``incoming``: formatted rows with
    ``reject_reason``; of several rows of an id an accepted one counts, rejected
    rows without an id take no part. A rejected row with a title still marks
    its product as seen (``last_seen_run`` moves, nothing else). Actions: ``insert`` (new id), ``update`` (changed
    fields), ``touch`` (unchanged, only ``last_seen_run`` moves: Q1), ``keep``
    (not seen, or failed this run, not stale), ``delete`` (not seen and stale;
    only when ``expire``, i.e. for a full run, never for a partial batch).

    ``marks`` adds ``write``, what has to be stored of a row: ``row`` (it is new or
    its fields changed), ``seen`` (only ``last_seen_run`` moved), ``gone``, or null.
    ``buckets``: the stored side is dealt by id into so many buckets; the incoming
    rows are dealt alike, so only they are exchanged.
    """
    ts = F.to_timestamp(F.lit(run_ts)) if run_ts else F.current_timestamp()
    s_cols = [c for c in CATALOG_COLUMNS if c in stored.columns]
    i_cols = [c for c in CATALOG_COLUMNS if c in incoming.columns]
    incoming = _one_per_id(incoming.repartition(buckets, "id") if buckets else incoming)
    s = stored.select(*[F.col(c).alias(f"s_{c}") for c in s_cols])
    i = incoming.select(*[F.col(c).alias(f"i_{c}") for c in i_cols], F.col("reject_reason").alias("i_reject"))
    j = s.join(i, F.col("s_id") == F.col("i_id"), "full_outer")

    def sc(c: str) -> Column:
        return F.col(f"s_{c}") if c in s_cols else F.lit(None)

    def ic(c: str) -> Column:
        return F.col(f"i_{c}") if c in i_cols else F.lit(None)

    def txt(prefix: str, c: str) -> Column:
        cols = s_cols if prefix == "s" else i_cols
        if c not in cols:
            return F.lit(None).cast("string")
        col = F.col(f"{prefix}_{c}")
        src = stored if prefix == "s" else incoming
        if src.schema[c].dataType.typeName() == "array":
            col = F.array_join(col, ",")
        return normalize_price(col) if c in ("price", "sale") else col.cast("string")

    seen = F.col("i_id").isNotNull() & F.col("i_reject").isNull()
    titled = F.coalesce(F.trim(ic("title").cast("string")), F.lit("")) != ""
    sighted = F.col("i_id").isNotNull() & (F.col("i_reject").isNull() | titled)
    exists = F.col("s_id").isNotNull()
    same = F.lit(True)
    for c in CHANGE_FIELDS:
        # the merge keeps the stored value of these when this run has none
        kept = txt("i", c).isNull() if c in KEEP_IF_ABSENT else F.lit(False)
        same = same & (kept | same_text(txt("s", c), txt("i", c)))
    action = (F.when(seen & ~exists, F.lit("insert"))
              .when(seen & ~same, F.lit("update"))
              .when(seen, F.lit("touch"))
              .when(F.lit(expire) & exists & ~sighted & is_stale(sc("last_seen_run"), run), F.lit("delete"))
              .when(exists, F.lit("keep")))
    j = j.withColumn("action", action).where(F.col("action").isNotNull())
    take_new = F.col("action").isin("insert", "update")
    image_same = F.coalesce(ic("image_url") == sc("image_url"), F.lit(False))
    out = []
    for c in CATALOG_COLUMNS:
        if c == "last_seen_run":
            v = F.when(sighted, F.lit(run)).otherwise(sc(c))
        elif c == "created_at":
            v = F.coalesce(sc(c), F.when(take_new, ts))
        elif c == "updated_at":
            v = F.when(take_new, ts).otherwise(sc(c))
        elif c == "image_embedding":
            # keep the stored vector unless the image changed
            v = F.when(take_new & ~image_same, ic(c)).otherwise(F.coalesce(sc(c), ic(c)))
        elif c == "info_embedding":
            # a vector that is missing so far may come with an unchanged row
            v = F.when(take_new, F.coalesce(ic(c), sc(c))).otherwise(F.coalesce(sc(c), ic(c)))
        elif c in KEEP_IF_ABSENT:
            v = F.when(take_new, F.coalesce(ic(c), sc(c))).otherwise(sc(c))
        else:
            v = F.when(take_new, ic(c)).otherwise(sc(c))
        out.append(v.cast(_type_of(c)).alias(c))
    if not marks:
        return j.select(*out, "action")
    # a vector that was missing may come with an unchanged row
    filled = F.lit(False)
    for c in ("image_embedding", "info_embedding"):
        filled = filled | (sc(c).isNull() & ic(c).isNotNull())
    write = (F.when(take_new | (F.col("action") == "touch") & filled, F.lit("row"))
             .when(F.col("action") == "delete", F.lit("gone"))
             .when(sighted & ~sc("last_seen_run").eqNullSafe(F.lit(run)), F.lit("seen")))
    return j.select(*out, "action", write.alias("write"))


def _one_per_id(incoming: DataFrame) -> DataFrame:
    """One row per id, an accepted one where there is any."""
    from vitrine.operators.dedupe import keep_first

    flag = F.col("reject_reason").isNotNull().cast("int")
    rows = incoming.where(F.col("id").isNotNull()).withColumn("_rejected", flag)
    return keep_first(rows, ["id"], ["_rejected"]).select(*incoming.columns)


def _type_of(c: str):
    from vitrine.operators.records import CATALOG_SCHEMA
    return CATALOG_SCHEMA[c].dataType


def next_version(merged: DataFrame) -> DataFrame:
    """Rows of the next table version: everything except deletions."""
    return merged.where(F.col("action") != "delete").drop("action")


def stale_rows(catalog: DataFrame, seen: DataFrame, current_run: int) -> DataFrame:
    """C5 + J3/O3: catalog rows not seen this run (anti join) that are stale."""
    return (catalog.join(seen.select("id").distinct(), "id", "left_anti")
            .where(is_stale(F.col("last_seen_run"), current_run)))


def touch_last_seen(catalog: DataFrame, seen: DataFrame, current_run: int) -> DataFrame:
    """C4 + J4: seen rows (semi join) get ``last_seen_run = current_run``; the
    other columns keep their stored values (Q1)."""
    hit = catalog.join(seen.select("id").distinct(), "id", "left_semi")
    return hit.withColumn("last_seen_run", F.lit(current_run).cast("int"))


def delete_keys(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """Remove rows whose ``(source, product_url)`` is in ``keys``.
    Keys with a null part are ignored, as in the reference."""
    k = keys.select("source", "product_url").where(
        F.col("source").isNotNull() & F.col("product_url").isNotNull()).distinct()
    return catalog.join(k, ["source", "product_url"], "left_anti")


def matched_keys(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows that `delete_keys` removes."""
    k = keys.select("source", "product_url").where(
        F.col("source").isNotNull() & F.col("product_url").isNotNull()).distinct()
    return catalog.join(k, ["source", "product_url"], "left_semi")


def deleted_count(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """S6 return value: number of catalog rows matched by the delete keys."""
    k = keys.select("source", "product_url").where(
        F.col("source").isNotNull() & F.col("product_url").isNotNull()).distinct()
    return catalog.join(k, ["source", "product_url"], "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def uniqueness_report(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row."""
    return (catalog.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))
