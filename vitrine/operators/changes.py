"""Change detection against the stored catalog.

Incoming rows (formatted, one per id) are left-joined to the catalog on
``id``. Deduplication already hash-partitioned the incoming side by ``id``,
so only the catalog side is exchanged for the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.price import normalize_price
from vitrine.functions.text import same_text

# Fixed values that must equal the reference's for right results.
CHANGE_FIELDS = ["title", "price", "sale", "image_url", "description", "category", "gender", "size",
                 "additional_images"]
# On an update these keep the stored value when this run has none (Q4), so an
# absent value is no change either; every other column takes the new value.
KEEP_IF_ABSENT = {"affiliate_url", "brand", "description", "category", "gender", "country", "tags", "other",
                  "metadata", "size", "additional_images"}
STATUSES = ["new", "updated", "unchanged", "failed"]


def _as_text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    c = F.col(name)
    if df.schema[name].dataType.typeName() == "array":
        return F.array_join(c, ",")
    return c.cast("string")


def classify(incoming: DataFrame, catalog: DataFrame, retry_missing: bool = False) -> DataFrame:
    """C1 + C2 + C3.

    ``incoming`` carries catalog schema B and ``reject_reason``; ``catalog`` is
    the stored table. Adds ``status``, ``reason``, ``changed_fields``,
    ``image_changed``, ``embed_image``, ``embed_text`` and the stored
    ``old_*`` fields needed downstream. ``retry_missing`` also flags stored
    rows whose vector is missing (its model failed in an earlier run).
    """
    old_cols = [c for c in CHANGE_FIELDS if c in catalog.columns]
    extra = [c for c in ("image_embedding", "info_embedding", "created_at", "last_seen_run")
             if c in catalog.columns]
    old = catalog.select(
        F.col("id").alias("_old_id"),
        *[(normalize_price(_as_text(catalog, c)) if c in ("price", "sale") else _as_text(catalog, c))
          .alias(f"old_{c}") for c in old_cols],
        *[F.col(c).alias(f"old_{c}") for c in extra],
    )
    j = incoming.join(old, F.col("id") == F.col("_old_id"), "left")

    def differs(c: str) -> Column:
        new = _as_text(incoming, c)
        changed = ~same_text(new, F.col(f"old_{c}") if c in old_cols else F.lit(None))
        # the merge keeps the stored value of these when this run has none
        return changed & new.isNotNull() if c in KEEP_IF_ABSENT else changed

    diffs = [F.when(differs(c), F.lit(c)) for c in CHANGE_FIELDS]
    changed = F.filter(F.array(*diffs), lambda x: x.isNotNull())
    exists = F.col("_old_id").isNotNull()
    failed = F.col("reject_reason").isNotNull()
    status = (F.when(failed, F.lit("failed"))
              .when(~exists, F.lit("new"))
              .when(F.size(changed) == 0, F.lit("unchanged"))
              .otherwise(F.lit("updated")))
    img_changed = exists & ~F.coalesce(F.col("image_url") == F.col("old_image_url"), F.lit(False))
    if "old_image_url" not in j.columns:
        img_changed = exists
    out = j.withColumns({
        "status": status,
        "reason": F.col("reject_reason"),
        "changed_fields": F.when(exists & ~failed, changed),
        "image_changed": F.when(~failed, img_changed),
    })
    st = F.col("status")

    def lost(c: str) -> Column:
        if not retry_missing or c not in catalog.columns:
            return F.lit(False)
        return st.isin("updated", "unchanged") & F.col(f"old_{c}").isNull()

    return out.withColumns({
        "embed_image": ((st == "new") | lost("image_embedding")) & F.col("image_url").isNotNull()
        | (st == "updated") & F.col("image_changed"),
        "embed_text": st.isin("new", "updated") | lost("info_embedding"),
    }).drop("_old_id")


def status_counts(classified: DataFrame) -> DataFrame:
    """A2: one row per status (zero rows are filled in), as bigint counts."""
    statuses = classified.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = classified.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(statuses).join(counts, "status", "left")
            .select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def run_summary(classified: DataFrame, run: int, deleted: DataFrame | None = None) -> DataFrame:
    """One row with the run counters, ready to append to a run log."""
    rows = classified.select("status")
    names = list(STATUSES)
    if deleted is not None:
        # One pass over both inputs: deleted rows are tagged, not joined.
        rows = rows.unionByName(deleted.select(F.lit("deleted").alias("status")))
        names.append("deleted")
    aggs = [F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("bigint").alias(f"{s}_count")
            for s in names]
    return rows.agg(*aggs).withColumn("run", F.lit(run).cast("int"))
