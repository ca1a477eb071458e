"""Pages arriving as files are extracted and merged into the catalog in
micro-batches (``readStream`` -> extract -> ``foreachBatch`` merge).

Each micro-batch takes the table's next free version and records it beside the
table under (checkpoint, batch id). A batch replayed after a failure finds its
number again and rewrites the same folders with the same content (exactly-once
result with an at-least-once sink); another stream, a new checkpoint or a
catalog run gets later numbers, so none hides another's rows. Staleness is not
applied per batch.

Repeated pages stop early: the stream keeps, per url, a digest of the page as it
was last delivered (a table in the checkpoint, so it outlives a restart; batches are
compared with it by a join, no Python step per url). A page that is delivered again
unchanged is neither parsed nor merged; it only marks its product as seen, a narrow
row. (Its product is the one it has been merged into before, so an unchanged page
counts as a sighting also where that content was once rejected.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.dedupe import keep_first_accepted
from vitrine.operators.extract import product_records_p2
from vitrine.functions.urls import row_id
from vitrine.operators.records import format_products
from vitrine.sources.catalog import CatalogTable, upsert

PAGE_SCHEMA = "page_id bigint, url string, html string"
FOLD_AFTER = 10   # batches of digests that are folded into one piece


def batch_records(pages: DataFrame, selectors: dict, source: str, brand: str) -> DataFrame:
    recs = product_records_p2(pages, selectors, brand=brand).withColumns({
        "source": F.lit(source), "brand": F.lit(brand), "second_hand": F.lit(False)})
    return keep_first_accepted(format_products(recs), ["id"], ["product_url"])


def _same_urls(url: str = "url") -> Column:
    """Equal for equal urls, missing ones included (a plain join key)."""
    return F.coalesce(F.concat(F.lit("u"), F.col(url)), F.lit("-"))


def _parts(spark: SparkSession) -> int:
    """In how many parts a batch's pages are parsed: a fixed number, for few megabytes of
    pages are still many to parse, and the splits of one large file hold a row group or none."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


class SeenPages:
    """What every url last held, beside the stream's progress in its checkpoint.

        _pages/b=<n>/changed=true|false/   (same, url, digest) of batch n
        _pages/c=<n>/                      all urls up to batch n, in one piece

    A batch reads what lies below its number and writes its own folder whole, so a
    replayed batch finds the same state again. After ``FOLD_AFTER`` batches the
    digests are written once more in one piece, and reads start there."""

    SCHEMA = "same string, url string, digest string"

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark = spark
        self.root = f"{checkpoint.rstrip('/')}/_pages"
        self._Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str, below: int) -> list[int]:
        """Batches below ``below`` whose folder is complete."""
        if not self._fs.exists(self._Path(self.root)):
            return []
        names = [st.getPath().getName() for st in self._fs.listStatus(self._Path(self.root))]
        found = [int(n[2:]) for n in names if n.startswith(f"{kind}=") and self._fs.exists(self._Path(f"{self.root}/{n}/_SUCCESS"))]
        return sorted(n for n in found if n < below)

    def _last(self, below: int) -> tuple[DataFrame | None, list[int]]:
        """(``same, url, digest`` of every url below a batch, batches since the last fold)."""
        folds = self._numbers("c", below)
        later = [n for n in self._numbers("b", below) if not folds or n > folds[-1]]
        parts = [(f"{self.root}/c={folds[-1]}", -1)] if folds else []
        parts += [(path, n) for n in later if self._fs.exists(self._Path(path := f"{self.root}/b={n}/changed=true"))]
        out = None
        for path, n in parts:
            one = self.spark.read.schema(self.SCHEMA).parquet(path).withColumn("n", F.lit(n))
            out = one if out is None else out.unionByName(one)
        if len(parts) > 1:
            out = out.groupBy("same").agg(F.max_by(F.struct("url", "digest"), "n").alias("r")).select("same", "r.url", "r.digest")
        return (None if out is None else out.select("same", "url", "digest")), later

    def batch(self, pages: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """(changed pages, urls that came again as they were) of a batch: a url's pages
        are all changed, or, if they are what the last batch with this url had, none is.
        Only digests are compared; html is dealt once, by url."""
        digest = F.sha2(F.coalesce("html", F.lit("")), 256)
        # pages of a url in order of their ids (none last), each distinct page once
        page = F.struct(F.col("page_id").isNull().alias("none"), "page_id", digest.alias("digest"), F.col("html").isNull().alias("empty"))
        now = pages.groupBy(_same_urls().alias("same")).agg(F.first("url").alias("url"), F.array_sort(F.collect_set(page)).alias("held")).select(
            "same", "url", F.sha2(F.array_join(F.col("held.digest"), ""), 256).alias("digest"))
        last, later = self._last(number)
        if last is None:
            now = now.withColumn("changed", F.lit(True))
        else:
            before = last.select("same", F.col("digest").alias("before"))
            now = now.join(before, "same", "left").select("same", "url", "digest", (~F.col("digest").eqNullSafe(F.col("before"))).alias("changed"))
        place = f"{self.root}/b={number}"
        now.write.mode("overwrite").partitionBy("changed").parquet(place)
        found = self.spark.read.schema(f"{self.SCHEMA}, changed boolean").parquet(place)
        if len(later) >= FOLD_AFTER:
            last.write.mode("overwrite").parquet(f"{self.root}/c={number - 1}")
        dealt = pages.select("page_id", "url", "html", _same_urls().alias("same")).repartition(_parts(self.spark), "same")
        changed = dealt.join(found.where("changed").select("same"), "same", "left_semi").dropDuplicates(["same", "page_id", "html"])
        return changed.select("page_id", "url", "html"), found.where("not changed").select("url")


def stream_pages_into_catalog(spark: SparkSession, pages_dir: str, table: CatalogTable, checkpoint: str,
                              selectors: dict, source: str, brand: str, files_per_batch: int = 1,
                              run_ts: str | None = None, skip_unchanged: bool = True):
    """Run the stream until the folder is drained (``availableNow``).
    ``skip_unchanged=False`` parses and merges every delivered page."""
    stream = (spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
              .parquet(pages_dir))
    seen = SeenPages(spark, checkpoint)

    def merge_batch(df: DataFrame, batch_id: int) -> None:
        version = table.reserve(checkpoint, batch_id)
        if not skip_unchanged:
            upsert(table, batch_records(df.repartition(_parts(spark), "page_id"), selectors, source, brand), version, run_ts, expire=False, sources=[source],
                   exact_sources=True)
            return
        changed, unchanged = seen.batch(df, batch_id)
        again = unchanged.select(row_id(F.lit(source), F.col("url")).alias("id"))
        upsert(table, batch_records(changed, selectors, source, brand), version, run_ts, expire=False,
               sources=[source], exact_sources=True, sighted=again.withColumn("source", F.lit(source)))

    q = (stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
