"""V6: a stored inverted index with posting blocks.

    blocks/bucket=<b>/   token, slab, first, deltas, tfs, n, max_tf, sum_tf

A token's bucket is a hash of it. Its postings are cut by slabs of 4096 document
ids, so a token that stands in every document is many small blocks, spread over
the tasks, and never one list. A block holds the smallest id, the gaps to the next
ids (16 bits each), the counts, and their number, maximum and sum.

A search reads the terms' buckets only (partition filters), of those only the
terms' blocks (pushed filters), and first only their maxima: a slab's documents can
reach at most (terms with a block there, sum of their largest counts). The slabs
of the best bounds are decoded first; the k-th document found so far then rules
out every slab whose bound is behind it, and only the others are decoded. The
result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.search import TOKEN_SPLIT, tokens

BUCKETS = 32          # default number of folders; part of the index
SLAB_BITS = 12        # ids of a slab; gaps inside one fit 16 bits
FIRST_SLABS = 8       # slabs decoded before the others are judged
SCHEMA = "token string, slab long, first long, deltas binary, tfs binary, n long, max_tf long, sum_tf long, bucket int"


def query_terms(query: str) -> list[str]:
    return sorted({t for t in regex.split(TOKEN_SPLIT, query.lower()) if t})


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tokens) -> (token, doc_id, tf), one row per token of a document."""
    for part in batches:
        if not part.num_rows:
            continue
        lists = part.column(1)
        words = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy())
        width = max(1, len(words.dictionary))
        key, tf = np.unique(row * width + words.indices.to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(key % width)), part.column(0).take(pa.array(key // width)),
                                          pa.array(tf, pa.int64())], names=["token", "doc_id", "tf"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, doc_id) -> blocks; a stream, so only the block at
    hand (4096 ids at most) is held. Rows of one token and document add up."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, whole: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        words = table.column("token").combine_chunks().dictionary_encode()
        code, ids, tf = words.indices.to_numpy(), table.column("doc_id").to_numpy(), table.column("tf").to_numpy()
        slab = ids >> SLAB_BITS
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (slab[1:] != slab[:-1])
        starts = np.flatnonzero(new)
        if not whole:
            keep, starts = starts[-1], starts[:-1]
            rest = table.slice(keep)
            code, ids, tf, slab, new = code[:keep], ids[:keep], tf[:keep], slab[:keep], new[:keep]
        else:
            rest = table.slice(table.num_rows)
        if not len(starts):
            return None, rest
        first_of_doc = new.copy()
        first_of_doc[1:] |= ids[1:] != ids[:-1]
        docs = np.flatnonzero(first_of_doc)
        tf = np.add.reduceat(tf, docs)
        ids, new = ids[docs], new[docs]
        block = np.flatnonzero(new)
        gaps = np.diff(ids, prepend=ids[:1])
        gaps[block] = 0
        ends = np.append(block[1:], len(ids))
        spans = list(zip(block.tolist(), ends.tolist(), strict=True))
        gap_bytes, tf_bytes = gaps.astype("<u2"), np.minimum(tf, 2**32 - 1).astype("<u4")
        out = pa.RecordBatch.from_arrays(
            [words.dictionary.take(pa.array(code[starts])), pa.array(slab[starts]), pa.array(ids[block]),
             pa.array([gap_bytes[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([tf_bytes[a:b].tobytes() for a, b in spans], pa.binary()),
             pa.array(ends - block), pa.array(np.maximum.reduceat(tf, block)), pa.array(np.add.reduceat(tf, block))],
            names=["token", "slab", "first", "deltas", "tfs", "n", "max_tf", "sum_tf"])
        return out, rest

    for part in batches:
        if not part.num_rows:
            continue
        held.append(part)
        if sum(p.num_rows for p in held) >= 50_000:
            out, rest = cut(pa.Table.from_batches(held), whole=False)
            held = rest.combine_chunks().to_batches()
            if out is not None:
                yield out
    if held:
        yield cut(pa.Table.from_batches(held), whole=True)[0]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> (token, doc_id, tf)."""
    for part in batches:
        n = part.column(4).to_numpy()
        if not len(n):
            continue
        gaps = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype="<u2").astype(np.int64)
        tf = np.frombuffer(b"".join(part.column(3).to_pylist()), dtype="<u4").astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        total = np.cumsum(gaps)
        starts = np.cumsum(n) - n
        ids = part.column(1).to_numpy()[row] + total - total[starts][row]
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(ids), pa.array(tf)], names=["token", "doc_id", "tf"])


class TokenStore:
    """One index in one folder, which driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def append(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        """Adds documents; their ids must not be in the index yet. Rows that
        repeat an id within ``docs`` add up; null ids and texts are not indexed."""
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), tokens(F.col(text_col)).alias("words"))
        rows = rows.where(F.col("doc_id").isNotNull() & F.col("words").isNotNull())
        counts = rows.mapInArrow(_counts, "token string, doc_id long, tf long")
        # a slab of a token is one task's; a frequent token's slabs are many tasks'
        dealt = counts.repartition(self._bucket(), F.shiftright("doc_id", SLAB_BITS)).sortWithinPartitions("token", "doc_id")
        blocks = dealt.mapInArrow(_blocks, SCHEMA.rsplit(", ", 1)[0]).withColumn("bucket", self._bucket())
        # sorted by token, so a file's statistics rule out other tokens' pages
        blocks.sortWithinPartitions("bucket", "token").write.mode("append").partitionBy("bucket").parquet(f"{self.root}/blocks")

    def _bucket(self):
        return F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")

    def blocks(self, terms: list[str] | None = None) -> DataFrame:
        """All blocks, or those of some terms (whose buckets alone are read)."""
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/blocks")
        if terms is None:
            return rows
        of = self.spark.createDataFrame([(t,) for t in terms], "token string").select(self._bucket().alias("b")).distinct().collect()
        return rows.where(F.col("bucket").isin([r.b for r in of]) & F.col("token").isin(terms))

    def frequencies(self) -> DataFrame:
        """``token, df, cf``: documents and occurrences, from the blocks' sums."""
        return self.blocks().groupBy("token").agg(F.sum("n").alias("df"), F.sum("sum_tf").alias("cf"))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """``token, doc_id, tf``."""
        return self._decoded(self.blocks(terms))

    @staticmethod
    def _decoded(blocks: DataFrame) -> DataFrame:
        return blocks.select("token", "first", "deltas", "tfs", "n").mapInArrow(_postings, "token string, doc_id long, tf long")

    @staticmethod
    def _best(postings: DataFrame, k: int) -> DataFrame:
        scored = postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("score"), F.sum("tf").alias("occurrences"))
        return scored.orderBy(F.col("score").desc(), F.col("occurrences").desc(), "doc_id").limit(k)

    def search(self, query: str, k: int) -> tuple[DataFrame, dict]:
        """(rows, visits): the ``k`` documents (``doc_id, score, occurrences``) that
        hold most of the distinct query terms (ties: more occurrences, then smaller
        id), and how many slabs there were and were decoded."""
        blocks = self.blocks(query_terms(query))
        term_max = blocks.groupBy("slab", "token").agg(F.max("max_tf").alias("m"))
        bounds = term_max.groupBy("slab").agg(F.count(F.lit(1)).alias("score"), F.sum("m").alias("occurrences"))
        order = [F.col("score").desc(), F.col("occurrences").desc(), F.col("slab")]
        first = [r.slab for r in bounds.orderBy(*order).limit(FIRST_SLABS).collect()]
        visits = {"read": len(first), "all": bounds.count()}
        schema = "doc_id long, score long, occurrences long"
        if not first:
            return self.spark.createDataFrame([], schema), visits
        found = self._best(self._decoded(blocks.where(F.col("slab").isin(first))), k).collect()
        held = self.spark.createDataFrame([tuple(r) for r in found], schema)
        rest = bounds.where(~F.col("slab").isin(first))
        if len(found) == k:
            last = found[-1]
            better = ((F.col("score") > last.score) | (F.col("score") == last.score) & (
                (F.col("occurrences") > last.occurrences) | (F.col("occurrences") == last.occurrences) & (
                    F.shiftleft("slab", SLAB_BITS) < last.doc_id)))
            rest = rest.where(better)
        more = rest.count()
        visits["read"] += more
        if more:
            held = held.unionByName(self._best(self._decoded(blocks.join(rest.select("slab"), "slab", "left_semi")), k))
        return held.orderBy(F.col("score").desc(), F.col("occurrences").desc(), "doc_id").limit(k), visits
