"""Operator 13: SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the
hashes of the text's word shingles (repeats counted). Two fingerprints link
when they differ in at most ``radius`` bits. Walking from one to the other, the
half-way point lies within half the radius of both: every distinct fingerprint
emits all its variants within half the radius (rounded up), and linked
fingerprints meet in a variant.

Equal fingerprints collapse first, so a variant's bucket holds only different
points of one small ball (65 at most for a radius of 2), whatever the number of
copies. All members within the lower half of the radius link with every member,
so the bucket's pairs are one star around the smallest of them, not all pairs:
a bucket of m members emits m - 1. Pairs of two buckets are made distinct and
verified by their differing bits; classes follow by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import join_hot, keyed_text, slices
from vitrine.llm.ngram_join import classes
from vitrine.session import materialize

SEED = 42
BLOCK = 65_536  # hashes of one text held at a time


def shingle_hashes(text: str | None, n: int = 3) -> Iterator[np.ndarray]:
    """XXH64 of the n-word shingles of ``text`` (words: runs other than ASCII
    white space, A-Z taken as a-z, joined by one space), in blocks; of fewer
    words the whole sequence is one shingle, without words there is none."""
    words = text.encode("utf-8").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return
    take = min(n, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[:len(words) - take + 1], ends[take - 1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        some = [digest(joined[a:b], SEED) for a, b in zip(starts[at:at + BLOCK].tolist(), ends[at:at + BLOCK].tolist(), strict=True)]
        yield np.array(some, dtype=np.uint64)


def fingerprint(text: str | None, n: int = 3) -> int:
    """Signed 64-bit fingerprint; 0 for a text without words."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for block in shingle_hashes(text, n):
        ones += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(block)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row (narrow, no shuffle)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [fingerprint(t, n) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return keyed_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _masks(reach: int) -> list[int]:
    """Signed 64-bit masks of at most ``reach`` bits, fewest bits first."""
    flips = [sum(1 << b for b in bits) for k in range(reach + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in flips]


def near_fingerprints(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``a, b`` between different fingerprints of ``fps (fp)`` at ``radius``
    or fewer differing bits; they connect exactly what all such links connect."""
    if not 0 <= radius <= 5:
        raise ValueError(f"radius {radius} is not in 0..5")
    outer, inner = (radius + 1) // 2, radius // 2
    masks = F.expr("array(" + ",".join(f"{m}L" if m != -(1 << 63) else "shiftleft(1L, 63)" for m in _masks(outer)) + ")")
    # the fingerprint is the variant with the mask undone, so only the two travel
    emitted = fps.select("fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")
    near = F.bit_count(F.col("variant").bitwiseXOR(F.col("fp"))) <= inner
    centre = F.min(F.when(near, F.col("fp"))).over(Window.partitionBy("variant"))
    pairs = emitted.select(centre.alias("a"), F.col("fp").alias("b")).filter("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 lowercase hex digits)
    ``, component_id`` (smallest id reachable over links, its own included).

    Null, empty and blank texts have fingerprint zero, which links like any
    other. Repeated rows stay, each with its own result. A null id takes part in
    links but names no component; alone, its component is null. An empty table
    gives no rows; further columns are not read.
    """
    rows = materialize(fingerprints(df, id_col, text_col, n), "fingerprints")
    groups = materialize(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")), "distinct-fingerprints")
    label = classes(near_fingerprints(groups.select("fp"), radius)).select(F.col("node").alias("fp"), "class")
    named = groups.join(label, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    smallest = named.groupBy("class").agg(F.min("first").alias("component_id"))
    member = materialize(named.join(smallest, "class").select("fp", "n", "component_id"), "members")
    found = join_hot(rows, member, "fp", "n")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.coalesce("component_id", "doc_id").alias("component_id"))
