"""Operator 4: exact dedup by a tree-merge of sorted digest runs.

Every document gets a run number from a hash of its id. Level 0 turns each run
into one sorted row per digest: the best document so far and the group's size.
The runs are then merged in binomial rounds. With ``runs = fan_in ** rounds``,
round r joins the ``fan_in`` runs whose numbers differ in digit r only; each of
them keeps the digests whose own digit r names it. So in every round a task
receives ``fan_in`` sorted runs, merges them in one streaming pass, and after
the last round task t holds exactly the digests of slice t, fully merged: no
task ever holds more than its slice, and a group with a third of all rows is
one row per run from level 0 on.

"Verified": rows merge only if digest, length and a second, independent hash of
the normalised text agree. The smallest identifier is kept at every level.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import WS, apart, keyed_text, shuffle_partitions
from vitrine.session import materialize

FAN_IN = 8


def normalised(text: Column) -> Column:
    """The text without its ASCII white space."""
    return F.translate(text, WS, "")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, digest, n_bytes, proof`` of every row (null text is
    empty): one pass, JVM only."""
    t = keyed_text(df, id_col, text_col, empty_for_null=True).withColumn("norm", normalised(F.col("text")))
    return t.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("norm", 256).alias("digest"),
                    F.octet_length("norm").cast("long").alias("n_bytes"), F.xxhash64("norm").alias("proof"))


GROUP = ["digest", "n_bytes", "proof"]
RUN = "run long, digest string, n_bytes long, proof long, n_chars long, keep_id long, n long"


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges equal neighbours of rows sorted by (run, digest, n_bytes, proof,
    best first). Streaming: holds one batch and one open row."""
    schema = pa.schema([("run", pa.int64()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("proof", pa.int64()),
                        ("n_chars", pa.int64()), ("keep_id", pa.int64()), ("n", pa.int64())])
    held = None  # [run, digest, n_bytes, proof, n_chars, keep_id, n]
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None and held[:4] == list(row[:4]):
                held[6] += row[6]
            else:
                if held is not None:
                    out.append(held)
                held = list(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)],
                                             schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(held, schema, strict=True)], schema=schema)


def _sorted_merge(rows: DataFrame, partitions: int) -> DataFrame:
    order = ["run", *GROUP, F.col("n_chars").desc(), F.col("keep_id").asc_nulls_last()]
    return rows.repartition(partitions, "run").sortWithinPartitions(*order).mapInArrow(_merge_sorted, RUN)


def merge_runs(digest_rows: DataFrame, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """Groups of equal digests: ``digest, n_bytes, proof, keep_id, n``. The row
    with the most characters, then the smallest id (null last) stays."""
    rounds, size = 0, 1
    while size < runs:
        rounds, size = rounds + 1, size * fan_in
    # level 0: the sorted run of each run number, combined map-side
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    level = (digest_rows.groupBy("run", *GROUP).agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
             .select("run", *GROUP, (-F.col("best.less")).alias("n_chars"), F.col("best.doc_id").alias("keep_id"), "n"))
    owner = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(size))
    for r in range(rounds):
        step = fan_in ** r
        mine, theirs = F.floor(F.col("run") / step) % fan_in, F.floor(owner / step) % fan_in
        level = _sorted_merge(level.withColumn("run", (F.col("run") + (theirs - mine) * step).cast("long")), min(size, runs))
    return level.drop("run", "n_chars")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None,
                fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, digest``.

    Null text counts as empty, so null, empty and blank texts form one group.
    Rows that repeat both the id and the text of the row that stays are all
    ``kept`` (`keep_first_copies` leaves one of them). A null id stays only if
    its group has no other row of that many characters. Empty table: no rows.

    ``runs`` defaults to the number of shuffle partitions.
    """
    runs = runs or shuffle_partitions(df.sparkSession)
    rows = digests(df, id_col, text_col).withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)))
    rows = materialize(rows, "digests")
    groups = materialize(merge_runs(rows, runs, fan_in), "groups")
    # back down: first to each run's digests (one row per run and digest), then
    # to the documents of that run, so a large group joins in `runs` parts
    down = (rows.select("run", *GROUP).distinct().join(groups, GROUP))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    joined = rows.join(down, ["run", *GROUP]).select("doc_id", "keep_id", "n_chars", F.col("n").alias("group_size"), "digest",
                                                      same.alias("kept"))
    return joined


def keep_first_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; of rows that repeat
    an id and its text, one."""
    keep_id, keep_digest, digest = apart(df, "_keep_id", "_keep_digest", "_digest")
    kept = deduplicate(df, id_col, text_col).filter("kept").select(
        F.col("doc_id").alias(keep_id), F.col("digest").alias(keep_digest)).distinct()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.withColumn(digest, F.sha2(normalised(text), 256))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(keep_id)) & (F.col(digest) == F.col(keep_digest))
    return rows.join(kept, same).dropDuplicates([keep_id, digest]).select(*[F.col(f"`{c}`") for c in df.columns])
