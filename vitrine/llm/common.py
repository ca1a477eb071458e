"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import checkpoint_dir

# ASCII white space of the contracts: space, tab, LF, VT, FF, CR.
WS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, id_col: str, text_col: str, *, empty_for_null: bool = False) -> DataFrame:
    """``(doc_id long, text string)`` of ``df``; every other column is left
    behind, so extra columns with any name cannot clash with an operator's."""
    text = F.col(f"`{text_col}`").cast("string")
    if empty_for_null:
        text = F.coalesce(text, F.lit(""))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))


def apart(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores in front of those that ``df`` has a column of
    (upper and lower case are the same to Spark)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def release_finished(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps whose results are written:
    its cleaner acts on what the driver's collectors find unreachable."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once under the shared checkpoint folder (zstd) and read
    again, and its folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_written(spark: SparkSession, paths: Iterable[str]) -> None:
    """Removes folders that `written` made and nothing reads any more."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so what a step holds of a
    batch's results at one time stays small whatever the batch size is."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def lower_az(text):
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


HOT_KEYS = 64  # a key is hot if it holds at least one 64th of the rows, so at most 64 keys are


def join_hot(rows: DataFrame, mapping: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined to ``mapping``, which has one row for each of their keys
    and the key's number of rows in ``count``. Rows of a hot key stay where they
    are and meet a broadcast of at most ``HOT_KEYS`` mapping rows; only the others
    are dealt by key. Both frames are read twice: pass written ones."""
    total = rows.count()
    hot, cold = mapping.filter(F.col(count) * HOT_KEYS >= total), mapping.filter(F.col(count) * HOT_KEYS < total)
    hot, cold = hot.drop(count), cold.drop(count)
    stay = rows.join(F.broadcast(hot), key)
    dealt = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return stay.unionByName(dealt)
