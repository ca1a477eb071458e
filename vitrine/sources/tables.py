"""Readers for the input tables (S1 page source and the other given tables).

Each reader returns a lazy DataFrame over the parquet files; Catalyst prunes
columns and pushes filters into the scan, so callers select only what they
use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def table_stamp(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Name, size and time of every file of a table, as the file system lists
    them; equal stamps mean an unchanged table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy per-row work (HTML parsing, whole-text scans) at least
    one task per core: when the scan yields fewer partitions than the default
    parallelism, hash-partition by ``key``. A large table already has many
    splits and is returned unchanged (no shuffle of the big input)."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target, key)
    return df


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages arrive already fetched as ``(page_id, url, html)``."""
    return spread(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")
