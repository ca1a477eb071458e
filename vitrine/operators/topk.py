"""Sort / limit / top-k (L1-L4).

``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps its
own top n and only those rows reach the final merge. ``row_number() <= n``
per group plans a WindowGroupLimit below the shuffle, so at most n rows per
group and task are exchanged, even for a group that holds a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_n(df: DataFrame, ts_col: str, id_col: str, n: int) -> DataFrame:
    """L1: newest ``n`` rows by ``ts_col`` desc, ``id_col`` desc as tie-break."""
    return df.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).limit(n)


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                    rank_col: str = "rank") -> DataFrame:
    """L2 / L4: first ``n`` rows per group in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
