"""Row choice per key (A4, A5) as aggregates, not windows.

``min_by`` / ``max_by`` over a struct of the row are declarative aggregates:
Spark runs them partially before the shuffle, so a key holding a third of all
rows is collapsed map-side instead of landing whole in one sort task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], fn) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    # The whole row is the tie-break after the explicit order, so the choice is
    # deterministic even when order values repeat.
    ordering = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    picked = df.groupBy(*keys).agg(fn(F.struct(*rest), ordering).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A4: first row per key by ``order``."""
    return _pick(df, keys, order, F.min_by)


def keep_first_accepted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A4 on formatted rows: the first *accepted* row per key, and every
    rejected row beside it (F4 comes before A4, so a rejected copy can neither
    replace an accepted row nor disappear)."""
    # one pass: every rejected row is a key of its own
    own = F.when(F.col("reject_reason").isNull(), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    return keep_first(df.withColumn("_own", own), [*keys, "_own"], order).select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A5: last row per key by ``order``."""
    return _pick(df, keys, order, F.max_by)
