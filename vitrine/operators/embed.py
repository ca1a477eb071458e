"""Embedding stages (V1, V2), their error channel (F15) and the dimension check (V3).

The model is the caller's: ``embed_fn(list[str]) -> list[list[float] | None]``
runs inside ``mapInPandas`` once per Arrow batch, so it is built once per task
and fed batches (``spark.sql.execution.arrow.maxRecordsPerBatch`` sets the
batch size). Where a batch fails it is asked again in halves, so n items with one
bad one cost about 2 log n more calls and lose only that one, whose reason is a
second output. Only rows the embedding plan flags (C3) are sent to the model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.search import tokens, valid_dim


def embed_items(fn: Callable, items: list[str], dim: int) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each item; one of the two is null."""
    if not items:
        return []
    try:
        got = list(fn(items))
        if len(got) != len(items):
            raise ValueError(f"the model returned {len(got)} results for {len(items)} items")
    except Exception as e:  # noqa: BLE001 - the model is the caller's: any failure is an item's error
        if len(items) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(items) // 2
        return embed_items(fn, items[:half], dim) + embed_items(fn, items[half:], dim)
    out = []
    for v in got:
        if v is None:
            out.append((None, "the model returned no vector"))
        elif len(v) != dim:
            out.append((None, f"the model returned {len(v)} values, not {dim}"))
        else:
            out.append(([float(x) for x in v], None))
    return out


def embed_column(df: DataFrame, input_col: str, output_col: str, embed_fn: Callable | None, dim: int,
                 flag_col: str | None = None, model_factory: Callable[[], Callable] | None = None,
                 error_col: str | None = None) -> DataFrame:
    """V1: add ``output_col`` (array<float>) computed by ``embed_fn`` over
    ``input_col``; rows whose ``flag_col`` is false skip the model (null).
    With ``model_factory`` the model is built once per task (first batch) and
    reused for the task's remaining batches. ``error_col`` adds why an item that
    was asked for has no vector."""
    import pandas as pd

    from pyspark.sql import types as T

    added = [T.StructField(output_col, T.ArrayType(T.FloatType()))]
    if error_col:
        added.append(T.StructField(error_col, T.StringType()))
    names = df.columns

    def run(batches):
        fn = embed_fn
        for pdf in batches:
            if fn is None:
                fn = model_factory()
            todo = pdf[input_col].notna() & (pdf[input_col].astype(str).str.strip() != "")
            if flag_col is not None:
                todo &= pdf[flag_col].fillna(False).astype(bool)
            idx = [i for i, t in enumerate(todo.tolist()) if t]
            vecs, errors = [None] * len(pdf), [None] * len(pdf)
            for i, (v, e) in zip(idx, embed_items(fn, [pdf[input_col].iloc[i] for i in idx], dim), strict=True):
                vecs[i], errors[i] = v, e
            res = pdf[names].copy()
            res[output_col] = pd.Series(vecs, dtype=object, index=res.index)
            if error_col:
                res[error_col] = pd.Series(errors, dtype=object, index=res.index)
            yield res

    return df.mapInPandas(run, T.StructType(list(df.schema.fields) + added))


def hashed_text_embedding(df: DataFrame, text_col: str, output_col: str, dim: int) -> DataFrame:
    """V2 stand-in when no model is given: hashed term counts, L2-normalised,
    with Spark ML (JVM-side). It does not equal a trained model's vectors."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    tok = df.withColumn("_tokens", tokens(F.coalesce(F.col(text_col), F.lit(""))))
    tf = HashingTF(numFeatures=dim, inputCol="_tokens", outputCol="_tf").transform(tok)
    nz = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(tf)
    vec = vector_to_array(F.col("_unit"), "float32")
    blank = F.coalesce(F.trim(F.col(text_col)), F.lit("")) == ""
    return nz.withColumn(output_col, F.when(~blank, valid_dim(vec, dim))).drop("_tokens", "_tf", "_unit")


def embed_flagged(df: DataFrame, flag_col: str, output_col: str, stage) -> DataFrame:
    """Run ``stage(rows) -> rows + output_col`` only on rows whose flag is
    true; the other rows get a null vector. Unchanged products never reach
    the model (C3); the two branches are unioned back."""
    flag = F.coalesce(F.col(flag_col), F.lit(False))
    todo = stage(df.where(flag))
    rest = df.where(~flag).withColumn(output_col, F.lit(None).cast("array<float>"))
    return todo.unionByName(rest, allowMissingColumns=True)
