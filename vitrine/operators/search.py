"""Vector and token search by full scans (V3, V4, V6); the stored indexes are in
``ivf_index`` and ``token_store``.

Cosine scores are Column expressions (``zip_with`` + ``aggregate``) inside
codegen. Query sets are joined to items on an equi-key (a label), never by a
cross join; top-k per query runs as ``row_number() <= k`` so Spark inserts a
partial WindowGroupLimit below the shuffle.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.topk import top_n_per_group

# Fixed value: token boundary for the text index (letters and digits of any script).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def valid_dim(vec: Column, dim: int) -> Column:
    """V3: keep a vector only when it has ``dim`` entries."""
    return F.when(F.size(vec) == dim, vec)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def mean_vector(vec: Column, dim: int) -> Column:
    """Aggregate: element-wise mean of equal-length vectors (a sum per slot)."""
    return F.array(*[F.avg(vec[i].cast("double")) for i in range(dim)])


def group_centroids(items: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """Per-group mean vector; partial aggregation keeps a hot group cheap."""
    return items.groupBy(key).agg(mean_vector(F.col(vec), dim).alias("centroid"))


def top_k_by_key(items: DataFrame, queries: DataFrame, key: str, item_id: str, vec: str, query_vec: str,
                 k: int) -> DataFrame:
    """V4: per query key, the ``k`` items of that key with the highest cosine.

    ``queries`` has one row per key; the join is an equi-join on ``key``
    (broadcast by AQE when the query side is small). Ties break on ``item_id``.
    """
    j = items.join(queries, key)
    scored = j.select(key, item_id, F.round(cosine(F.col(vec), F.col(query_vec)), 6).alias("score"))
    return top_n_per_group(scored, [key], [F.col("score").desc(), F.col(item_id)], k)


# ------------------------------------------------------------ tokens (V6)

def tokens(text: Column) -> Column:
    """Lower-cased tokens of a text, empty pieces dropped."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


def token_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The inverted table ``(token, doc id, tf)``; one pass, partial aggregation."""
    ex = docs.select(F.col(id_col), F.explode(tokens(F.col(text_col))).alias("token"))
    return ex.groupBy("token", id_col).agg(F.count(F.lit(1)).alias("tf"))


def token_search(docs: DataFrame, id_col: str, text_col: str, query: str, k: int) -> DataFrame:
    """V6: documents ranked by the number of distinct query terms they hold
    (ties: more occurrences, then smaller id). The term filter runs before the
    shuffle, so only matching (doc, term) pairs are exchanged."""
    terms = sorted({t for t in regex.split(TOKEN_SPLIT, query.lower()) if t})
    ex = docs.select(F.col(id_col), F.explode(tokens(F.col(text_col))).alias("token"))
    per_term = ex.where(F.col("token").isin(terms)).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))
    scored = per_term.groupBy(id_col).agg(F.count(F.lit(1)).alias("score"),
                                          F.sum("n").alias("occurrences"))
    return scored.orderBy(F.col("score").desc(), F.col("occurrences").desc(), F.col(id_col)).limit(k)
