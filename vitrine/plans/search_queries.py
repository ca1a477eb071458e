"""Registered search queries: cosine top-k, stored IVF, stored token index,
text embedding stage, over whole ``embeddings`` and ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitrine.operators.embed import hashed_text_embedding
from vitrine.operators.ivf_index import IvfIndex
from vitrine.operators.search import group_centroids, top_k_by_key, valid_dim
from vitrine.operators.token_store import TokenStore
from vitrine.session import checkpoint_dir
from vitrine.sources.tables import read_table, spread, table_stamp

DIM = 64
TOP_K = 10
IVF_LISTS = 100
QUERY_EVERY = 20                # vec_ids that are queries
SEARCH_QUERY = "rein nicht dans thinnt erreha"
TOKEN_REPORT = 50

_built: dict[tuple, str] = {}   # (application, index, table stamp) -> folder of an index of this session


def _stored(spark, sf_dir, table, name, build) -> str:
    """The folder of an index over a table: built at first, read again by later
    queries of the session as long as the table's files stay the same."""
    key = (spark.sparkContext.applicationId, name, table_stamp(spark, sf_dir, table))
    if key not in _built:
        root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        build(root)
        _built[key] = root
    return _built[key]


def _vectors(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return e.withColumn("embedding", valid_dim(F.col("embedding"), DIM)).where(F.col("embedding").isNotNull())


def q_label_topk_cosine(spark, sf_dir):
    """Per label, the members closest (cosine) to the label's mean vector."""
    v = _vectors(spark, sf_dir)
    cents = group_centroids(v, "label", "embedding", DIM)
    r = top_k_by_key(v, cents, "label", "vec_id", "embedding", "centroid", TOP_K)
    return r.select("label", "vec_id", F.col("score").cast("decimal(10,4)").alias("score"), "rank")


def q_ivf_topk(spark, sf_dir):
    """V5: every ``QUERY_EVERY``th vector against all rows through the stored index."""
    v = _vectors(spark, sf_dir)
    root = _stored(spark, sf_dir, "embeddings", "ivf-index",
                   lambda at: IvfIndex.build(v, at, "vec_id", "embedding", DIM, IVF_LISTS))
    queries = v.where(F.col("vec_id") % QUERY_EVERY == 0)
    r, _ = IvfIndex(spark, root).search(queries, "vec_id", "embedding", TOP_K)
    return r.select("query_id", F.col("item_id").alias("vec_id"), F.col("score").cast("decimal(10,4)").alias("score"), "rank")


def _token_store(spark, sf_dir):
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return TokenStore(spark, _stored(spark, sf_dir, "documents", "token-store",
                                     lambda at: TokenStore(spark, at).append(d, "doc_id", "text")))


def q_token_search(spark, sf_dir):
    """V6: top documents of a query, from the terms' posting blocks."""
    return _token_store(spark, sf_dir).search(SEARCH_QUERY, 20)[0]


def q_token_df(spark, sf_dir):
    """Inverted table report: the most widespread tokens (document frequency)."""
    df = _token_store(spark, sf_dir).frequencies()
    return df.orderBy(F.col("df").desc(), F.col("cf").desc(), "token").limit(TOKEN_REPORT)


def q_text_embedding(spark, sf_dir):
    """V2 stage with the hashed stand-in: a ``DIM``-wide unit vector for every
    non-blank text, null for blank ones (V3 length check applied)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    e = hashed_text_embedding(d, "text", "info_embedding", DIM)
    v = F.col("info_embedding")
    return e.select("doc_id", F.when(v.isNotNull(), F.size(v)).alias("dim"))


QUERIES = {
    "label_topk_cosine": q_label_topk_cosine,
    "ivf_topk": q_ivf_topk,
    "token_search": q_token_search,
    "token_df": q_token_df,
    "text_embedding": q_text_embedding,
}

_CENT = """cent AS (
  SELECT label, list(m ORDER BY i) AS centroid FROM (
    SELECT label, i, avg(CAST(e AS DOUBLE)) AS m FROM (
      SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings
      WHERE len(embedding) = 64) GROUP BY label, i) GROUP BY label)"""
_TOK = "[^\\p{L}\\p{N}]+"
_TERMS = ", ".join(f"'{t}'" for t in sorted(set(SEARCH_QUERY.split())))

ORACLES = {
    "text_embedding": f"""
SELECT doc_id, CASE WHEN coalesce(trim(text), '') <> '' THEN CAST({DIM} AS INTEGER) END AS dim FROM documents""",
    "label_topk_cosine": f"""WITH {_CENT},
scored AS (
  SELECT e.label, e.vec_id,
    list_dot_product(CAST(e.embedding AS DOUBLE[]), c.centroid)
      / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))
         * sqrt(list_dot_product(c.centroid, c.centroid))) AS cos
  FROM embeddings e JOIN cent c ON e.label = c.label WHERE len(e.embedding) = 64)
SELECT label, vec_id, CAST(round(cos, 6) AS DECIMAL(10,4)) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(cos, 6) DESC, vec_id) AS rank FROM scored)
WHERE rank <= {TOP_K}""",
    "ivf_topk": f"""WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0
), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0),
scored AS (
  SELECT q.vec_id AS query_id, i.vec_id, round(list_dot_product(q.e, i.e) / (q.norm * i.norm), 6) AS cos
  FROM u q, u i WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, vec_id, CAST(cos AS DECIMAL(10,4)) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS rank FROM scored)
WHERE rank <= {TOP_K}""",
    "token_search": f"""
SELECT doc_id, count(*) AS score, CAST(sum(n) AS BIGINT) AS occurrences FROM (
  SELECT doc_id, t, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{_TOK}')) AS t FROM documents)
  WHERE t IN ({_TERMS}) GROUP BY doc_id, t)
GROUP BY doc_id ORDER BY score DESC, occurrences DESC, doc_id LIMIT 20""",
    "token_df": f"""
SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (
  SELECT doc_id, t AS token, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{_TOK}')) AS t FROM documents)
  WHERE t <> '' GROUP BY doc_id, t)
GROUP BY token ORDER BY df DESC, cf DESC, token LIMIT {TOKEN_REPORT}""",
}
