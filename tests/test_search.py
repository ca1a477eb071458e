"""Vector and token search against brute force on small fixtures."""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import functions as F

from tests.conftest import SF_ORACLE
from vitrine.operators.embed import embed_column, hashed_text_embedding
from vitrine.operators.search import TOKEN_SPLIT, token_search, valid_dim
from vitrine.plans.search_queries import q_ivf_topk, q_label_topk_cosine


def _exact(spark):
    pdf = spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet").toPandas()
    out = {}
    for label, g in pdf.groupby("label"):
        m = np.stack(g["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)))
        c = m.mean(axis=0)
        cos = m @ c / (np.linalg.norm(m, axis=1) * np.linalg.norm(c))
        order = sorted(zip(-np.round(cos, 6), g["vec_id"]))[:10]
        out[label] = [int(v) for _, v in order]
    return out


def test_label_topk_matches_brute_force(spark):
    got = {}
    for r in q_label_topk_cosine(spark, SF_ORACLE).orderBy("label", "rank").collect():
        got.setdefault(r.label, []).append(r.vec_id)
    assert got == _exact(spark)


def _recall(spark, found):
    pdf = spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids = pdf["vec_id"].to_numpy()
    m = np.stack(pdf["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    asked = ids % 20 == 0
    order = np.argsort(-np.round(m[asked] @ m.T, 6), axis=1, kind="stable")[:, :10]
    want = {(int(q), int(i)) for q, row in zip(ids[asked], ids[order], strict=True) for i in row}
    assert len(want) == 10 * asked.sum() > 0
    return len(want & found) / len(want)


def test_registered_ivf_recall_over_all_rows(spark):
    got = q_ivf_topk(spark, SF_ORACLE).collect()
    assert {r.query_id % 20 for r in got} == {0} and max(r["rank"] for r in got) == 10
    assert _recall(spark, {(r.query_id, r.vec_id) for r in got}) >= 0.9


def _top(rows, queries, k):
    """Brute force: {query: [item, ...]} by rounded cosine, then smaller id."""
    m = np.array([v for _, v in rows], dtype=np.float64)
    ids = np.array([i for i, _ in rows])
    order = np.argsort(ids, kind="stable")
    m, ids = m[order] / np.linalg.norm(m[order], axis=1, keepdims=True), ids[order]
    out = {}
    for q, v in queries:
        score = np.round(m @ (np.asarray(v, dtype=np.float64) / np.linalg.norm(v)), 6)
        out[q] = ids[np.argsort(-score, kind="stable")[:k]].tolist()
    return out


def _clustered(rng, n, dim=16, clusters=12):
    centre = rng.normal(size=(clusters, dim)) * 4
    return [(i, (centre[i % clusters] + rng.normal(size=dim) * 0.2).tolist()) for i in range(n)]


def _found(rows):
    out = {}
    for r in rows.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


def test_ivf_index_is_exact_and_skips_lists(spark, scratch, monkeypatch):
    import vitrine.operators.ivf_index as I

    rng = np.random.default_rng(4)
    rows = _clustered(rng, 600)
    bad = [(9_000, None), (9_001, [1.0] * 15), (9_002, [0.0] * 16), (9_003, [float("nan")] * 16), (9_004, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows[:500] + bad, "id long, v array<double>")
    index = I.IvfIndex.build(df, f"{scratch}/ivf", "id", "v", 16, n_lists=24)
    centres = index.centres.copy()
    index.append(spark.createDataFrame(rows[500:], "id long, v array<double>"), "id", "v")   # no refit
    index = I.IvfIndex(spark, f"{scratch}/ivf")
    assert (index.centres == centres).all() and index.lists().agg(F.sum("n")).first()[0] == 600
    queries = rows[::20] + [(9_002, [0.0] * 16)]
    asked = spark.createDataFrame(queries, "id long, v array<double>")
    got, visits = index.search(asked, "id", "v", 7)
    want = _top(rows, queries[:-1], 7)
    assert _found(got) == want and 0 < visits["read"] < 0.5 * visits["all"]
    monkeypatch.setattr(I, "BLOCK_ROWS", 9)                       # lists cut into many blocks
    assert _found(index.search(asked, "id", "v", 7)[0]) == want
    # far from the clusters, and more neighbours than any list holds
    odd = [(i, rng.normal(size=16).tolist()) for i in range(5)]
    assert _found(index.search(spark.createDataFrame(odd, "id long, v array<double>"), "id", "v", 300)[0]) == _top(rows, odd, 300)


def test_ivf_reads_only_the_lists_it_visits(spark, scratch):
    from vitrine.operators.ivf_index import IvfIndex

    df = spark.createDataFrame(_clustered(np.random.default_rng(5), 200), "id long, v array<double>")
    index = IvfIndex.build(df, f"{scratch}/ivf", "id", "v", 16, n_lists=12)
    plan = index.items([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "PushedFilters: [In(list_id, [1,2])]" in plan


def test_ivf_ties_and_equal_vectors(spark, scratch):
    from vitrine.operators.ivf_index import IvfIndex

    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(i, [0.0, float(i)]) for i in range(40, 60)]
    index = IvfIndex.build(spark.createDataFrame(rows, "id long, v array<double>"), f"{scratch}/ivf", "id", "v", 2, n_lists=8)
    queries = [(1, [5.0, 0.0]), (2, [0.0, 1.0])]
    got, _ = index.search(spark.createDataFrame(queries, "id long, v array<double>"), "id", "v", 25)
    assert _found(got) == _top(rows, queries, 25)


def test_ivf_of_no_vectors(spark, scratch):
    from vitrine.operators.ivf_index import IvfIndex

    none = spark.createDataFrame([(1, None)], "id long, v array<double>")
    index = IvfIndex.build(none, f"{scratch}/ivf", "id", "v", 4)
    assert index.search(spark.createDataFrame([(1, [1.0] * 4)], "id long, v array<double>"), "id", "v", 3)[0].count() == 0


def _token_rows(rng, n):
    words = ["Common"] * 30 + ["fre-quent"] * 8 + [f"w{i}" for i in range(40)]
    return [(i * 7, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(n)]


def test_token_store_equals_the_scan_and_skips_slabs(spark, scratch, monkeypatch):
    import random

    import vitrine.operators.token_store as T

    rng = random.Random(2)
    rows = _token_rows(rng, 6_000)
    rows[17] = (17 * 7, "w1 w1 w1 w1 w2 w2 w2 w2 w3 w3 quent")
    rows += [(100_001, None), (100_002, ""), (None, "w1 w2 w3"), (35, "w1 w1"), (-5, "w2 common"), (2**40, "É w3 É")]
    df = spark.createDataFrame(rows, "id long, t string")
    store = T.TokenStore(spark, f"{scratch}/tokens", buckets=5)
    store.append(df.where("id is null or id < 30000"), "id", "t")
    store.append(df.where("id >= 30000"), "id", "t")
    known = df.where("id is not null")
    for query, k in (("w1 w2 w3 quent", 1), ("w1 W2, w3 quent", 9), ("common", 30), ("é missing", 5), ("w5 w6", 10_000), ("missing", 3), ("", 3)):
        got, visits = store.search(query, k)
        want = token_search(known, "id", "t", query, k)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()], query
        if query == "w1 w2 w3 quent":
            assert visits["read"] < visits["all"]
    from vitrine.operators.search import token_index

    index = token_index(known, "id", "t")
    want = index.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    assert sorted(store.frequencies().collect()) == sorted(want.collect())
    assert sorted(map(tuple, store.postings().collect())) == sorted((r.token, r.id, r.tf) for r in index.collect())


def test_token_store_reads_only_the_terms_buckets(spark, scratch):
    from vitrine.operators.token_store import TokenStore

    store = TokenStore(spark, f"{scratch}/tokens", buckets=16)
    store.append(spark.createDataFrame([(i, f"a{i} b") for i in range(100)], "id long, t string"), "id", "t")
    plan = store.blocks(["b"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket") and "EqualTo(token,b)" in plan or "In(token" in plan


def test_token_search_brute_force(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text")
    q = "rein nicht dans"
    got = [(r.doc_id, r.score) for r in token_search(docs, "doc_id", "text", q, 15).collect()]
    terms = set(q.split())
    scored = []
    for r in docs.collect():
        toks = [t for t in regex.split(TOKEN_SPLIT, r.text.lower()) if t]
        hits = [t for t in toks if t in terms]
        if hits:
            scored.append((-len(set(hits)), -len(hits), r.doc_id))
    want = [(d, -s) for s, _, d in sorted(scored)[:15]]
    assert got == want


def test_embedding_stage_only_flagged_rows(spark):
    df = spark.createDataFrame([("a", True), ("b", False), (None, True), ("boom", True)],
                               "u string, flag boolean")

    def fake_model(items):
        if "boom" in items:
            raise RuntimeError("model failure")
        return [[1.0, 0.0, 0.0] for _ in items]

    out = {r.u: r.v for r in embed_column(df.repartition(1), "u", "v", fake_model, 3, "flag").collect()}
    assert out["b"] is None and out[None] is None
    assert out["boom"] is None and out["a"] == [1.0, 0.0, 0.0]    # the failing item alone has no vector
    ok = {r.u: r.v for r in embed_column(df.where("u = 'a'"), "u", "v", fake_model, 3, "flag").collect()}
    assert ok["a"] == [1.0, 0.0, 0.0]


def test_model_built_once_per_task(spark):
    df = spark.range(0, 50, numPartitions=2).selectExpr("cast(id as string) as u", "true as flag")

    def factory():
        import os
        token = float(os.getpid() % 1000)          # stands for an expensive model load
        return lambda items: [[token, 1.0] for _ in items]

    out = embed_column(df, "u", "v", None, 2, "flag", model_factory=factory).collect()
    assert len(out) == 50 and all(r.v is not None and r.v[1] == 1.0 for r in out)


def test_hashed_text_embedding_dim(spark):
    df = spark.createDataFrame([(1, "red knit sweater"), (2, "  ")], "id int, t string")
    out = {r.id: r.v for r in hashed_text_embedding(df, "t", "v", 16).collect()}
    assert len(out[1]) == 16 and abs(sum(x * x for x in out[1]) - 1) < 1e-5 and out[2] is None
    bad = spark.createDataFrame([([1.0, 2.0],)], "e array<float>").select(valid_dim(F.col("e"), 3)).first()[0]
    assert bad is None


def test_embed_flagged_keeps_unflagged_rows_away_from_the_model(spark):
    from vitrine.operators.embed import embed_flagged

    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "u string, flag boolean")

    def model(items):
        assert "b" not in items and "c" not in items
        return [[1.0] for _ in items]

    out = embed_flagged(df, "flag", "v", lambda d: embed_column(d, "u", "v", model, 1))
    got = {r.u: r.v for r in out.collect()}
    assert got == {"a": [1.0], "b": None, "c": None}


def test_one_bad_item_costs_one_vector(spark):
    from vitrine.operators.embed import embed_items

    asked = []

    def model(items):
        asked.append(len(items))
        if "bad" in items:
            raise RuntimeError("no such image")
        return [None if x == "none" else [1.0] * (2 if x == "short" else 3) for x in items]

    rows = [("a",), ("bad",), ("b",), ("none",), ("short",), (" ",), (None,)]
    out = {r.u: (r.v, r.e) for r in embed_column(spark.createDataFrame(rows, "u string").coalesce(1), "u", "v", model, 3, error_col="e").collect()}
    assert out["a"] == out["b"] == ([1.0] * 3, None) and out["bad"] == (None, "RuntimeError: no such image")
    assert out["none"][1] == "the model returned no vector" and out["short"][1] == "the model returned 2 values, not 3"
    assert out[None] == out[" "] == (None, None)
    got = embed_items(model, [f"x{i}" for i in range(63)] + ["bad"], 3)
    assert sum(v is not None for v, _ in got) == 63 and len(asked) <= 2 * 6 + 1
    assert embed_items(lambda items: [[1.0]] * 2, ["p"], 1) == [(None, "ValueError: the model returned 2 results for 1 items")]
