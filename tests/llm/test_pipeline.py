from __future__ import annotations

import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from tests.llm import test_exact_dedup, test_ngram_join, test_packing, test_suffix_dedup
from tests.llm.helpers import docs

import __spark_entry__ as entry
import corpus_pipeline as C
from vitrine.llm import suffix_dedup


def fixture():
    rng = random.Random(8)
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"], t["lang"], t["source"], strict=True))

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    passage = prose(60)
    clean = [(1_000 + k, prose(150), None, "src1") for k in range(30)]
    rows += clean
    rows += [(2_000 + k, text, None, "src2") for k, (_, text, _, _) in enumerate(clean[:10])]             # exact copies
    rows += [(3_000 + k, text + " " + prose(3), None, "src3") for k, (_, text, _, _) in enumerate(clean[10:20])]  # near copies
    rows += [(4_000 + k, prose(80) + " " + passage + " " + prose(80), None, "src4") for k in range(10)]   # a shared passage
    rows += [(5_000, None, None, None), (5_001, "too short", None, "x"), (5_002, "again and again " * 40, None, "x")]
    return rows


def test_stages_against_brute_force(spark):
    df = docs(spark, fixture())
    columns, inputs = df.columns, {}
    for name, stage in C.STAGES:
        inputs[name] = [(r.doc_id, r.text) for r in df.collect()]
        out = stage(spark, df, "/nowhere")
        if name != "best-fit packing":
            assert out.columns == columns
        rows = out.collect()
        got = Counter((r.doc_id, r.text) for r in rows) if name != "best-fit packing" else None
        before = inputs[name]
        ids = {i for i, _ in got} if got else None
        if name == "quality rules":
            assert {1_000 + k for k in range(30)} | {4_000 + k for k in range(10)} <= ids
            assert not {5_000, 5_001, 5_002} & ids
        if name == "exact dedup":
            want = Counter({(i, t): 1 for (i, t), b in zip(before, test_exact_dedup.brute(before), strict=True) if b[3]})
            assert got == want and not {2_000 + k for k in range(10)} & ids
        if name == "n-gram Jaccard join":
            smallest = {i: c for i, _, c in test_ngram_join.brute(before, 5, 80)}
            assert got == Counter((i, t) for i, t in before if smallest[i] == i) and not {3_000 + k for k in range(10)} & ids
        if name == "suffix-array dedup":
            want = test_suffix_dedup.brute(before)
            assert got == Counter((k[0], k[4].decode("utf-8", "ignore")) for k in want.elements())
            assert all(r.n_chars == len(r.text) and r.kept == 7 for r in rows)
        if name == "best-fit packing":
            test_packing.check_packed(rows, before, 1024)
        df = out if name == "best-fit packing" else spark.createDataFrame(rows, df.schema)


def test_registered_and_run(spark):
    assert entry.queries()["pipeline"] is C.run and C.ORACLE_SQL is None
    out = C.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize("stage", range(5))
def test_empty(spark, stage):
    assert C.STAGES[stage][1](spark, docs(spark, []), "/nowhere").count() == 0


def test_a_passage_of_many_documents_is_not_dealt_by_windows(spark, monkeypatch):
    """The edges of a passage in 300 contexts are cut by second anchors, inside a task."""
    monkeypatch.delattr(suffix_dedup, "_redealt")
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(k, "".join(rng.choice("ijklmnop ") for _ in range(70)) + passage + "".join(rng.choice("ijklmnop ") for _ in range(70))) for k in range(300)]
    got = Counter((r.doc_id, r.text) for r in dict(C.STAGES)["suffix-array dedup"](spark, docs(spark, rows), "/nowhere").collect())
    assert got == Counter((k[0], k[4].decode()) for k in test_suffix_dedup.brute(rows).elements())
