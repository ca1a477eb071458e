from __future__ import annotations

import zlib

import numpy as np
import pyarrow.parquet as pq
from tests.llm.helpers import docs

from vitrine.llm import language as L


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def labelled(sf):
    t = pq.read_table(f"/root/testdata/{sf}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], t["lang"], t["source"], strict=True))


EDGE = [(90_001, None, "en", None), (90_002, "", "xx", None), (90_003, "123 ... !", "en", None), (90_004, "the of and " * 30_000, None, None),
        (None, "der die und", "de", None), (90_005, "a", None, None), (90_005, "a", None, None)]


def test_held_out_accuracy(spark):
    rows = labelled("sf0.01") + EDGE
    out = L.identify(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r[2] for r in labelled("sf0.01")}
    seen = [r for r in out if r.doc_id in truth and r.held_out]
    assert seen and all(r.held_out == held(r.doc_id) for r in out)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in seen]) > 0.97
    by_id = {r.doc_id: r for r in out}
    for i in (90_001, 90_002, 90_003):
        assert by_id[i].lang_pred == "und" and by_id[i].score == 0 and by_id[i].rejected
    assert by_id[90_004].lang_pred == "en" and by_id[90_005].lang_pred in {"de", "en", "es", "fr"}
    assert all(0 <= r.score <= 1 for r in out)
    accepted = [r for r in seen if not r.rejected]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in accepted]) > 0.985
    # calibration: mean score is close to accuracy
    assert abs(np.mean([r.score for r in seen]) - np.mean([r.lang_pred == truth[r.doc_id] for r in seen])) < 0.05


def test_labels_of_held_out_rows_and_bound_do_not_leak(spark):
    rows = labelled("sf0.001")
    wrong = [(i, t, "zz" if held(i) else x, s) for i, t, x, s in rows]
    model = L.train(L.training_examples(docs(spark, wrong).select("doc_id", "text", "lang"), 20))
    assert "zz" not in model.languages and model.languages == sorted({x for i, _, x, _ in rows if not held(i)})
    few = L.training_examples(docs(spark, rows).select("doc_id", "text", "lang"), 5)
    assert len(few) <= 2 * 5 * 4


def test_nothing_to_learn(spark):
    out = L.identify(docs(spark, [(1, "some text", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]
    assert L.identify(docs(spark, [])).count() == 0


def test_subwords_ignore_case_and_punctuation():
    assert L.subwords("The, CAT").tolist() == L.subwords("the cat").tolist()
    assert len(L.subwords("")) == 0 and len(L.subwords("...")) == 0
