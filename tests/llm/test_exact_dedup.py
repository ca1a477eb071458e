from __future__ import annotations

import hashlib
import re

import pytest
from tests.llm.helpers import docs, texts_of

from vitrine.llm.exact_dedup import deduplicate, keep_first_copies


def brute(rows):
    groups = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(key, []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[key], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    return out


EDGE = [(901, None), (902, ""), (903, " \n"), (904, "a b"), (905, "ab"), (906, "a  b"), (906, "a  b"), (None, "q r"), (907, "qr"),
        (908, "\u00a0ab"), (None, None), (909, "x" * 200_000), (910, "x" * 100_000 + " " + "x" * 100_000)]


@pytest.mark.parametrize("runs,fan_in", [(1, 2), (5, 2), (8, 8), (30, 3)])
def test_against_brute_force(spark, runs, fan_in):
    rows = texts_of("sf0.001") + EDGE + [(2_000 + i, "copy of it") for i in range(300)]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.digest)
           for r in deduplicate(docs(spark, rows), runs=runs, fan_in=fan_in).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_kept_rows_and_empty(spark):
    df = docs(spark, EDGE)
    out = keep_first_copies(df)
    assert out.columns == df.columns
    want = {(i, t) for (i, t), b in zip(EDGE, brute(EDGE), strict=True) if b[3]}
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert deduplicate(docs(spark, [])).count() == 0
