"""Extra columns with the operators' own internal names pass through unchanged."""

from __future__ import annotations

import pytest

from vitrine.llm import exact_dedup, ngram_join, packing, quality, suffix_dedup

NAMES = ["rank", "text_key", "_copy", "_spans", "_place", "_key", "_keep_id", "_keep_digest", "_digest", "_id", "_removed", "_gone", "_rank", "_bucket",
         "_before", "_n", "copy", "spans", "digest", "host", "lines", "family", "kept", "removed", "component_id", "h", "seg", "fp", "COPY_", "a.b"]
LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [(1, LONG), (2, LONG), (3, "other " + LONG[8:]), (4, " ".join(f"x{i}" for i in range(40))), (5, None)]


def table(spark):
    rows = [(i, t, f"src{i % 2}", len(t or ""), *[f"{n}{i}" for n in NAMES]) for i, t in ROWS]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("step", [quality.clean, exact_dedup.keep_first_copies, ngram_join.keep_representatives, suffix_dedup.remove_repeats])
def test_stages(spark, step):
    df = table(spark)
    out = step(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)
    plain = step(df.select("doc_id", "text", "source", "n_chars")).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in rows) == sorted((r.doc_id, r.text, r.n_chars) for r in plain)


def test_pack_documents(spark):
    names = [*NAMES, "sequence_id", "offset"]
    rows = [(i, 0, 300 + i, 7, *[f"{n}{i}" for n in names]) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long, " + ", ".join(f"`{n}` string" for n in names)).cache()
    out = packing.pack_documents(df, 1024).collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in out for n in NAMES)
    plain = packing.pack_documents(df.select("doc_id", "piece", "length", "ids_crc32").cache(), 1024).collect()
    assert sorted((r.doc_id, r.sequence_id, r.offset) for r in out) == sorted((r.doc_id, r.sequence_id, r.offset) for r in plain)
