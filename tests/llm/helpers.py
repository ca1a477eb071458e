from __future__ import annotations

import pyarrow.parquet as pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, hash string"


def docs(spark, rows):
    """documents-like table of (doc_id, text[, lang[, source]]) with extra
    columns whose names clash with the operators' own."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, None, None)[:4] if len(r) < 4 else r
        full.append((doc_id, text, lang, source, len(text) if text is not None else None, 7, "h"))
    return spark.createDataFrame(full, SCHEMA)


def texts_of(sf, n=None):
    t = pq.read_table(f"/root/testdata/{sf}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))[:n]
