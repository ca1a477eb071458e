from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.helpers import docs, texts_of
from tokenizers import Tokenizer

from vitrine.llm.token_files import BLOCK_IDS, MAGIC, decode_record, encode_record, encode_texts, read_token_files, write_token_files

PATH = P.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=300),
       st.sampled_from([1, 7, 60, 64, BLOCK_IDS]))
def test_round_trip(values, block_ids):
    ids = np.array(values, dtype=np.uint64)
    assert decode_record(encode_record(ids, block_ids), block_ids).tolist() == values


def test_round_trip_of_runs_and_escapes():
    rng = np.random.default_rng(5)
    for n in (0, 1, 59, 60, 61, 1024, 1025, 5000):
        for top in (1, 2, 50_000, 2**59, 2**60, 2**63):
            ids = rng.integers(0, top, n, dtype=np.uint64)
            assert (decode_record(encode_record(ids)) == ids).all()
    small = encode_record(np.zeros(6000, np.uint64))
    assert len(small) < 6000 / 60 * 8 * 1.2 + 100  # 60 ids a word
    tokens = rng.integers(0, 49_408, 30_000, dtype=np.uint64)
    assert len(encode_record(tokens)) < 30_000 * 2.9
    assert small[:4] == MAGIC
    with pytest.raises(ValueError):
        decode_record(b"nope" + small[4:])


ODD = [(9_001, None), (9_002, ""), (9_003, "it's <|endoftext|> 12,5"), (9_003, "it's"), (None, "A\x1cb \u0130 \u00e9"),
       (-5, "x " * 40_000), (9_004, "e\u0301 \u0301a\u00a0b\u2003c"), (9_005, "\u03a3\u03c3 \u0391\u03a3 \u03c2")]


def test_words_equal_whole_text_encoding():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    texts = [t or "" for _, t in texts_of("sf0.001") + ODD]
    for text, ids in zip(texts, encode_texts(PATH, texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:60]


@pytest.mark.parametrize("shards", [1, 5])
def test_files(spark, scratch, shards):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    rows = texts_of("sf0.001") + ODD
    write_token_files(docs(spark, rows), PATH, scratch + "/files", shards=shards)
    got = read_token_files(spark, scratch + "/files").collect()
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_empty(spark, scratch):
    write_token_files(docs(spark, []), PATH, scratch + "/files")
    assert read_token_files(spark, scratch + "/files").count() == 0
