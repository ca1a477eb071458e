from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tests.llm.helpers import docs, texts_of

from vitrine.llm.bpe_tree import TreeBpe, decode_documents, encode_documents

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "\n", "a", " a", "a ", "\n\n\n", "a  b", "a \n b", "I'll we've 'sx ''s", "x" * 5000, " " * 3000, "ab" * 4000,
       "é" * 700, "日本語" * 500, "a\tb\r\nc d e", "\x01\x1c\x85", "..,,!! ?? " * 300, "<|endoftext|> x",
       "1234567890" * 50, "word, word. word\nword " * 400, "aaaa" * 1000 + "'s" * 500]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text_leaf,piece_leaf", [(2, 2), (7, 3), (64, 16), (8192, 128)])
def test_tree_equals_the_library(reference, text_leaf, piece_leaf):
    tree = TreeBpe(PATH, P.PATTERN, text_leaf, piece_leaf)
    rng = random.Random(7)
    alphabet = ["a", "b", "the", " ", " ", "\n", "'s", "'", "9", ".", "é", "\t", "x", "ing", "  ", "日", " "]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    if text_leaf < 64:
        texts = [t[:600] for t in texts]
    for text, ids in zip(texts, tree.encode_packed(texts), strict=True):
        got = np.frombuffer(ids, "<u4")
        assert got.tolist() == reference.encode_ordinary(text), text[:80]
        assert tree.decode(got) == text.encode()


def test_documents_round_trip(spark, reference):
    rows = texts_of("sf0.001") + [(900_001, None), (900_002, ""), (900_002, ""), (None, "x y")]
    df = docs(spark, rows)
    out = decode_documents(encode_documents(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert len(out) == len(rows)
    assert (sorted((r.doc_id or -1, tuple(np.frombuffer(r.ids, "<u4")), bytes(r.decoded)) for r in out)
            == sorted((i or -1, tuple(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows))


def test_empty_table(spark):
    assert encode_documents(docs(spark, []), PATH, P.PATTERN).count() == 0
