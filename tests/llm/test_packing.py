from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from tests.llm.helpers import docs, texts_of
from tokenizers import Tokenizer

from vitrine.llm.packing import memo_for, pack_texts, plan_runs

PATH = P.path("byte_bpe_50k.json")


def bins_of(counts, capacity):
    runs, n = plan_runs(counts, capacity)
    bins = {}
    for length, rank, count, sequence, offset in runs.tolist():
        for k in range(count):
            bins.setdefault(sequence + k, []).append((offset, length))
    assert sorted(bins) == list(range(n))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter(x[1] for b in bins.values() for x in b) == Counter(counts)
    for length in counts:  # ranks 0..n-1, each once
        own = sorted((r, c) for x, r, c, _, _ in runs.tolist() if x == length)
        assert [r for r, _ in own] == [sum(c for _, c in own[:i]) for i in range(len(own))]
    return bins


def brute_best_fit(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


def test_plan_against_best_fit_decreasing():
    rng = random.Random(3)
    for capacity in (1, 2, 7, 30, 100):
        for _ in range(30):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 120))]
            bins = bins_of(Counter(lengths), capacity)
            large = [sum(3 * x[1] > capacity for x in b) for b in bins.values()]
            assert max(large) <= 2
            assert len(bins) >= -(-sum(lengths) // capacity)
            assert len(bins) <= brute_best_fit(lengths, capacity) * 1.05 + 1
    assert plan_runs({}, 8)[1] == 0


def test_memo_equals_whole_text_encoding():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    texts = [t for _, t in texts_of("sf0.01")] + ["", " ", "a  b", " x\n\ny ", "\n", "it's <|endoftext|>", "a b c\x1cd", "x" * 500]
    memo, chunker = memo_for(PATH)
    for text, ids in zip(texts, memo.encode([chunker(t) for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_packed(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    want = Counter()
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_documents(spark):
    rows = texts_of("sf0.001") + [(9_001, None), (9_002, ""), (9_003, "a b c"), (9_003, "a b c"), (None, "x y z " * 3000)]
    out = pack_texts(docs(spark, rows), PATH).collect()
    n, total = check_packed(out, rows, 1024)
    assert n <= -(-total // 1024) * 1.03 + 1
    assert check_packed(pack_texts(docs(spark, rows[-9:]), PATH, capacity=5).collect(), rows[-9:], 5)[0] > 1


def test_empty_and_ids(spark):
    assert pack_texts(docs(spark, []), PATH).count() == 0
    r = pack_texts(docs(spark, [(1, "a b")]), PATH, with_ids=True).collect()[0]
    assert np.frombuffer(r.ids, "<u4")[-1] == 2 and r.length == len(r.ids) // 4
