from __future__ import annotations

import random
import re

import pytest
import xxhash
from tests.llm.helpers import docs, texts_of

from vitrine.llm import simhash as S
from vitrine.llm.common import join_hot


def brute(rows, n=3, radius=2):
    fps = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fp:016x}", least.get(find(i))) for i, ((d, _), fp) in enumerate(zip(rows, fps, strict=True))), key=repr)


def fixture():
    rng = random.Random(3)
    rows = texts_of("sf0.001")
    at = 7_000
    for size in (1, 2, 3, 4, 40, 300, 900):
        base = [f"W{rng.randrange(10 ** 6)}" for _ in range(size)]
        for edits in (0, 0, 1, 2, 4):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(size)] = f"x{rng.randrange(10 ** 6)}"
            rows.append((at, " \t".join(w)))
            at += 1
    return rows + [(9_001, None), (9_002, ""), (9_003, " \n"), (9_004, "É b"), (9_005, "é b"), (9_006, "A b c"), (9_006, "a B c"), (None, "a b c"),
                   (None, "lonely"), (9_007, "word " * 200_000), (9_008, "x" * 300_000)]


def found(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rows = fixture()
    want = brute(rows)
    assert found(S.components(docs(spark, rows))) == want
    assert len({c for _, _, c in want}) < len(rows) - 20


@pytest.mark.parametrize("n,radius", [(2, 0), (3, 3), (1, 4)])
def test_other_parameters(spark, n, radius):
    rows = fixture()[120:]
    assert found(S.components(docs(spark, rows), n=n, radius=radius)) == brute(rows, n, radius)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_planted_fingerprints_link(spark, radius):
    rng = random.Random(radius)
    fps = set()
    for _ in range(60):
        fp = rng.getrandbits(64)
        for _ in range(5):
            fps.add(fp - (1 << 64) if fp >> 63 else fp)
            for b in rng.sample(range(64), rng.randint(1, radius + 1)):
                fp ^= 1 << b
    fps = sorted(fps)
    links = S.near_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long"), radius).collect()

    def groups(edges):
        parent = {x: x for x in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        out = {}
        for x in fps:
            out.setdefault(find(x), []).append(x)
        return sorted(out.values())

    def far(a, b):
        return ((a ^ b) % 2**64).bit_count()

    assert all(far(r.a, r.b) <= radius for r in links)
    assert groups([(r.a, r.b) for r in links]) == groups([(a, b) for a in fps for b in fps if a < b and far(a, b) <= radius])


def test_blocks_of_a_long_text(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5_000))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "BLOCK", 64)
    assert S.fingerprint(text) == whole


def test_hot_key_join(spark):
    rows = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(300)], "doc_id long, fp long").cache()
    mapping = rows.groupBy("fp").count().selectExpr("fp", "count AS n", "fp * 10 AS c")
    got = sorted((r.doc_id, r.fp, r.c) for r in join_hot(rows, mapping, "fp", "n").collect())
    assert got == [(i, 1 if i % 3 else i, 10 if i % 3 else 10 * i) for i in range(300)]


def test_empty(spark):
    assert S.components(docs(spark, [])).count() == 0
