from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq

from vitrine.llm import bitplanes as B

BIG = B.LONG_MAX


def brute(rows, k=16, rounds=3, scale=64):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(Fraction(x) * scale) for x in v]))

    def key(r):
        return (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())

    cent = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(cent))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        cent = [[sum(xs) // len(own[i]) for xs in zip(*own[i], strict=True)] if i in own else c for i, c in enumerate(cent)]
    near = [(vec_id, *nearest(v)) for vec_id, v in kept]
    sums = {}
    for _, d, c in near:
        sums[c] = sums.get(c, 0) + min(d, BIG)
    whole = min(sum(sums.values()), BIG)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted(((i, c, min(d, BIG), min(sums[c], BIG), whole, sha[c]) for i, d, c in near), key=repr)


def table(spark, rows, kind="double"):
    full = [(i, v, 3, "p", 9) for i, v in rows]
    return spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, cluster int, planes string, distance long")


def got(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=repr)


def given():
    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pydict()
    return list(zip(t["vec_id"], t["embedding"], strict=True))


def test_against_brute_force(spark):
    rows = given()
    odd = [0.5] * 63
    rows += [(9_001, None), (9_002, []), (9_003, odd), (9_004, odd + [None]), (9_005, odd + [float("nan")]), (9_006, odd + [float("inf")]),
             (9_007, odd + [0.5, 0.5]), (9_008, [0.0] * 64), (9_008, [0.0] * 64), (9_009, [-1.0] * 64), (None, [0.25] * 64),
             (9_010, [-0.0] * 64), (9_011, [1000.25] * 32 + [-77.7] * 32)]
    assert got(B.cluster(table(spark, rows, "float"))[0]) == brute([(i, v and [x and float(np.float32(x)) for x in v]) for i, v in rows])


def test_exact_beyond_longs(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.choice([0, 3, 12, 40, 300]) for _ in range(64)]) for i in range(60)]
    rows += [(100, [1.7e308] * 64), (101, [-1.7e308] * 64)]
    assert got(B.cluster(table(spark, rows), k=5)[0]) == brute(rows, k=5)


def test_ties_go_to_the_smaller_centroid_and_empty_ones_stay(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(20)]  # two points, sixteen centroids
    out = got(B.cluster(table(spark, rows))[0])
    assert out == brute(rows) and len({r[1] for r in out}) == 2


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = given()[:5]
    assert got(B.cluster(table(spark, rows))[0]) == brute([(i, [float(x) for x in v]) for i, v in rows])
    out, centroids = B.cluster(table(spark, [(1, None)]))
    assert out.count() == 0 and centroids == [] and out.columns[0] == "vec_id"


def test_popcounts_equal_integer_products():
    rng = np.random.default_rng(2)
    for low, high in ((-3, 3), (-64, 64), (-(2**27), 2**27), (0, 1)):
        x, c = rng.integers(low, high, (9, 64)), rng.integers(low, high, (4, 64))
        px, pc = (B.unpacked(*B.planes_of(v)) for v in (x, c))
        assert (B.dots(px, pc) == x @ c.T).all() and (B.squares(px) == (x * x).sum(axis=1)).all()
        words, width = B.planes_of(x.astype(object))
        assert (words == B.planes_of(x)[0]).all() and (width == B.planes_of(x)[1]).all()
        assert B._integers(px[0].view(np.int64).tolist()) == x[0].tolist()
