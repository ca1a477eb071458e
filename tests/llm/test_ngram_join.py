from __future__ import annotations

import random
import re

import numpy as np
import pytest
from tests.llm.helpers import docs, texts_of

from vitrine.llm import ngram_join as J


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, n=4, percent=85):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holds = {}
    for i, s in enumerate(sets):
        for x in s:
            holds.setdefault(x, []).append(i)
    near = {(a, b) for own in holds.values() for k, a in enumerate(own) for b in own[k + 1:]} if len(rows) < 4000 else set()
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        root = find(i)
        smallest[root] = min((x for x in (smallest.get(root), doc_id) if x is not None), default=None)
    return sorted(((d, len(s), smallest[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def variants(rng, base, copies, edits):
    for _ in range(copies):
        w = base.split()
        for _ in range(edits):
            k = rng.randrange(len(w))
            if rng.random() < 0.4:
                w[k] = f"e{rng.randrange(10 ** 6)}"
            elif rng.random() < 0.5:
                del w[k]
            else:
                w.insert(k, f"i{rng.randrange(10 ** 6)}")
        yield " ".join(w)


def fixture():
    rng = random.Random(5)
    rows = texts_of("sf0.001")
    at = 5_000
    for size in (1, 3, 4, 5, 9, 10, 11, 17, 25, 33, 60, 150, 400, 900):
        base = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(size))
        for edits in {0, 1, 2, max(1, size // 60), max(1, size // 45), max(1, size // 30)}:
            for text in variants(rng, base, 4, edits if size > 1 else 0):
                rows.append((at, text))
                at += 1
    rows += [(9_001, None), (9_002, ""), (9_003, " \n\t"), (9_004, "A b"), (9_005, "a  B"), (9_005, "a  B"), (None, "a b"), (None, "q"),
             (9_006, "x " * 30_000), (9_007, "X " * 20_000)]
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.components(docs(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute(rows)


@pytest.mark.parametrize("n,percent", [(5, 80), (2, 60), (4, 95)])
def test_other_parameters(spark, n, percent):
    rows = fixture()[150:420]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.components(docs(spark, rows), n=n, percent=percent).collect()]
    assert sorted(got, key=repr) == brute(rows, n, percent)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(9)
    for percent in (60, 80, 85, 95):
        for size in (1, 2, 5, 6, 7, 8, 12, 13, 20, 31, 50, 90, 200, 201, 500, 1500):
            for _ in range(25):
                a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
                top = 2 * size * (100 - percent) // (100 + percent)
                lost = int(rng.integers(0, top + 1))
                new = top - lost
                b = np.unique(np.concatenate([a[min(lost, size - 1):], rng.integers(0, 2**64, new, dtype=np.uint64)]))
                if J.linked(a, b, percent) and len(np.setxor1d(a, b)):
                    band = J.band_of(max(len(a), len(b)))  # both sign there
                    both = np.intersect1d(J.signatures(a, percent), J.signatures(b, percent))
                    assert (both % np.uint64(J.BANDS) == band).sum() > J.band_plan(band, percent)[5], (percent, size, lost, new)


def test_empty(spark):
    assert J.components(docs(spark, [])).count() == 0


def test_sets_that_quote_one_passage(spark):
    """Different documents with one passage in common have no signature left
    once their most frequent ones go; copies with edits still link."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(360)) + " " + passage) for i in range(200)]
    rows += [(1_000 + i, t) for i, t in enumerate(variants(rng, rows[7][1], 5, 6))]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.components(docs(spark, rows), n=5, percent=80).collect()]
    assert sorted(got, key=repr) == brute(rows, 5, 80)


def test_steps_leave_no_files_behind(spark):
    """What only a later step reads goes once that step is written; the sets, links and classes stay."""
    import os

    from vitrine.session import checkpoint_dir

    def names():
        return {n for n in os.listdir(checkpoint_dir(spark)) if n.rsplit("-", 1)[0] in ("live", "shared", "lists", "members", "texts", "tested", "pairs", "close",
                                                                                           "mixed", "found")}

    before, rows = names(), fixture()[-40:]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.components(docs(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute(rows)
    assert names() == before


@pytest.mark.parametrize("percent", [85, 80])
def test_sketches_pass_every_link(spark, percent):
    rng = np.random.default_rng(8)
    rows = []
    for size in [1, 3, 8, 40, 120, 400, 900, 2500]:
        for _ in range(6):
            union = J._mix(rng.integers(0, 2 ** 63, size, dtype=np.uint64))
            out = (size * (100 - percent)) // 100      # the fewest common elements that still link
            cut = rng.permutation(size)[:out]
            of_a = rng.random(out) < rng.random()
            a, b = (np.unique(np.delete(union, cut[which])) for which in (of_a, ~of_a))
            if len(a) and len(b):
                assert J.linked(a, b, percent)
                bands = {int(x) % J.BANDS for x in set(J.signatures(a, percent)) & set(J.signatures(b, percent))} or {0, J.BANDS - 1}
                rows += [(band, len(a), len(b), J.sketch(a).tolist(), J.sketch(b).tolist()) for band in bands]
    pairs = spark.createDataFrame(rows, "band int, n_a long, n_b long, whole_a array<long>, whole_b array<long>")
    for x in "ab":
        pairs = pairs.withColumn(f"bits_{x}", J._folded(J.F.col(f"whole_{x}"), J.F.col("band"), percent))
    assert pairs.filter(~J._may_link(percent)).count() == 0 and {len(r.bits_a) for r in pairs.collect()} == {4, 8, 16}


def test_pairs_of_edited_copies_that_cannot_link_are_not_made(spark, monkeypatch):
    rng = random.Random(31)
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(i, t) for i, t in enumerate(variants(rng, base, 60, 12))]
    made, close = [], J._close
    monkeypatch.setattr(J, "_close", lambda pairs, *a: (made.append(pairs.count()), close(pairs, *a))[1])
    got = sorted((tuple(r) for r in J.components(docs(spark, rows)).collect()), key=repr)
    assert got == brute(rows) and sum(made) < 60


def test_sets_beyond_sketches_are_counted_on_signatures(spark, monkeypatch):
    monkeypatch.setattr(J, "_beyond", lambda percent: 40)
    rng = random.Random(32)
    rows = []
    for size in (30, 60, 300, 2600):
        base = " ".join(f"s{size}w{i}" for i in range(size))
        rows += [(len(rows) + i, t) for i, t in enumerate([base, *variants(rng, base, 3, max(1, size // 100)), *variants(rng, base, 3, size // 12)])]
    got = sorted((tuple(r) for r in J.components(docs(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_lists_of_large_sets_travel_for_few_pairs_at_a_time(spark, monkeypatch):
    """Many large sets that share a passage make many pairs; lists go out in a part for every ``PAIRS`` of them a row."""
    monkeypatch.setattr(J, "_beyond", lambda percent: 40)
    monkeypatch.setattr(J, "PAIRS", 1)
    monkeypatch.setattr(J, "_may_link", lambda percent: J.F.lit(True))
    rng = random.Random(33)
    rows = [(i, " ".join([f"p{j}" for j in range(60)] + [f"d{i}w{j}" for j in range(30)])) for i in range(40)]
    rows += [(40 + i, t) for i, t in enumerate(variants(rng, rows[0][1], 3, 2))]
    pairs, sent, close, keep = [], [], J._close, J.written

    def counted(step, name):
        if name.startswith("close"):
            sent.append(name)
        return keep(step, name)

    monkeypatch.setattr(J, "_close", lambda p, *a: (pairs.append(p.count()), close(p, *a))[1])
    monkeypatch.setattr(J, "written", counted)
    got = sorted((tuple(r) for r in J.components(docs(spark, rows)).collect()), key=repr)
    assert got == brute(rows)
    assert max(pairs) > 2 * len(rows) and len(sent) >= sum(-(-n // len(rows)) for n in pairs)


def test_signatures_with_the_same_short_form_lose_no_pair(spark):
    percent, band = 80, 33
    need, size = J.band_plan(band, percent)[5] + 1, J.band_plan(band, percent)[0]
    alike = [(7 << 48) + (i << 7) + band for i in range(need)]        # one short form
    sigs = {1: alike, 2: alike, 3: [x + (1 << 50) for x in alike[1:]] + alike[:1], 4: [(i << 48) + band for i in range(20, 20 + need)]}
    live = spark.createDataFrame([(x, k) for k, own in sigs.items() for x in own], "sig long, set_key long")
    large = spark.createDataFrame([(k,) for k in sigs], "set_key long")
    lists = J._lists(live, large)
    assert dict(lists.dtypes)["sigs"] == "array<smallint>"
    pairs = spark.createDataFrame([(a, b, size, size) for a in sigs for b in sigs if a < b], "a long, b long, low long, high long")
    got = {tuple(r) for r in J._close(pairs, lists, percent, 100, lambda step, name: step).collect()}
    assert size >= J._beyond(percent) and (1, 2) in got and not {(1, 4), (2, 4), (3, 4)} & got
