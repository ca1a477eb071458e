from __future__ import annotations

import random
import re
import zlib

from tests.llm.helpers import docs, texts_of

from vitrine.llm import spelling as S


def edits(word, letters):
    out = set()
    for i in range(len(word) + 1):
        for c in letters:
            out.add(word[:i] + c + word[i:])
            if i < len(word):
                out.add(word[:i] + c + word[i + 1:])
        if i < len(word):
            out.add(word[:i] + word[i + 1:])
    return out - {word}


def counted(rows, least=6, least_n=5, every=199):
    n = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= least_n}


def brute(n, ratio=5):
    letters = sorted(set("".join(n)))
    near = {}
    long_words = [w for w in n if len(w) > 60]
    for w in n:
        near[w] = {x for x in edits(w, letters) if x in n} if len(w) <= 60 else {x for x in long_words if S.one_edit(w.encode("latin-1"), x.encode("latin-1"))}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def made(rng, size=900):
    """A dense vocabulary: few letters, chains of frequent and rare spellings."""
    n = {}
    while len(n) < size:
        w = "".join(rng.choice("abcqrà") for _ in range(rng.randint(6, 8)))
        n[w] = rng.choice([5, 6, 30, 160, 900])
        for x in rng.sample(sorted(edits(w, "abz")), 4):
            if len(x) >= 6:
                n[x] = rng.choice([5, 25, 26, 125, 5000])
    long = "".join(rng.choice("xyz") for _ in range(400))
    n |= {long: 50, long[:-1]: 10, long[1:]: 5, "k" * 300: 9, "k" * 301: 90, "k" * 255 + "q" * 45: 7, "p" * 47: 5, "p" * 48: 5, "p" * 49: 30}
    return n


def frame(spark, n):
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    from vitrine.session import materialize
    return materialize(df, "vocab")


def test_variants_against_brute_force(spark):
    n = made(random.Random(7))
    want = brute(n)
    assert got(S.variants(frame(spark, n))) == want
    assert sum(r[1] is not None for r in want) > 100 and any(r[1] not in (None, r[2]) for r in want)


def test_small_nodes_blocks_and_parts(spark, monkeypatch):
    n = made(random.Random(8), 400)
    words = frame(spark, n)
    for name, value in (("NODE_WORDS", 20), ("ASKED_WORDS", 15), ("BLOCK", 50)):
        monkeypatch.setattr(S, name, value)
    assert got(S.variants(words)) == brute(n)


def test_whole_corpus_against_brute_force(spark):
    rows = texts_of("sf0.001")
    rows += [(8_000 + i, "Élégante élégante Elegant elegantt " + "m" * 70 + " × " + "m" * 71 + " ab÷cdef") for i in range(40)]
    rows += [(8_001, None), (8_002, ""), (8_003, "a1b2c3 12 ."), (None, "Nobody's nobodys " * 6), (8_004, "same word twices"), (8_004, "same word twices"),
             (8_005, "q" * 200_000 + " " + "drowned " * 50_000)]
    want = brute(counted(rows))
    assert got(S.group_variants(docs(spark, rows))) == want
    assert any(r[1] for r in want)


def test_deleted_letters_are_counted_where_they_land():
    pattern = S.run_pattern(6)
    hits = 0
    for doc_id in range(400):
        text = "Abcdefg abcdefg hijklmno bcdefg"
        have = S.document_words(doc_id, text, pattern, 199)
        want = {w: c for w, c in counted([(doc_id, text)], 1, 1).items()}
        assert {w: c for w, c in have.items() if len(w) >= 6} == {w: c for w, c in want.items() if len(w) >= 6}
        hits += set(have) != {"abcdefg", "hijklmno", "bcdefg"}
    assert hits


def test_empty(spark):
    assert S.group_variants(docs(spark, [])).count() == 0
    assert S.group_variants(docs(spark, [(1, "few words here")])).count() == 0
