from __future__ import annotations

import re
from collections import Counter

from tests.llm.helpers import docs, texts_of

from vitrine.llm import licenses as L


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w = words(text)
    found = [(label, i) for phrase, label in L.PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for _, i in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in found}))


def best_cover(text):
    """Label -> best cover over runs of neighbouring diagonals, by definition."""
    w, best = words(text), {}
    grams = {}
    for p in range(len(w) - L.K + 1):
        grams.setdefault(tuple(w[p:p + L.K]), []).append(p)
    for label, template in L.TEMPLATES:
        t = words(template)
        on = {}
        for q in range(len(t) - L.K + 1):
            for p in grams.get(tuple(t[q:q + L.K]), []):
                on.setdefault(p - q, set()).add(q)
        run, last = set(), None
        for d in sorted(on):
            run = run | on[d] if last is not None and d - last <= max(2, (len(t) - 2) // 4) else set(on[d])
            last = d
            best[label] = max(best.get(label, 0), len(run) / (len(t) - L.K + 1))
    return {k: v for k, v in best.items() if v >= L.MIN_COVER}


EXTRA = [(7_001, None), (7_002, ""), (7_003, "MIT  License, the mit-license; Apache\nLicense"), (7_003, "MIT  License, the mit-license; Apache\nLicense"),
         (None, "GNU General Public License"), (7_004, "word " * 20_000 + "All rights reserved"),
         (7_005, "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the Software), to deal in the Software without restriction"),
         (7_006, "all rights. reserved élicense mité license"), (7_007, "Licensed under CC BY-NC 4.0."), (7_008, "License"),
         (7_009, "Licensed under the Mozilla thing, general public license, and general public license")]


def test_against_brute_force(spark):
    rows = texts_of("sf0.001") + EXTRA
    want = Counter()
    for i, t in rows:
        found = best_cover(t)
        b = base(t)
        labels = ",".join(sorted({*found, *b[4].split(",")} - {""}))
        want[(i, *b, labels, round(max(found.values(), default=0), 9))] += 1
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))
                  for r in L.scan(docs(spark, rows)).collect())
    assert got == want
    by_id = {k[0]: k for k in got}
    assert by_id[7_005][6] == "mit" and by_id[7_007][6] == "cc-by-nc" and by_id[7_004][6] == "all-rights-reserved"


def test_spans_and_empty(spark):
    rows = [(1, "x y z released under the MIT license q"), (2, None)]
    span = L.spans(docs(spark, rows)).collect()
    assert [(r.doc_id, r.label, r.first_word, r.last_word, r.cover) for r in span] == [(1, "mit", 3, 7, 1.0)]
    assert L.scan(docs(spark, [])).count() == 0


def test_edited_notices_are_labelled(spark):
    """Three to six words inserted into the long MIT notice, or lost from it, at
    any place; half a notice and its words out of order are none."""
    notice = next(t for label, t in L.TEMPLATES if label == "mit" and len(t) > 100).split()
    edits, n = [], 0
    for size in range(3, 7):
        for at in range(1, len(notice) - size):
            edits.append((n, " ".join(["before"] * 9 + notice[:at] + [f"new{i}" for i in range(size)] + notice[at:] + ["after"] * 9)))
            edits.append((n + 1, " ".join(notice[:at] + notice[at + size:])))
            n += 2
    other = [(-1, " ".join(notice[:len(notice) // 2])), (-2, " ".join(sorted(notice))), (-3, " ".join(notice[::-1]))]
    got = {r.doc_id: r.labels for r in L.scan(docs(spark, edits + other)).collect()}
    assert [i for i, _ in edits if got[i] != "mit"] == []
    assert [got[i] for i, _ in other] == ["", "", ""]
