from __future__ import annotations

import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from tests.llm.helpers import docs

from vitrine.llm import quality as Q


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    found = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if found[tuple(words[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def norm(line):
    return re.sub(r"[\x20\x09-\x0D]", "", line).lower()


def removed_words(rows, family):
    """(words that lie in boilerplate lines) of every row, by definition."""
    held = {}
    hosts = {}
    for _, text, _, host in rows:
        hosts.setdefault(host or "", set()).add(text or "")
        for line in {norm(x) for x in (text or "").split("\n") if norm(x)}:
            held.setdefault((host or "", line), set()).add(text or "")
    bad = set()
    for (host, line), texts in held.items():
        largest = max(Counter(family[t] for t in texts).values())
        if (len(texts) >= Q.MIN_DOCS and len(texts) >= Q.MIN_HOST_SHARE * len(hosts[host])
                and largest <= Q.MAX_FAMILY_SHARE * len(texts)):
            bad.add((host, line))
    return [sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (text or "").split("\n") if (host or "", norm(x)) in bad)
            for _, text, _, host in rows]


def fixture():
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"], t["lang"], ["one" if s < "src5" else "two" for s in t["source"]], strict=True))
    prose = "\n".join(" ".join(f"plain{k}and{j}" for j in range(13)) for k in range(8))
    for k in range(60):  # boilerplate in otherwise different documents
        own = " ".join(f"w{k}x{j}" for j in range(40))
        rows.append((10_000 + k, f"Accept all COOKIES now\n{own}\nAll rights  reserved", None, "one"))
        rows.append((11_000 + k, prose, None, "one"))                                     # exact copies
        rows.append((12_000 + k, prose + f"\nnote {k}", None, "one"))                      # near copies
        rows.append((13_000 + k, "Accept all cookies now\n" * 6 + f"only these {k}", None, "one"))  # depleted
    rows += [(20_000, None, None, "one"), (20_001, "", None, None), (20_002, "a b c d e f g h " * 5, None, None),
             (20_003, "x " * 30_000, None, "two"), (20_004, "  \x1c # | <", None, "two"), (None, prose, None, None),
             (20_005, prose, None, "two"), (20_005, prose, None, "two")]
    return rows


@pytest.fixture(scope="module")
def judged(spark):
    return Q.judge(docs(spark, fixture())).collect()


def test_base_statistics(judged):
    want = Counter((i, *base(t)) for i, t, _, _ in fixture())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in judged) == want
    for r in judged:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_line_frequency_against_brute_force(spark, judged):
    rows = fixture()
    stats = Q.base_statistics(docs(spark, rows)).collect()
    by_doc = {(r.doc_id, r.n_words): r.family for r in stats}
    family = {t or "": by_doc[i, base(t)[0]] for i, t, _, _ in rows}
    want = Counter((i, base(t)[0], n) for (i, t, _, _), n in zip(rows, removed_words(rows, family), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed_words) for r in judged) == want


def test_verdicts(judged):
    kept = {r.doc_id: r.kept for r in judged}
    assert all(kept[10_000 + k] and kept[11_000 + k] and kept[12_000 + k] and not kept[13_000 + k] for k in range(60))
    assert not kept[20_000] and not kept[20_001] and not kept[20_002] and kept[20_005]


def test_clean(spark):
    df = docs(spark, fixture())
    out = Q.clean(df)
    assert out.columns == df.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[10_000].text == " ".join(f"w0x{j}" for j in range(40)) and rows[10_000].n_chars == len(rows[10_000].text)
    assert 13_000 not in rows and rows[11_003].text.count("\n") == 7 and rows[11_003].kept == 7


@pytest.mark.parametrize("n_own", [3, 15])
@pytest.mark.parametrize("n_pages", [25, 300])
def test_pages_of_one_long_notice_are_depleted(spark, n_own, n_pages):
    rows = []
    for v in range(10):  # ten notices, so that some have the smallest window of their pages
        notice = " ".join(f"notice{v}word{j}" for j in range(60))
        for k in range(n_pages):
            own = " ".join(f"own{v}p{k}w{j}" for j in range(n_own))
            rows.append((v * 1000 + k, f"{notice}\n{own}", None, f"host{v}"))
    out = Q.judge(docs(spark, rows)).collect()
    assert not any(r.base_failed for r in out)
    assert not any(r.kept or r.n_removed_words != 60 for r in out)


def test_edited_copies_stay(spark):
    """Near copies of one text, each with other words changed."""
    words = [[f"text{k}word{j}" for j in range(n)] for k, n in enumerate((50, 51, 12, 40, 11, 42, 16))]
    rows = []
    for k in range(200):
        copy = [list(line) for line in words]
        for e in range(3):
            line = copy[(k * 7 + e * 3) % 7]
            line[(k * 13 + e * 5) % len(line)] = f"edit{k}e{e}"
        rows.append((k, "\n".join(map(" ".join, copy)), None, "h"))
    out = Q.judge(docs(spark, rows)).collect()
    assert all(r.kept and not r.n_removed_words for r in out)


def test_host_size_does_not_change_verdicts(spark):
    notice = " ".join(f"notice{j}" for j in range(40))
    rows = []
    for host, n_clean in (("small", 200), ("large", 12_000)):
        rows += [(k, " ".join(f"{host}{k}w{j}" for j in range(25)), None, host) for k in range(n_clean)]
        rows += [(20_000 + k, notice + "\n" + " ".join(f"p{k}w{j}" for j in range(25)), None, host) for k in range(Q.MIN_DOCS)]
        rows += [(30_000 + k, f"rare {notice}\n" + " ".join(f"r{k}w{j}" for j in range(25)), None, host) for k in range(Q.MIN_DOCS - 1)]
    out = Q.judge(docs(spark, rows)).collect()
    assert Counter((r.doc_id // 10_000, r.n_removed_words, r.kept) for r in out if r.doc_id >= 20_000) == {
        (2, 40, False): 2 * Q.MIN_DOCS, (3, 0, True): 2 * (Q.MIN_DOCS - 1)}
    assert all(r.kept for r in out if r.doc_id < 20_000)


def test_empty(spark):
    assert Q.judge(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n_own", [1, 5, 7, 12])
@pytest.mark.parametrize("shared", [("head", "foot"), ("head", "foot", "n1", "n2", "n3"), ("head",)])
def test_pages_of_shared_header_and_footer_are_depleted(spark, n_own, shared):
    lines = {name: " ".join(f"{name}{j}" for j in range(30)) for name in shared}
    rows = []
    for k in range(60):
        own = " ".join(f"p{k}w{j}" for j in range(n_own))
        rows.append((k, "\n".join([lines[shared[0]], own, *[lines[s] for s in shared[1:]]]), None, "h"))
    out = Q.judge(docs(spark, rows)).collect()
    assert not any(r.kept for r in out) and all(r.n_removed_words == 30 * len(shared) for r in out)
