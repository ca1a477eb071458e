"""Property tests: the price normaliser on generated strings against a small
Python model of the rule, and idempotence."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.functions.price import normalize_price

_PAIR = re.compile(r"(\d+(?:[.,]\d+)?)[\s ]*([A-Za-z]{2,3})(?![A-Za-z0-9_])")


def model(s: str | None) -> str | None:
    """The X1 rule as plain Python (ASCII inputs): pairs of amount + 2-3
    letter code; comma becomes dot, a trailing .00 goes, codes upper-cased."""
    if s is None:
        return None
    t = s.strip(" \t\n\r\f\v ")
    if not t:
        return None
    pairs = []
    for a, c in _PAIR.findall(t):
        a = a.replace(",", ".")
        if a.endswith(".00"):
            a = a[:-3]
        pairs.append(a + c.upper())
    return ",".join(pairs) if pairs else t


amount = st.builds(lambda i, sep, dec: f"{i}{sep}{dec}" if sep else str(i),
                   st.integers(0, 99999), st.sampled_from(["", ".", ","]), st.sampled_from(["00", "5", "50", "99"]))
code = st.sampled_from(["EUR", "usd", "CZK", "Pln", "EUROS", "X", "GBP"])
gap = st.sampled_from(["", " ", "  ", " "])
item = st.builds(lambda a, g, c: f"{a}{g}{c}", amount, gap, code)
text = st.one_of(
    st.lists(item, min_size=0, max_size=4).map(", ".join),
    st.sampled_from(["", "   ", "price on request", "abc 12"]),
    st.builds(lambda pre, body: pre + body, st.sampled_from(["", " ", "From "]), item),
)


@settings(max_examples=4, deadline=None)
@given(st.lists(text, min_size=50, max_size=80))
def test_normalize_price_matches_model(spark, batch):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(batch)], "i int, s string")
    got = {r.i: (r.p, r.q) for r in df.select("i", normalize_price(F.col("s")).alias("p"),
                                             normalize_price(normalize_price(F.col("s"))).alias("q")).collect()}
    for i, s in enumerate(batch):
        assert got[i][0] == model(s), s
        assert got[i][1] == got[i][0], s          # idempotent


rows_strategy = st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]), st.integers(0, 5),
                                   st.text(alphabet="xyz", min_size=1, max_size=3)), min_size=1, max_size=60)


@settings(max_examples=4, deadline=None)
@given(rows_strategy)
def test_keep_first_last_match_python(spark, rows):
    from vitrine.operators.dedupe import keep_first, keep_last

    df = spark.createDataFrame(rows, "k string, ord int, v string")
    first = {r.k: (r.ord, r.v) for r in keep_first(df, ["k"], ["ord"]).collect()}
    last = {r.k: (r.ord, r.v) for r in keep_last(df, ["k"], ["ord"]).collect()}
    for k in {r[0] for r in rows}:
        mine = sorted((o, v) for kk, o, v in rows if kk == k)     # order, then the row itself
        assert first[k] == mine[0] and last[k] == mine[-1]
