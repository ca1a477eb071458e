"""Every registered query against its DuckDB oracle at sf0.01, and the
flagship entry point on sf0.001."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_ORACLE
from tools.check_oracle import _digest
from vitrine.plans import registry

ORACLES = registry.oracle_sql()


# Queries without a SQL twin (iterative or model-based): checked by rows here
# and against brute force in test_search.py.
ROWS_ONLY = {"ivf_topk"}


def test_every_query_has_an_oracle_or_is_rows_only():
    qs = registry.queries()
    assert set(qs) <= set(entry.queries())
    assert set(ORACLES) <= set(qs)
    assert set(qs) - set(ORACLES) == ROWS_ONLY


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["status", "n"] and len(rows) == 4


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF_ORACLE)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows)[0] == _digest(ocols, orows)[0]
