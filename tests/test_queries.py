"""Every registered query on the smallest tables: against its SQL where there is one, else that it runs."""

import os

import pytest
from compare import oracle, rows

import __spark_entry__ as entry

DATA = os.environ.get("STRATALOOM_TESTDATA", "/root/testdata/sf0.001")
LLM = {n for c in entry._CATALOGS[4:] for n in c.queries}
NAMES = sorted(set(entry.queries()) - LLM)

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = entry.queries()[name](spark, DATA)
    cols, got = rows(df)
    if sql := entry.oracle_sql().get(name):
        want_cols, want = oracle(DATA, sql)
        assert cols == want_cols
        assert got == want
    assert len(set(cols)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
