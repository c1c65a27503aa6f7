"""Driver contract: entry runs; every oracle query matches DuckDB at sf0.001."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import digest, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLE = E.oracle_sql()
QUERIES = E.queries()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["key", "window_start", "window_end",
                                                  "event_count"]


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    exp = con.execute(ORACLE[name]).df()
    n1, c1, h1, _ = digest(got)
    n2, c2, h2, _ = digest(exp)
    assert (n1, c1) == (n2, c2)
    assert h1 == h2
