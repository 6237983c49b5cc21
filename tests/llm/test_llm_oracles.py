"""Queries of the subpackage against their DuckDB oracles, and all of them for rows."""

import pytest

from compare import compare, duck
from ledgerloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(name, spark, sf_dir):
    df = queries.queries()[name](spark, sf_dir)
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    got, want = compare(df, duck(sf_dir), sql)
    assert got == want
