"""Registered queries against their DuckDB statements."""

import pytest

from tally.llm import oracle
from tally.llm.queries import QUERIES
from tests.llm.common import DATA
from tests.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_matches_oracle(spark, name):
    problems, _ = compare(spark, duck(DATA), name, QUERIES[name], oracle.oracle_sql()[name], DATA)
    assert not problems, problems
