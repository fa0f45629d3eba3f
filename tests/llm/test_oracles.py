"""The operators' queries beside their SQL on the smallest tables."""

import pytest

from stratalog.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    _, problem = compare(spark, FOLDER, name, QUERIES[name], ORACLES[name], connect(FOLDER))
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs_on_whole_tables(spark, name):
    got = QUERIES[name](spark, FOLDER)
    rows = {"op8_repeats": None, "op10_ann": None}.get(name, 200)
    assert got.count() == rows if rows else got.count() > 0
