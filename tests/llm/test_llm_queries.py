"""Every query of the package with SQL is held against it on the smallest tables."""

import os

import pytest

from lodestone.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name], DATA)
