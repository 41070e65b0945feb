"""Every core query with SQL is held against it on the smallest tables."""

import os
from importlib import import_module

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = {k: v for m in entry.PLANS if ".llm" not in m for k, v in import_module(m).oracle_sql().items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(CORE))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(entry.queries()[name], CORE[name], DATA)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
