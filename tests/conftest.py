"""One local session for all tests."""

from __future__ import annotations

import datetime as dt
import glob
import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from lodestone.runtime import session

    s = session("tests", "4", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def canon(value):
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, dt.datetime):
        return repr(value.replace(tzinfo=None))
    return repr(value)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Hold a query against its SQL on the tables of a folder."""
    opened = {}

    def check(make, sql, folder):
        if folder not in opened:
            con = opened[folder] = duckdb.connect()
            con.execute("SET TimeZone = 'UTC'")
            for path in glob.glob(f"{folder}/*.parquet"):
                con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        got = make(spark, folder)
        cols = sorted(got.columns)
        rows = sorted(tuple(canon(v) for v in r) for r in got.select(*cols).collect())
        want = opened[folder].execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == cols
        order = [names.index(c) for c in cols]
        assert rows == sorted(tuple(canon(r[i]) for i in order) for r in want.fetchall())

    return check
