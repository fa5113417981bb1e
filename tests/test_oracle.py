"""Every registered query over bars that has SQL, against DuckDB on the same tables."""

import math

import duckdb
import pandas as pd
import pytest

from tidemark.plans import more, queries as q, rules  # noqa: F401  more and rules register queries of their own

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(df: pd.DataFrame) -> list:
    def cell(x):
        if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return "null"
        return str(bool(x)) if str(type(x)).find("bool") >= 0 else str(float(x)) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_rows(spark, duck, name):
    got, want = q.QUERIES[name](spark, DIR).toPandas(), duck.execute(q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_marks_of_an_entry_on_the_last_bar(spark, tmp_path):
    """The rule first holds on the bar before the last: in at the last open, out at the last close."""
    c = duckdb.connect()
    values = [10, 9, 8, 7, 6, 9, 12]
    c.execute("create table events (event_id bigint, ts timestamp, event_type varchar, value double)")
    for i, x in enumerate(values):
        c.execute("insert into events select 2 * $1 + k, timestamp '2024-01-01' + to_hours(cast(4 * $1 + k as integer)), 'view', $2 + k from range(2) r(k)", [i, float(x)])
    c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    held = q.QUERIES["sma_regime_hold_trades"](spark, str(tmp_path)).collect()
    assert [(r.entry_i, r.exit_i, r.reason) for r in held] == [(6, 6, "end-of-test")]
    got, want = q.QUERIES["account_marks"](spark, str(tmp_path)).toPandas(), c.execute(q.SQL["account_marks"]).df()
    assert rows(got) == rows(want) and len(got) == 7


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(q.SQL) >= 60
