"""The driver's contract: registered queries agree with their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from papyra import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def agree(spark, sql, run, text):
    df = run(spark, SF)
    columns = sorted(df.columns)
    got = sql.execute(text)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    order = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in got.fetchall()), key=order)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=order) == want


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_core_query(spark, sql, name):
    agree(spark, sql, core.QUERIES[name], core.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
