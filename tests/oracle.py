"""Run a registered query and its SQL, and compare columns and rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(folder=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else x


def rows(table):
    names = sorted(table.column_names)
    return sorted(repr([plain(r[n]) for n in names]) for r in table.select(names).to_pylist())


def expected(text, folder=DATA):
    return connect(folder).sql(text).to_arrow_table()


def assert_same(df, text, folder=DATA):
    found, wanted = df.toArrow(), expected(text, folder)
    assert sorted(found.column_names) == sorted(wanted.column_names)
    assert rows(found) == rows(wanted)
    return found.num_rows
