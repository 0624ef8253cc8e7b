"""Every registered timeline query against its SQL in DuckDB, at the smallest size."""

import os

import duckdb
import pytest

from timeloom import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in plans.ORACLE_SQL:
        assert got
        return
    sql = plans.ORACLE_SQL[name]
    want = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({sql})").fetchall()
    assert got == sorted(repr(tuple(map(plain, r))) for r in want)


def test_entry():
    import __spark_entry__ as e

    assert {"j2_asof_before", "st2_luma_groups"} <= set(e.queries())
