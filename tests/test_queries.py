"""Every registered query of the library: against its SQL where it has some, else that it runs."""

import datetime
import decimal
import math

import duckdb
import pytest

from tessera.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.8g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(table):
    columns = sorted(table.column_names)
    return columns, sorted(repr([plain(r[c]) for c in columns]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).to_arrow_table()
        assert rows_of(got) == rows_of(want)
    else:
        assert got.num_rows > 0
