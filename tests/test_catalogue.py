"""Every query of the photo engine against its DuckDB oracle, at the size that the driver checks."""

import collections
import decimal

import duckdb
import pytest

from shoebox.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 5) + 0.0
    return value


def rows(found):
    return collections.Counter(tuple(plain(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    columns = ",".join(f'"{c}"' for c in df.columns)
    assert got == rows(duck.sql(f"select {columns} from ({catalogue.ORACLES[name]}) o").fetchall())


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
