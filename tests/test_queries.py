"""Every registered advertising query gives the rows of its SQL."""

import math

import duckdb
import pytest

from adsignal.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert mine
        return
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
    assert mine == theirs


def test_named_pages_gives_all_its_columns(spark):
    """F8 of round 4: a column had been taken out of the query and of its SQL."""
    rows = catalogue.QUERIES["named_pages"](spark, SF)
    assert rows.columns == ["page_id", "start", "n"] and {r.start for r in rows.select("start").distinct().collect()} == {"https://www.youtube.com/watch?v="}
    assert " AS start" in catalogue.ORACLES["named_pages"]
