import duckdb
import pytest

import __spark_entry__ as entry
from assay.queries import QUERIES, SQL

TABLES = "documents labels events pages orders conversations nation benchmark".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, db, name):
    got, want = QUERIES[name](spark, sf).toPandas(), db.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
