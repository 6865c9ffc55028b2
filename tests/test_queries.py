"""Every query that SQL expresses gives the rows of its SQL, on the smallest tables."""

import duckdb
import pytest

from seriesloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(r[i]) for i in order) for r in rows), [names[i] for i in order]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    cur = db.execute(catalog.ORACLE[name])
    assert got == canon(cur.fetchall(), [c[0] for c in cur.description])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
