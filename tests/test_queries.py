"""Every query with SQL gives the rows of that SQL."""

import duckdb
import pytest

from gleanery.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, sql):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    run = sql.execute(ORACLE_SQL[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(r[names.index(c)] for c in df.columns)) for r in run.fetchall())
    assert sorted(repr(tuple(r)) for r in got) == want


def test_entry_without_optional_parts(spark):
    import __spark_entry__ as e

    assert set(ORACLE_SQL) <= set(e.queries()) and e.entry(spark).count() > 0
