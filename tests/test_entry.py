"""The registered queries of the facts engine against DuckDB."""

import duckdb
import pytest

from quarrymap.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


def same(spark_rows, duck_rows):
    columns = sorted(spark_rows.columns)
    assert columns == sorted(duck_rows.columns)
    key = lambda x: sorted(repr(tuple(None if v != v else v for v in r)) for r in x[columns].astype(object).itertuples(index=False, name=None))
    assert key(spark_rows) == key(duck_rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, small, name):
    same(catalogue.QUERIES[name](spark, small).toPandas(), duck.execute(catalogue.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["from_unit_id", "to_unit_id", "kind"]
    assert set(e.oracle_sql()) <= set(e.queries())
