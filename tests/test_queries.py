"""Each query against its SQL at sf0.001."""

import duckdb
import pandas as pd
import pytest

from skeinworks.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(p, columns):
    p = p[columns].astype(object)
    return sorted((tuple(None if pd.isna(v) else round(v, 6) if isinstance(v, float) else v for v in r) for r in p.values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry_imports():
    import __spark_entry__

    assert "search_fused" in __spark_entry__.queries()
