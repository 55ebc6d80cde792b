import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(k for k in entry.queries() if k.startswith("q"))


def rows(frame):
    frame = frame[sorted(frame.columns)]
    value = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, float) else v if isinstance(v, str) else int(v)
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(duck.execute(sql).df())
    else:
        assert len(got)


def test_flagship(spark):
    assert entry.entry(spark).count() == 1000
