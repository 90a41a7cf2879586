import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LATER = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    show = lambda v: "null" if pd.isna(v) is True else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return cols, sorted(tuple(show(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", LATER)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, D).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    (a, x), (b, y) = rows(got), rows(want)
    assert a == b and len(x) == len(y)
    assert [tuple(v.removesuffix(".0") for v in r) for r in x] == [tuple(v.removesuffix(".0") for v in r) for r in y]


def test_queries_are_importable_without_a_session():
    assert len(entry.queries()) >= 80
