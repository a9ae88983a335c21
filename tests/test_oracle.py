"""Every query with SQL gives the rows that DuckDB gives."""

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    numbers = {c: (want[c].dtype.kind in "iuf", got[c].dtype.kind in "iuf") for c in want.columns if len(want)}
    assert all(a == b for a, b in numbers.values()), numbers
    for c in want.columns:  # integers that hold nulls come as floats
        if want[c].dtype != got[c].dtype and want[c].dtype.kind in "if" and got[c].dtype.kind in "if":
            want[c], got[c] = want[c].astype("float64"), got[c].astype("float64")
    assert rows(got[list(want.columns)]) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
