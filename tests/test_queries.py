"""Every registered query with a SQL counterpart against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from strataplan import plans


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    show = lambda v: "~" if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted((tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query(spark, con, data, name):
    got, want = plans.QUERIES[name](spark, data).toPandas(), con.execute(plans.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 7
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
