"""Every query of the package that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from tessellog.llm import queries


def rows(frame):
    frame = frame.astype(object)[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf_dir}/{t}'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for k in got.columns:  # a column of whole numbers with nulls comes as floats from one side
        if got[k].dtype.kind == "f" or want[k].dtype.kind == "f":
            got[k], want[k] = got[k].astype(float), want[k].astype(float)
    assert rows(got) == rows(want)
