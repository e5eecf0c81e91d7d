"""Every registered query of the library with an oracle against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from treeline.plans import registry
from treeline.session import TABLES

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows_of(frame):
    frame = frame[sorted(frame.columns)]

    def text(v):
        if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return ""
        if isinstance(v, (int, float, np.number)) and not isinstance(v, bool):  # a column with nulls comes as floats
            return f"{float(v) + 0.0:.5f}"
        return str(v)

    return sorted(tuple(text(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
