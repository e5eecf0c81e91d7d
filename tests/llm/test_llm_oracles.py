"""The registered queries of this subpackage that SQL can express."""

import numbers

import duckdb
import pandas as pd

from treeline.llm import queries
from treeline.session import TABLES


def rows_of(frame):
    """Rows in one order; a column of whole numbers with nulls comes as floats from one side."""
    plain = lambda v: "" if pd.isna(v) else float(v) if isinstance(v, numbers.Number) else v
    return sorted((tuple(plain(v) for v in row) for row in frame.astype(object).itertuples(index=False)), key=str)


def test_oracles(spark, sf_dir):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(sql).df()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        assert rows_of(got[columns]) == rows_of(want[columns])


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
