"""Each query that has SQL against it, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from loam.llm import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    plain = [tuple(None if pd.isna(v) else float(v) if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False)]
    return sorted(plain, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    ours, theirs = queries.queries()[name](spark, sf_dir).toPandas(), duck.execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
