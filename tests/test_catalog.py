"""Each query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from loam.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    plain = [tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False)]
    return sorted(plain, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    ours, theirs = catalog.queries()[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry_has_ranked_hits(spark, sf_dir):
    import __spark_entry__

    hits = __spark_entry__.entry(spark).toPandas()
    assert set(hits.columns) == {"query_id", "rank", "id", "score"}
    assert hits.groupby("query_id")["rank"].max().eq(8).all()
