"""Every query with SQL against DuckDB, as sets of rows."""

import duckdb
import pandas as pd
import pytest

from lodestrata import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return db


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    clean = [tuple("null" if pd.isna(v) else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(clean)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, DIR).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in want.columns:  # integers with nulls come as floats on one side or the other
        if got[c].dtype != want[c].dtype and all(pd.api.types.is_numeric_dtype(x[c]) for x in (got, want)):
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DIR).count() > 0
