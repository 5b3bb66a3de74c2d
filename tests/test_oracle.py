"""Engine vs the independent DuckDB oracle, every registered query (small scale here; the
driver repeats this at sf0.01)."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from oracle import ORACLE_SQL
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def test_every_query_has_an_oracle():
    from dealflow.plans.registry import queries
    assert set(E.oracle_sql()) >= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    exp = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == exp


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["market", "sql_booked", "sql_held", "sal", "pipeline_arr", "pipeline_acv",
                          "bookings_arr", "bookings_acv"]
