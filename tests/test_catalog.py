"""Every catalogue query against its SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pytest

from tidemark.plans.checks import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in ("customer", "events", "lineitem", "orders", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    return c


def rows(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols].copy()
    for c in cols:
        if str(pdf[c].dtype).startswith("datetime"):
            pdf[c] = pdf[c].astype("datetime64[us]").astype(str)

    def plain(v):
        if v is None or v != v:
            return None
        return float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v

    return sorted((tuple(map(plain, r)) for r in pdf.itertuples(index=False)), key=str)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1.0, abs(a)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(map(same, x, y)), (x, y)


#: The whole search of 324 sets on five folds takes minutes on a few cores; ``tests/test_boosting.py`` holds it against one set at a time.
LONG = {"grid_cv"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - LONG))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() == 3
