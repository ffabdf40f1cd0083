"""Each registered query against its SQL in DuckDB, on the small tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Q, S = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def kinds(pdf):
    return {c: "number" if t.kind in "iuf" else "text or time" if t.kind in "OMS" or str(t).startswith("str") else t.kind for c, t in pdf.dtypes.items() if pdf[c].notna().any()}


def canonical(pdf, ordered=False):
    pdf = pdf[sorted(pdf.columns)]
    rows = [tuple("NULL" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return rows if ordered else sorted(rows)


@pytest.mark.parametrize("name", sorted(S))
def test_equals_sql(spark, duck, name):
    got, want = Q[name](spark, SF).toPandas(), duck.sql(S[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert kinds(got) == kinds(want)
    ordered = re.search(r"ORDER BY [^)]*$", S[name]) is not None
    assert canonical(got, ordered) == canonical(want, ordered)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(S) <= set(Q)
