"""Every query against its SQL on DuckDB."""

import math

import duckdb
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(row):
    return tuple(round(float(v), 6) if isinstance(v, float) and not math.isnan(v) else int(v) if hasattr(v, "as_integer_ratio") and not isinstance(v, (bool, float)) else v for v in row)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sf, con, name):
    got = catalog.queries()[name](spark, sf)
    rows = sorted((plain(r) for r in got.collect()), key=str)
    assert len(set(got.columns)) == len(got.columns)
    if sql := catalog.oracle_sql().get(name):
        result = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert rows == sorted((plain(r) for r in result), key=str)
        assert {c.lower() for c in got.columns} == {d[0].lower() for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description}
