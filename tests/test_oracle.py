"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from twinseek.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def normal(value):
    return round(value, 5) if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    said = db.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in said.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(map(normal, r)) for r in said.fetchall()), key=repr)
    have = sorted((tuple(normal(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert have == want
