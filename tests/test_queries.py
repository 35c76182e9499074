from collections import Counter

import duckdb
import pytest

from quadrille import bindings


@pytest.fixture(scope="module")
def db(sf):
    with duckdb.connect() as con:
        for t in "customer supplier part orders events embeddings".split():
            con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
        yield con


@pytest.mark.parametrize("name", sorted(bindings.queries()))
def test_against_sql(spark, sf, db, name):
    frame = bindings.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    want = db.sql(bindings.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert Counter(map(tuple, frame.select(*columns).collect())) == Counter(map(tuple, want.select(*columns).fetchall()))
