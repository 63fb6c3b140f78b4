"""Every registered query of the engine against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from strandlake.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, con, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    relation = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in relation.description]
    assert sorted(names) == columns
    want = sorted((tuple(dict(zip(names, r))[c] for c in columns) for r in relation.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want
