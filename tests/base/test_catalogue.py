"""Every registered query against its SQL on the same files."""

import glob
import math
import os

import duckdb
import pytest

from pagewright.plans import catalogue, catalogue_postings, catalogue_requests, catalogue_reviews, catalogue_sources, catalogue_states, catalogue_trees  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        made.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return made


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, con, name):
    found = catalogue.queries()[name](spark, SF)
    assert name in catalogue.oracle_sql()
    df = con.execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in df.description]
    assert sorted(cols) == sorted(found.columns)
    key = lambda row: tuple(str(x) for x in row)
    expected = sorted((tuple(plain(x) for x in r) for r in df.fetchall()), key=key)
    own = sorted((tuple(plain(r[c]) for c in cols) for r in found.collect()), key=key)
    assert own == expected
