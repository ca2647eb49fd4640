"""The registered queries against their SQL; the long ones only with GRAPHTRAILS_ALL=1."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("GRAPHTRAILS_DATA", "/root/testdata/sf0.001")
#: Those with a ranking of their own; queries on the shared tour pay for it once.
LONG = {n for n in entry.core_queries() if "circuit" in n} | {"tour_of_file", "closed_trails", "next_starts", "edges_covered_once"}
NAMES = [n for n in entry.core_queries() if os.environ.get("GRAPHTRAILS_ALL") or n not in LONG]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = entry.core_queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    cursor = db.execute(entry.core_sql()[name])
    names = [c[0] for c in cursor.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=str)
    assert sorted(names) == columns and got == want


def test_every_query_has_sql():
    assert set(entry.core_queries()) == set(entry.core_sql())
