"""A few registered queries against their SQL, on the smallest test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = ["wowy_leaderboard", "ridge_gram", "scope_issues", "rank_average", "source_fingerprint", "payload_games", "recorded_requests"]


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("~" if v is None or v != v else str(v) for v in row) for row in frame.values.tolist())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    expected = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


def test_every_sql_has_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
