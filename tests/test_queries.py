"""A cross-section of registered queries against their SQL twins (tools/check.py runs all of them)."""
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from maskfold.plans.fixtures import TABLES

FOLDER = "/root/testdata/sf0.001"
PICKED = ["w1_pick_threshold", "j18_pixel_confusion", "a24_region_confidence", "h17_co2", "g1_locked_split", "s8_history_current", "st1_stream_history", "a34_set_fingerprint", "j14_hamming_pairs"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


def test_every_twin_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", PICKED)
def test_query_equals_twin(spark, con, name):
    df = entry_point.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    cur = con.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    theirs = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(names) == cols and mine == theirs and mine
