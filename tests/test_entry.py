import duckdb
import pytest

import __spark_entry__ as entry
from faintdip.queries import ORACLES, QUERIES


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_are_queries():
    assert set(ORACLES) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["flagship_dip_scan", "sky_nearest", "inspection_list", "rank_metrics", "external_classify"])
def test_some_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("events", "customer", "supplier", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    rows = sorted(map(str, want.fetchall()))
    got = QUERIES[name](spark, sf).select(*names).collect()
    assert sorted(str(tuple(r)) for r in got) == rows
