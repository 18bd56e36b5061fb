"""The registered queries: names, columns, and agreement with SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["anchors_long", "asof_strict_previous", "reconcile", "coverage_by_week", "cell_table", "calibration_error", "spearman", "cox_by_group", "null_reference", "difference_three_ways", "equal_count_bins_global", "prize_grid"]


def cell(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", FAST)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(cell(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in found.fetchall()), key=str)
    df = entry.queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(cell(r[c]) for c in sorted(names)) for r in df.collect()), key=str) == want


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
