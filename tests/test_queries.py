"""Every query with SQL against DuckDB over whole tables, and the contract of the entry module."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from tidemark.plans.core_queries import QUERIES, SQL


def same(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    return v


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, tables, name):
    df = QUERIES[name](spark, data)
    cursor = tables.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    expected = Counter(tuple(same(v) for _, v in sorted(zip(columns, row))) for row in cursor.fetchall())
    assert Counter(tuple(same(v) for _, v in sorted(r.asDict().items())) for r in df.collect()) == expected


#: Rows of each query without SQL, as DuckDB counts them, and its columns.
ROWS = {
    "q_html_text": ("select count(*) from postings", ["posting_no", "text", "line"]),
    "q_merge_fold": ("select count(*) from postings", ["posting_no", "survivor"]),
    "q_merge_jobs": (None, None), "q_run_due": (None, ["turn", "posting_no", "job_id", "tier", "score", "merged"]), "q_enqueue_pending": (None, None),
    "q_refresh_aliases": ("select count(distinct job_id) from deliveries", ["job_id", "held", "status", "attempts", "posting_no"]),
    "q_quota_admission": ("select count(*) from (select distinct * from query_outcomes) where started_at is not null", ["site", "started_at", "run_id", "query_id", "admitted", "denial"]),
    "p7_found": (None, ["posting_no", "usd_year_min", "usd_year_max"]), "p7_unread": (None, ["reason", "unit", "n"]),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, tables, name):
    sql, columns = ROWS[name]
    df = QUERIES[name](spark, data)
    n = df.count()
    assert n > 0 and (sql is None or n == tables.execute(sql).fetchone()[0]) and (columns is None or sorted(df.columns) == sorted(columns))


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
