"""Queries of the general problems, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from tidemark.operators import pay, times
from tidemark.plans import reference_queries, times_sql
from tidemark.storage import table


def _q(build, *tables):
    return lambda spark, sf_dir: build(*[table(spark, sf_dir, t) for t in tables])


QUERIES = {
    "p1_found": _q(times.found_instants, "postings", "platforms"),
    "p7_found": _q(pay.found_pay, "postings", "platforms", "pay_units"),
    "p7_unread": _q(pay.unread_pay, "postings", "platforms", "pay_units"),
}

QUERIES |= reference_queries.QUERIES

SQL: dict[str, str] = {"p1_found": times_sql.FOUND} | reference_queries.SQL
