"""Entries looked up through aliases, against the sequential look-up."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import identity
from tidemark.plans.core_queries import QUERIES


def sequential(current, rows, insert):
    """``{key: (key before, last row)}``; rows are (ordinal, key, aliases) in order."""
    entries = {k: (k, None) for k in current}
    for o, key, aliases in rows:
        if key is None:
            continue
        found = next((k for k in [key, *(aliases or [])] if k in entries), None)
        if found is not None:
            entries[key] = (entries.pop(found)[0], o)
        elif insert:
            entries[key] = (None, o)
    return entries


@pytest.mark.parametrize("insert", [True, False])
def test_rekeyed_equals_the_sequential_one(spark, insert):
    rng = random.Random(5)
    name = lambda: f"k{rng.randrange(150)}"
    current = sorted({name() for _ in range(40)})
    rows = [(i, rng.choice([None, *[name() for _ in range(9)]]), rng.choice([None, [name() for _ in range(rng.randrange(4))]])) for i in range(120)]
    c = spark.createDataFrame([(k, f"status of {k}") for k in current], "id string, status string")
    i = spark.createDataFrame(rows, "n long, id string, al array<string>")
    got = identity.rekeyed(c, i, "id", "al", "n", ["n"], {"status": F.lit("pending")} if insert else None).collect()
    assert len({r.id for r in got}) == len(got)
    assert {r.id: (r.held, r.n) for r in got} == sequential(current, rows, insert)
    assert all(r.status == ("pending" if r.held is None else f"status of {r.held}") for r in got)


def test_an_entry_under_an_alias_is_not_left_behind(spark):
    c = spark.createDataFrame([("old", 3), ("other", 1)], "id string, attempts int")
    i = spark.createDataFrame([(1, "new", ["none", "old"]), (2, "x", None)], "n long, id string, al array<string>")
    got = identity.rekeyed(c, i, "id", "al", "n", ["n"], {"attempts": F.lit(0)})
    assert sorted((r.id, r.attempts, r.n) for r in got.collect()) == [("new", 3, 1), ("other", 1, None), ("x", 0, 2)]
    got = identity.rekeyed(c, i, "id", "al", "n", ["n"])
    assert sorted((r.id, r.attempts, r.n) for r in got.collect()) == [("new", 3, 1), ("other", 1, None)]


def test_queries_over_whole_tables(spark, data):
    read = lambda t: pq.read_table(f"{data}/{t}.parquet").to_pylist()
    current = {r["job_id"] for r in read("deliveries") if r["job_id"] is not None}
    rows = sorted((r["posting_no"], r["job_id"], r["aliases"]) for r in read("postings"))
    seen, fresh, ids = {r["identity"] for r in read("seen_identities")}, [], set()
    for o, key, aliases in rows:
        if key is not None and key not in ids and not seen & {key, *(aliases or [])}:
            fresh.append((o, key, aliases))
            ids.add(key)
    for name, expected in (("q_enqueue_pending", sequential(current, fresh, True)), ("q_refresh_aliases", sequential(current, rows, False))):
        got = QUERIES[name](spark, data).where("job_id is not null").collect()
        assert len(got) == len(expected) and {r.job_id: (r.held, r.posting_no) for r in got} == expected
