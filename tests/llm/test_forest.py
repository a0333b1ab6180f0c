"""The forest on disk, and near-duplicates of accepted texts against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.postings import platforms, postings
from tidemark.llm import forest
from tidemark.llm.forest import Conflict, Forest, Similar, candidates, near_listings, ranges, spread, text_entries, widened

WORDS = [f"word{i}" for i in range(700)]


def shingles(text):
    ws = re.findall(r"[^\W_]+", text.lower())
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def texts(seed=1, families=60, per=7):
    """Texts with altered copies in later batches: some words replaced, dropped or doubled in one stretch."""
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = rng.choices(WORDS, k=rng.randrange(60, 160))
        for i in range(per):
            ws = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                k = rng.randrange(len(ws))
                ws[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [ws[k], ws[k]]])
            rows.append({"batch_no": [0, None, 1, 1, 2, 3, 3][i % 7], "description": " ".join(ws), "title": rng.choice([None, ""])})
    rng.shuffle(rows)
    rows.sort(key=lambda r: r["batch_no"] or 0)
    rows += [{"batch_no": 1}, {"batch_no": 1, "description": "  "}, {"batch_no": 2, "description": "one"}, {"batch_no": 3, "description": "One!"}]
    return [{"posting_no": i + 1, **r} for i, r in enumerate(rows)]


def brute(rows):
    accepted, out = {}, {}
    for batch in sorted({r["batch_no"] or 0 for r in rows}):
        fresh = {}
        for r in (r for r in rows if (r["batch_no"] or 0) == batch):
            s = shingles(r.get("description") or "")
            if not s:
                continue
            near = [n for n, t in accepted.items() if len(s & t) >= 0.8 * len(s | t) - 1e-9]
            if batch and near:
                out[r["posting_no"]] = (min(near), len(near))
            else:
                fresh[r["posting_no"]] = s
        for n, s in sorted(fresh.items()):
            if s not in accepted.values():
                accepted[n] = s
    return out


def test_near_listings_against_brute_force(spark):
    rows = texts()
    expected = brute(rows)
    got = {r.posting_no: (r.accepted_no, r.links) for r in near_listings(postings(spark, rows)).collect()}
    assert set(got) <= set(expected) and len(expected) > 150
    assert sum(got.get(k) == v for k, v in expected.items()) >= 0.99 * len(expected)
    assert near_listings(postings(spark, [])).count() == 0


def test_the_prefix_is_measured_on_all_texts_of_every_batch(spark):
    rng = random.Random(8)
    history = [rng.choices(WORDS, k=100) for _ in range(300)]
    rows = [{"batch_no": 0, "description": " ".join(ws)} for ws in history]
    rows += [{"batch_no": 1, "description": " ".join(rng.choices(WORDS, k=100))} for _ in range(20)]  # nothing to measure on
    for ws in history:
        i, j = rng.randrange(5, 45), rng.randrange(55, 95)
        rows.append({"batch_no": 2, "description": " ".join([*ws[:i], "new", *ws[i + 1 : j], "newer", *ws[j + 1 :]])})
    rows = [{"posting_no": i + 1, **r} for i, r in enumerate(rows)]
    got = {r.posting_no: (r.accepted_no, r.links) for r in near_listings(postings(spark, rows)).collect()}
    expected = brute(rows)
    assert set(got) <= set(expected) and len(expected) == 300
    assert sum(got.get(k) == v for k, v in expected.items()) >= 0.99 * len(expected)


def test_the_prefix_is_widened_until_recall_holds(spark):
    rows = postings(spark, texts(seed=3))
    old, new = rows.where("coalesce(batch_no, 0) = 0"), rows.where("batch_no > 0")
    run, queries, verify = forest.stash(text_entries(old), "t"), forest.stash(text_entries(new), "t"), Similar(rows)
    bits, recall = widened(queries, run, verify, 0.99)
    assert 0 < bits < forest.FIRST_BITS and recall >= 0.99
    found = lambda b: verify(candidates(queries, run, b)).select("q_low", "low").distinct().count()
    assert found(forest.FIRST_BITS) < found(bits) >= 0.99 * found(8)


def test_small_batches_push_their_ranges_to_the_files(spark, tmp_path):
    store = Forest(spark, f"file://{tmp_path}/f")
    entries = spread(spark.range(200_000).select(F.xxhash64("id").alias("point"), F.xxhash64(F.lit("c"), "id").alias("check"), F.col("id").alias("low")))
    store.add(entries, 200_000)
    batch = entries.where("low in (7, 70000, 199999)").withColumn("low", F.col("low") + 1_000_000)
    found = store.search(batch, 3)
    assert sorted(map(tuple, found.collect())) == [(1_000_007, 7), (1_070_000, 70_000), (1_199_999, 199_999)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(perm" in plan
    assert store.entries().where(ranges(batch, forest.FIRST_BITS, 3)).count() == 3 and ranges(batch, 56, 10**9) is None


def test_one_of_two_writers_wins(spark, tmp_path):
    rows = spark.range(10).select(F.lit(0).alias("tree"), F.col("id").alias("perm"), F.col("id").alias("check"), F.col("id").alias("low"))
    store = Forest(spark, f"file://{tmp_path}/f")
    store.add(rows, 10)
    seen = store._manifest()
    store.add(rows, 10)
    with pytest.raises(Conflict):
        store._commit(*seen)
    assert len(store.runs()) == 2 and store.entries().count() == 20


def test_redirects_are_applied_by_merges(spark, tmp_path):
    p = platforms(spark)
    rows = [{"posting_no": i, "job_id": f"j{i}"} for i in range(1, 9)]
    store = Forest(spark, f"file://{tmp_path}/f", most_runs=3)
    assert store.accept(postings(spark, rows), p).count() == 0
    got = []
    for n, (a, b) in enumerate([(7, 8), (6, 7), (5, 6), (2, 5), (1, 2)]):
        got += [tuple(r) for r in store.accept(postings(spark, [{"posting_no": 20 + n, "job_id": f"j{a}", "aliases": [f"J{b}"]}]), p).collect()]
    assert got == [(20, 7), (21, 6), (22, 5), (23, 2), (24, 1)]
    lows = spark.createDataFrame([(8,), (3,)], "low long")
    assert {r.low: r.now for r in store.resolved(lows).collect()}[3] == 3
    assert len(store._manifest()[1]["redirects"]) <= 3 and len(store.runs()) <= 3
    assert [tuple(r) for r in store.accept(postings(spark, [{"posting_no": 30, "job_id": "j8"}]), p).collect()] == [(30, 1)]
