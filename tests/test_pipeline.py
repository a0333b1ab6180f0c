"""Whole runs, and the merge against a sequential one."""

import re
import unicodedata
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import rules
from tidemark.operators.identity import FILLED
from tidemark.plans import pipeline

SCHEMA = "n long, job_id string, source_id string, aliases array<string>, platform string, url string, title string, company string, location string, description string, description_status string, work_mode string, is_remote boolean"


def now():
    return F.lit("2026-08-01 00:00:00").cast("timestamp")


def checks():
    return [rules.Rule("closed", rules.REJECT, F.col("title") == "Closed")]


def plain(t):
    return re.sub(r"\s+", " ", "".join(c for c in unicodedata.normalize("NFKD", t).lower() if not unicodedata.combining(c))).strip()


def clean(t):
    t = (t or "").strip()
    return "" if t.lower() in ("nan", "nat", "none", "<na>", "null") else t


def sequential(rows):
    merged, index = [], {}
    worth = {"full": 3, "snippet": 2, "fetch_failed": 1}
    for r in rows:
        r["n_rows"], r["warnings"] = 1, list(r["evidence_warnings"] or [])
        r["urls"] = list(dict.fromkeys([*(r["source_urls"] or []), r["url"]]))
        keys = {"url:" + r["url"]}
        if r["there"] and r["there"].split("?")[0].rsplit("/", 1)[-1].lower() not in ("", "careers", "jobs", "positions", "apply"):
            keys.add("url:" + r["there"])
        mine = clean(r["source_id"])
        hit = next((index[k] for k in [r["job_id"], *sorted(keys)] if k in index and not (mine and clean(index[k]["source_id"]) not in ("", mine) and r["platform"] == index[k]["platform"])), None)
        if hit is None:
            hit = r
            merged.append(r)
        else:
            hit["n_rows"] += 1
            hit["aliases"] = list(dict.fromkeys([*hit["aliases"], *r["aliases"], r["job_id"]]))
            hit["urls"] = list(dict.fromkeys(hit["urls"] + r["urls"]))
            if clean(hit["location"]) and clean(r["location"]) and plain(hit["location"]) != plain(r["location"]):
                hit["warnings"].append("conflicting_locations")
            modes = {hit["work_mode"] or "unknown", r["work_mode"] or "unknown"}
            if "unknown" not in modes and len(modes) > 1:
                hit["warnings"].append("contradictory_work_mode")
            if (worth.get(r["description_status"], 0), len(r["description"])) > (worth.get(hit["description_status"], 0), len(hit["description"])):
                hit["description"], hit["description_status"] = r["description"], r["description_status"]
            for name in FILLED:
                if not clean(hit[name]) and clean(r[name]):
                    hit[name] = r[name]
            for name in ("salary_min", "salary_max"):
                if hit[name] is None or hit[name] != hit[name]:
                    hit[name] = r[name] if r[name] is not None and r[name] == r[name] else hit[name]
            if (hit["work_mode"] or "unknown") == "unknown" and (r["work_mode"] or "unknown") != "unknown":
                hit["work_mode"], hit["is_remote"] = r["work_mode"], r["is_remote"]
            hit["warnings"] = list(dict.fromkeys(hit["warnings"] + r["warnings"]))
        index |= dict.fromkeys([r["job_id"], *keys], hit)
    return merged


def test_merge_equals_the_sequential_one(spark, data):
    normal = pipeline.normalize_postings(spark.read.parquet(f"{data}/postings.parquet")).where("url is not null")
    rows = sorted((r.asDict() for r in normal.withColumn("there", pipeline.text.canonical_url(F.col("application_url"))).collect()), key=lambda r: r["posting_no"])
    got = {r.posting_no: r for r in pipeline.merge(normal, "posting_no").collect()}
    expected = sequential(rows)
    assert len(expected) < len(rows) and set(got) == {r["posting_no"] for r in expected}
    same = lambda v: None if v != v else v
    for e in expected:
        g = got[e["posting_no"]]
        for name in ("job_id", "title", "description", "description_status", "aliases", "work_mode", "is_remote", "salary_min", "salary_max", *FILLED):
            assert same(g[name]) == same(e[name]), name
        assert (g["merged"], g["source_urls"], g["evidence_warnings"]) == (e["n_rows"], e["urls"], list(dict.fromkeys(e["warnings"])))


def rows(spark):
    row = lambda n, i, p, url, title="Nurse", place="", text="x", mode="unknown": (n, i, None, [f"al{n}"], p, url, title, "C", place, text, "full", mode, None)
    return spark.createDataFrame([
        row(1, "a", "P", "https://x.example/1", place="Lahore", mode="remote"), row(2, "b", "Q", "https://x.example/1/", place="Karachi", text="longer", mode="hybrid"), row(3, "a", "P", "https://x.example/2"),
        row(4, "c", "P", "https://x.example/4"), row(5, "d", "P", "https://x.example/5", title="Closed"), row(6, "e", "P", "https://x.example/6"),
    ], SCHEMA)


def test_run_and_delivery(spark):
    raw, seen = rows(spark), spark.createDataFrame([("al4", 0.0)], "identity string, seen_at double")
    first = pipeline.run(raw, "n", checks(), [], [], seen, now=now())
    assert {r.tier: r.n for r in first.counts.collect()} == {"qualified": 3, "rejected": 1}  # a, b and a are one
    one = first.postings.where("n = 1").first()
    assert (one.merged, one.description, one.location, one.evidence_warnings) == (3, "longer", "Lahore", ["conflicting_locations", "contradictory_work_mode"]) and {"al1", "al2", "b"} <= set(one.aliases)
    assert sorted(r.n for r in first.new.collect()) == [1, 6] and [r.job_id for r in first.due.orderBy("turn").collect()] == ["a", "e"] and first.retired.count() == 0
    pending, seen, outcomes = pipeline.deliver(first, seen, lambda chunk: (200, False) if chunk[0]["job_id"] == "a" else (500, False), now(), 1)
    assert sorted(map(tuple, outcomes.collect())) == [("a", "delivered"), ("e", "failed")]
    assert [(r.job_id, r.status, r.attempts, r.next_retry_at) for r in pending.collect()] == [("e", "failed", 1, datetime(2026, 8, 1, 0, 10))]
    assert {"a", "al1", "b", "al2", "al4"} <= {r.identity for r in seen.collect()}
    # later: e comes back under another id, and no other source has rows
    again = raw.where("n = 6").withColumns({"job_id": F.lit("new"), "aliases": F.array(F.lit("e"))})
    early = pipeline.run(again, "n", checks(), [], [], seen, pending=pending, now=now())
    assert [(r.job_id, r.attempts) for r in early.pending.collect()] == [("new", 1)] and early.due.count() == 0
    late = pipeline.run(raw.limit(0), "n", checks(), [], [], seen, pending=early.pending, now=now() + F.expr("interval 1 day"))
    assert [r.job_id for r in late.due.collect()] == ["new"]
    gone = pipeline.run(raw.limit(0), "n", checks(), [], [], seen, pending=early.pending, now=now() + F.expr("interval 9 days"))
    assert [r.job_id for r in gone.retired.collect()] == ["new"] and gone.pending.count() == gone.due.count() == 0


def test_fan_in_keeps_failures_apart(spark):
    def broken():
        raise OSError("gone")

    late = lambda: rows(spark).drop("n").withColumn("title", F.raise_error(F.lit("while it is read")).cast("string"))
    got, outcomes = pipeline.fan_in(spark, {"none": lambda: rows(spark).drop("n").limit(0), "broken": broken, "late": late, "good": lambda: rows(spark).drop("n")}, "n")
    assert [(r.source, r.status, r.rows) for r in outcomes.collect()] == [("none", "valid_empty", 0), ("broken", "failed", 0), ("late", "failed", 0), ("good", "success", 6)]
    assert got.count() == 6 and pipeline.run(got, "n", checks(), [], [], now=now()).postings.count() == 4
