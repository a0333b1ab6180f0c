import json

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.sources import config, listing, replay, sinks
from tidemark.sources.snapshots import Snapshots, StateError
from tidemark.streaming import streams


def test_config(tmp_path):
    assert config.deep_merge({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}, "d": 2}
    (tmp_path / "x.json").write_text('{"a": {"b": 2}}')
    assert config.load(tmp_path / "none.json", tmp_path / "x.json", inline={"e": 1}) == {"a": {"b": 2}, "e": 1}
    schema = {"a": {"b": (0, 5)}, "m": {"x", "y"}, "s": str}
    config.validate({"a": {"b": 3}, "m": "x", "s": ""}, schema)
    for bad in ({"z": 1}, {"a": {"b": 9}}, {"a": {"b": True}}, {"m": "q"}, {"s": 1}, {"a": 1}):
        with pytest.raises(config.ConfigError):
            config.validate(bad, schema)


def test_replay(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "T", "platform": "P", "odd": 1}, {"title": " ", "platform": "P"}, 5]))
    (tmp_path / "b.json").write_text(json.dumps({"candidates": [{"job": {"title": "U", "platform": "Q"}, "expected": "x"}]}))
    (tmp_path / "c.json").write_text("{broken")
    postings, rejects = replay.read_replay(spark, str(tmp_path))
    assert sorted(r.title for r in postings.collect()) == ["T", "U"] and rejects.count() == 3


def test_feeds_and_pages(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"jobs": [{"id": 1, "title": "A", "url": "https://x.a.example/1"}, {"id": 2, "title": "B", "url": "https://b.example/2"}, {"id": 3, "title": "C", "url": "https://a.example/3"}]}))
    assert [r.title for r in replay.read_feed(spark, str(tmp_path / "f.json"), ["a.example"], 2).collect()] == ["A"]
    rss = "<rss><channel><item><title>Co: Role</title><link>https://a.example</link><pubDate>Tue, 20 Jan 2026 12:32:33 +0000</pubDate></item><item><title>x</title></item></channel></rss>"
    assert replay.parse_rss(rss, 9) == [{"title": "Role", "company": "Co", "url": "https://a.example", "description": "", "posted_at": "2026-01-20T12:32:33+00:00"}] and replay.parse_rss("<", 9) == []
    assert replay.parse_listing('<script>var listing = {"response": {"numFound": 0}};</script>') == ("valid_empty", [])
    assert replay.parse_listing('<script>var listing = {"response": {"jobs": {"b": [{"title": "t"}]}}};</script>')[0] == "embedded"
    assert replay.parse_listing('<script type="application/ld+json">{"@type": "JobPosting", "title": "t"}</script>')[0] == "jsonld"
    assert replay.parse_listing('<article class="job x"><a href="u"><b>T</b></a></article>') == ("cards", [{"title": "T", "url": "u"}])
    assert replay.parse_listing("<p>loading</p>") == ("parse_failed", []) and replay.parse_listing(None) == ("parse_failed", [])
    assert replay.next_offset(0, 10) == 10 and replay.next_offset(10, 10) is None and replay.next_offset(0, True) is None and replay.next_offset(0, 10001) is None


def test_listing_source(spark, tmp_path):
    folder = tmp_path / "s" / "t"
    folder.mkdir(parents=True)
    (folder / "k.jsonl").write_text('{"title": "A", "url": "u"}\nbroken\n')
    spark.dataSource.register(listing.ListingSource)
    queries = listing.plan(["k", "none"], ["t"], ["s"])
    rows = spark.read.format("listing").option("path", str(tmp_path)).option("queries", queries).load().collect()
    assert sorted((r.keyword, r.outcome) for r in rows) == [("k", "row"), ("k", "success"), ("none", "failed")]
    assert [listing.classify(*x) for x in ((200,), (429,), (403,), (404,), (503,), (None, "timed out"), (200, "Captcha"))] == ["success", "http_429", "blocked", "not_found", "http_5xx", "timeout", "challenge"]


def test_snapshots(spark, tmp_path):
    schema = T.StructType().add("k", T.StringType()).add("v", T.LongType())
    table = Snapshots(spark, f"file://{tmp_path}", "seen", schema)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert table.read().count() == 0 and table.version() is None
    assert table.write(rows(("a", 1))) == 1
    bad = lambda df: df.where("v < 0").count()
    with pytest.raises(StateError):
        table.write(rows(("a", -1)), bad)
    assert table.version() == 1
    with pytest.raises(StateError):
        table.write(rows(("b", 1)), expect=0)
    assert table.publish(lambda old: old.unionByName(rows(("b", 2))), bad) == 2 and table.read().count() == 2
    table.recover(1, f"file://{tmp_path}/out", bad)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 1
    with pytest.raises(Exception):
        table.recover(1, f"file://{tmp_path}/out")
    (tmp_path / "seen" / "CURRENT").write_text("9")
    with pytest.raises(StateError):
        table.read()


def _send(rows):
    return (None, True) if any(r["id"] == "u" for r in rows) else (204, False)


def test_delivery(spark, tmp_path):
    rows = spark.createDataFrame([(c, i) for i, c in enumerate("abcdefu")], "id string, n int").coalesce(1)
    got = {r.id: r.status for r in sinks.deliver(rows, "id", "n", _send).collect()}
    assert got == dict.fromkeys("abcde", "delivered") | dict.fromkeys("fu", "uncertain")
    sink = sinks.delivery_sink(f"file://{tmp_path}/log", "id", "n", _send)
    sink(rows.limit(3), 0)
    sink(rows.limit(4), 1)
    log = spark.read.parquet(f"file://{tmp_path}/log")
    assert log.count() == 4
    assert [sinks.outcome(*x) for x in ((200,), (429,), (400,), (None, True), (None, False))] == ["delivered", "failed", "permanent_failure", "uncertain", "failed"]


def test_report(spark, tmp_path):
    problems = spark.createDataFrame([("s", "mail a@b.example now", 2)], "site string, reason string, n long")
    data = json.loads(sinks.write_report({"rows": 3}, problems, tmp_path / "r").read_text())
    assert data["problems"][0]["reason"] == "mail [redacted] now" and "| site |" in (tmp_path / "r" / "summary.md").read_text()


def test_a_report_says_what_it_leaves_out(spark, tmp_path):
    problems = spark.range(30).selectExpr("cast(id as string) as site", "id as n")
    data = json.loads(sinks.write_report({}, problems, tmp_path / "r", 5).read_text())
    assert (len(data["problems"]), data["problems_in_all"]) == (5, 30) and "5 of 30 problems" in (tmp_path / "r" / "summary.md").read_text()


def test_streams(spark, data, tmp_path):
    outcomes = spark.read.parquet(f"{data}/query_outcomes.parquet")
    outcomes.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(outcomes.schema).parquet(str(tmp_path / "in"))

    def drain(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name)

    keyed = stream().withColumn("k", F.xxhash64("run_id", "query_id", "phase", "site"))
    distinct = outcomes.select(F.xxhash64("run_id", "query_id", "phase", "site")).distinct().count()
    assert drain(streams.deduplicated(keyed, "k", "started_at", "400 days").select("k"), "dedup").count() == distinct
    counts = drain(streams.windowed_counts(stream(), "started_at", ["site"], "1 day", "400 days"), "windows", "complete")
    assert counts.agg(F.sum("n")).first()[0] == outcomes.count()
    admitted = drain(streams.rolling_admission(stream(), "site", "started_at", "run_id", 3, 10**9), "admission")
    assert admitted.count() == outcomes.count() and admitted.where("admitted").groupBy("site").count().agg(F.max("count")).first()[0] == 3


def test_one_of_two_writers_follows_a_version(spark, tmp_path):
    schema = T.StructType().add("k", T.StringType())
    a, b = (Snapshots(spark, f"file://{tmp_path}", "t", schema) for _ in range(2))
    row = spark.createDataFrame([("x",)], schema)
    a.write(row)
    before = a.version()
    a.write(row)
    with pytest.raises(StateError):  # both began from the same version
        b._publish(7, before)
    # a writer that ended before it moved the pointer has published all the same
    row.write.parquet(f"file://{tmp_path}/t/v=3")
    b._renamed("3", "after=2")
    assert a.version() == 3 and a.read().count() == 1 and a.write(row) == 4
