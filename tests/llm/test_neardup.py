import random
import re
from itertools import combinations

import numpy as np

from tests.postings import postings
from tidemark.llm import neardup
from tidemark.llm.neardup import RADIUS, SLACK, anchors, found_reposts, repost_groups

VOCABULARY = [f"w{i}ö" if i % 9 == 0 else f"word{i}" for i in range(900)]


def fixture(seed=1, families=14, per=6):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = rng.sample(VOCABULARY, rng.randrange(45, 110))
        for _ in range(per):
            ws = base[:]
            for _ in range(rng.choice([0, 0, 1, 3, 8, 14, 20, 25])):
                k = rng.randrange(len(ws))
                ws[k : k + 1] = rng.choice([[], [rng.choice(VOCABULARY)], [ws[k], rng.choice(VOCABULARY)]])
            rng.shuffle(ws)
            rows.append({"title": rng.choice(["Title", None]), "company": "Firm", "description": rng.choice([" ", ", ", "</p><p>"]).join(ws).upper() if rng.random() < 0.2 else " ".join(ws)})
    return rows + [{"title": "x"}, {"description": ""}, {"description": "too few words"}, {"description": None, "title": "y"}]


def brute(rows):
    sets = {}
    for i, r in enumerate(rows):
        words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
        if r.get("description") is not None and len(words(r["description"])) >= 40:
            sets[i + 1] = set(words(" ".join(r.get(c) or "" for c in ("title", "company", "description"))))
    return {(a, b) for a, b in combinations(sorted(sets), 2) if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}


def test_pairs_against_brute_force(spark):
    rows = fixture()
    expected = brute(rows)
    got = [tuple(r) for r in found_reposts(postings(spark, rows)).collect()]
    assert len(got) == len(set(got)) and not set(got) - expected
    assert len(set(got)) >= 0.97 * len(expected) > 50


def test_hot_regions_lose_nothing(spark, monkeypatch):
    rows = fixture(seed=4)
    whole = {tuple(r) for r in found_reposts(postings(spark, rows)).collect()}
    monkeypatch.setattr(neardup, "HOT", 3)
    monkeypatch.setattr(neardup, "CHUNK", 20)
    assert {tuple(r) for r in found_reposts(postings(spark, rows)).collect()} == whole


def test_anchors_cover():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 300).astype(np.int32)
    index, anchor = anchors(x)
    weight = np.bitwise_count((x[index] ^ anchor).astype(np.uint32))
    assert weight.max() <= RADIUS + SLACK and len(np.unique(index)) == 300
    reach = [set(anchor[index == i]) for i in range(300)]
    for i in range(300):
        a, b = rng.choice(23, 2, replace=False)
        j, other = anchors(np.array([x[i] ^ (1 << a) ^ (1 << b)], np.int32))
        assert reach[i] & set(other)


def test_exact_copies_and_groups(spark):
    text = " ".join(VOCABULARY[:60])
    rows = [{"description": text} for _ in range(40)] + [{"description": text + " extra"}, {"description": " ".join(VOCABULARY[200:260])}, {}]
    assert found_reposts(postings(spark, rows)).count() == 41 * 40 // 2
    got = {r.posting_no: (r.class_id, r.group_id, r.links) for r in repost_groups(postings(spark, rows)).collect()}
    assert got[7] == (1, 1, 1) and got[41] == (41, 1, 1) and got[42] == (42, 42, 0) and 43 not in got


def test_a_large_class_of_copies_is_cut_and_loses_no_pair(spark, monkeypatch):
    rows = [{"description": " ".join(VOCABULARY[:60])} for _ in range(40)] + [{"description": " ".join(VOCABULARY[100:160])}] * 2
    monkeypatch.setattr(neardup, "COPIES", 7)
    got = [tuple(r) for r in found_reposts(postings(spark, rows)).collect()]
    assert sorted(got) == [*combinations(range(1, 41), 2), (41, 42)]


def test_empty_and_clashing_columns(spark):
    assert found_reposts(postings(spark, [])).count() == 0
    rows = postings(spark, fixture(families=2)).selectExpr("*", "1 as hashes", "2 as rep", "3 as key", "4 as body")
    assert found_reposts(rows).columns == ["posting_no_a", "posting_no_b"]


def test_very_long_text(spark):
    rows = [{"description": " ".join(f"t{i}" for i in range(60_000))}, {"description": " ".join(f"t{i}" for i in range(59_000))}]
    assert [tuple(r) for r in found_reposts(postings(spark, rows)).collect()] == [(1, 2)]


def test_copies_of_a_hot_region_do_not_grow_with_it(spark, monkeypatch):
    rng = np.random.default_rng(3)
    blocks = rng.choice(1 << 23, 4000, replace=False)
    rows = [(i, 60, [7] * 16, [int(b)] * 16, 1, 2, 3, 4) for i, b in enumerate(blocks)]
    signatures = spark.createDataFrame(rows, neardup.SIGNATURE)
    entries = neardup._entries(signatures, 0, 1)
    region = entries.first()["region"]
    monkeypatch.setattr(neardup, "HOT", 40)
    hot = spark.createDataFrame([(region, 8)], "region long, bits int")
    placed = neardup._placed(entries, hot, spark.createDataFrame([], "region long, division int, parts int"))
    # parts compared pair by pair would be a hundred copies of each
    assert 4000 < placed.count() < 5.5 * 4000 and placed.select("id").distinct().count() == 4000
    assert placed.groupBy("key").count().agg({"count": "max"}).first()[0] < 6 * neardup.HOT


def test_passes_sizes_and_divisions_lose_no_pair(spark, monkeypatch):
    rows = fixture(seed=6)
    whole = {tuple(r) for r in found_reposts(postings(spark, rows)).collect()}
    monkeypatch.setattr(neardup, "PASS", 400)
    monkeypatch.setattr(neardup, "HOT", 8)
    assert {tuple(r) for r in found_reposts(postings(spark, rows)).collect()} == whole and not whole - brute(rows)
