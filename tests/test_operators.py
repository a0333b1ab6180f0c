import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import identity, ranking, reconcile, rules, state
from tidemark.operators.components import components, hook


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(3)
    rows = [(i, 10_000 + i) for i in range(60)] + [(i + 1, 10_000 + i) for i in range(60)]  # a chain
    rows += [(1000 + i, 5) for i in range(300)]  # a hot key
    rows += [(rng.randrange(2000, 2400), 20_000 + rng.randrange(200)) for _ in range(400)] + [(9999, None)]
    got = {r.member: r.root for r in components(hook(spark.createDataFrame(rows, "member long, key long"))).collect()}
    first, links = {}, []
    for m, k in rows:
        if k is not None:
            links.append((m, first.setdefault(k, m)))
    expected = union_find(links)
    assert {m: got.get(m, m) for m in expected} == expected and 9999 not in got
    assert components(hook(spark.createDataFrame([], "member long, key long"))).count() == 0


def reference_fold(rows):
    owner, about, out = {}, {}, {}
    for o, keys, space, native in rows:
        hit = next((owner[k] for k in keys if k in owner and not (native and about[owner[k]][1] and native != about[owner[k]][1] and about[owner[k]][0] == space)), None)
        if hit is None:
            hit = o
            about[o] = (space, native)
        for k in keys:
            owner[k] = hit
        out[o] = hit
    return out


def test_greedy_fold_equals_the_sequential_one(spark):
    rng = random.Random(7)
    rows = [(i, [f"k{rng.randrange(60)}" for _ in range(rng.randrange(0, 4))], rng.choice("ab"), rng.choice([None, "1", "2"])) for i in range(300)]
    df = spark.createDataFrame(rows, "o long, keys array<string>, space string, native string")
    got = {r.o: r.survivor for r in identity.greedy_fold(df, "o", F.col("keys"), ("space", "native")).collect()}
    assert got == reference_fold(rows)


def test_unseen_upsert_refresh(spark):
    rows = spark.createDataFrame([(1, "a", ["x"]), (2, "b", []), (3, "b", None), (4, None, ["y"])], "n long, id string, al array<string>")
    seen = spark.createDataFrame([("x",), ("z",)], "identity string")
    ids = F.concat(F.array("id"), F.coalesce("al", F.array().cast("array<string>")))
    assert [r.n for r in identity.unseen(rows.where("id is not null"), ids, "id", "n", seen, "identity").collect()] == [2]
    a, b = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, identity.upsert(a, b, "k", ["v"]).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert sorted(map(tuple, identity.refresh(a, b, "k", ["v"]).collect())) == [("a", 1), ("b", 9)]


@pytest.mark.parametrize("b,l,r,expected", [(1, 1, 2, 2), (1, 2, 1, 2), (1, 2, 2, 2), (1, None, 2, None), (None, 3, None, 3), (1, 2, 3, 3), (1, None, 1, None), (None, None, 4, 4), (None, 2, 5, 5)])
def test_three_way(spark, b, l, r, expected):  # noqa: E741
    side = lambda v: spark.createDataFrame([(7, v)] if v is not None else [], "k int, v int")
    got = [x.v for x in reconcile.three_way(side(b), side(l), side(r), "k", "v", F.greatest).collect()]
    assert got == ([] if expected is None else [expected])


def test_three_way_keeps_null_values_apart_from_missing_rows(spark):
    s = lambda rows: spark.createDataFrame(rows, "k int, v int")
    got = {r.k: r.v for r in reconcile.three_way(s([(1, None)]), s([(1, None)]), s([(1, 5), (2, None)]), "k", "v", F.greatest).collect()}
    assert got == {1: 5, 2: None}


def test_pending_conflict(spark):
    rows = spark.createDataFrame([("a", 5, 1, 10, "old"), ("a", 6, 3, 4, "new"), ("b", 1, 1, 1, "b")], "k string, at int, attempts int, queued int, v string")
    got = reconcile.merge_pending(rows, "k", [F.col("at")], ["attempts"], ["queued"], ["v"]).collect()
    assert sorted(map(tuple, got)) == [("a", "new", 3, 4), ("b", "b", 1, 1)]


def test_rules(spark):
    rows = spark.createDataFrame([(1, True, None), (2, False, 3), (3, None, None)], "n int, closed boolean, pay int")
    out = rules.decide(rows, [rules.Rule("closed", rules.REJECT, F.col("closed")), rules.Rule("pay", rules.REVIEW, F.col("pay").isNull()), rules.Rule("pay", rules.GAP, F.col("pay").isNull())], [rules.Score(F.lit(5), F.col("pay") > 2)])
    got = {r.n: (r.tier, r.score, r.confidence, r.reasons, r.gaps) for r in out.collect()}
    assert got == {1: ("rejected", 0, "limited", ["closed"], ["pay", "pay"]), 2: ("qualified", 5, "high", [], []), 3: ("review", 0, "limited", [], ["pay", "pay"])}
    halves = spark.createDataFrame([(1, 16), (3, 16), (0, 0)], "a int, b int").select(rules.share_score(F.col("a"), F.col("b"), 40).alias("s"))
    assert [r.s for r in halves.collect()] == [2, 8, 0]  # half to even


def test_quota_admission(spark):
    start = datetime(2026, 1, 1)
    rng = random.Random(1)
    rows = [(k, start + timedelta(hours=h), h) for k in ("a", "b", None) for h in sorted(rng.sample(range(0, 900), 60))]
    got = {(r.k, r.h): r.denial for r in state.admitted(spark.createDataFrame(rows, "k string, t timestamp, h int"), "k", "t", 10, 20, 8 * 3600).collect()}
    for k in ("a", "b", None):
        held = []
        for h in sorted(h for x, _, h in rows if x == k):
            held = [x for x in held if h - x < 480]
            expected = "rolling_exhausted" if len(held) >= 10 else "minimum_interval" if held and h - held[-1] < 8 else None
            assert got[k, h] == expected
            if expected is None:
                held.append(h)


def test_gates(spark):
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([(1, datetime(2026, 1, 9, 23)), (2, datetime(2026, 1, 9)), (3, datetime(2026, 1, 11)), (4, None)], "n int, t timestamp")
    assert [r.d for r in rows.select(state.due(F.col("t"), now, 86400).alias("d")).collect()] == [False, True, True, True]
    assert [r.d for r in rows.select(state.fresh(F.col("t"), now, 86400).alias("d")).collect()] == [True, False, False, False]
    assert [r.h for r in rows.select(state.look_back(F.col("t"), now, 12).alias("h")).collect()] == [25, 48, 12, 12]
    assert [r.w for r in spark.range(0, 12, 4).select(state.back_off(F.col("id")).alias("w")).collect()] == [300, 4800, 76800]
    step = lambda *a: spark.range(1).select(*state.aimd(*[F.lit(x) for x in a], 4, 24, 2.0, 60.0)).first()
    assert tuple(step(16, 2.0, 16, 16, False, 3)) == (20, 2.0) and tuple(step(16, 40.0, 5, 2, True, 3)) == (8, 60.0) and tuple(step(16, 4.0, 5, 5, False, 3)) == (16, 3.5)


def test_fair_shares_rotation_and_runs(spark):
    assert ranking.fair_shares(10, 4) == [2, 2, 3, 3] and ranking.fair_shares(1, 3) == [1, 1, 1] and ranking.fair_shares(0, 0) == []
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate("xxoxxxo")], "k string, i int, s string")
    got = [r.run for r in ranking.failure_runs(rows, "k", ["i"], F.col("s") == "x").orderBy("i").collect()]
    assert got == [1, 2, 0, 1, 2, 3, 0]


def test_numbered_equals_row_number_with_a_hot_key(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {r.i: r.place for r in ranking.numbered(df, "k", [F.col("v").desc(), F.col("i")], "place").collect()}
    for k in ("hot", "a", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))
        assert [got[r[1]] for r in mine] == list(range(1, len(mine) + 1))


def test_payload_lists_keep_the_first_place_of_each_value(spark):
    rows = spark.createDataFrame([("a", 2, "t", ["x", "y"]), ("a", 1, "tt", ["y", "z", "y"]), ("b", 3, None, None)], "k string, n long, t string, u array<string>")
    got = {r.k: (r.n, r.first_row, r.t, r.u) for r in identity.merge_payload(rows, "k", "n", "t", F.lit(0), [], ["u"]).collect()}
    assert got == {"a": (2, 1, "tt", ["y", "z", "x"]), "b": (1, 3, None, [])}
