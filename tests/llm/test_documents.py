"""Token ids, packing and subjects."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm.packing import CAPACITY, dealt, packed, packing_report, plan, tier_of
from tidemark.llm import subjects as module
from tidemark.llm.subjects import found_subjects, repair, sentences
from tidemark.llm.tokens import VOCABULARY, encoder, token_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, company string, kind string"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


def documents(spark, texts):
    return spark.createDataFrame([(i + 1, t, None, None, None, None, None) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    path = VOCABULARY.replace(".tiktoken", ".json")
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@given(text=st.one_of(st.text(max_size=300), st.text("abeinorst 'é\n漢🔥09", max_size=300)))
@settings(max_examples=200, deadline=None)
def test_ids_equal_the_librarys(library, text):
    assert encoder().encode(text) == library(text)


def test_hard_pieces(library):
    for text in ("a" * 5000, "ab" * 2000, " " * 3000, "<|endoftext|>", "\x00\x01", "I'll 12345 ..."):
        assert encoder().encode(text) == library(text)


def test_a_full_memo_of_pairs_changes_nothing(library, monkeypatch):
    from tidemark.llm import tokens

    monkeypatch.setattr(tokens, "MOST_PAIRS", 3)
    text = "Letters are read daily; étage 漢字 and 12345 more."
    assert encoder().encode(text * 3) == library(text * 3) and len(encoder().fits) >= 1


@needs_vocabulary
def test_ids_query(spark):
    got = {r.doc_id: r.ids for r in token_ids(documents(spark, ["Hello world", "", None, "Hello world"])).collect()}
    assert got[1] == got[4] and len(got[1]) == 2 and got[2] == [] and got[3] == [] and token_ids(documents(spark, [])).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_is_a_packing(histogram):
    slots, containers = plan(histogram, 64)
    seen, load = {s: [] for s in histogram}, {}
    for size, first, copies, start, times, offset in slots:
        for c in range(times):
            for k in range(copies):
                seen[size].append(first + c * copies + k)
                load.setdefault(start + c, []).append((offset + k * size, size))
    assert all(sorted(seen[s]) == list(range(n)) for s, n in histogram.items()) and sorted(load) == list(range(containers))
    for places in load.values():
        places.sort()
        assert all(a + s <= b for (a, s), (b, _) in zip(places, places[1:])) and places[-1][0] + places[-1][1] <= 64
    total = sum(s * n for s, n in histogram.items())
    assert containers <= -(-total // 64) * 2


def test_containers_are_made_of_windows_of_their_tier():
    rng = random.Random(3)
    histogram = {rng.randrange(1, CAPACITY + 1): rng.randrange(1, 60) for _ in range(300)} | {rng.randrange(1, 200): 400 for _ in range(40)}
    slots, containers = plan(histogram)
    by: dict[int, list] = {}
    for size, _, copies, start, _, offset in slots:
        by.setdefault(start, []).append((offset, size, copies))
    loads = []
    for start, places in sorted(by.items()):
        places.sort()
        tier = tier_of(places[0][1])
        loads.append(sum(size * copies for _, size, copies in places))
        # no document of a longer tier
        assert all(tier_of(size) <= tier for _, size, _ in places)
    assert loads == sorted(loads, reverse=True) and len({tier_of(p[0][1]) for p in map(sorted, by.values())}) >= 3  # a tier may be used up in gaps
    assert sum(s * n for s, n in histogram.items()) / (containers * CAPACITY) > 0.99


def test_groups_get_the_same_number_and_nearly_the_same_load():
    load = np.sort(np.random.default_rng(1).integers(1, 2049, 64 * 40))[::-1]
    group = dealt(np.arange(64 * 40), 40)
    sums = np.bincount(group, load)
    assert set(np.bincount(group)) == {64} and np.abs(sums / sums.mean() - 1).max() < 0.01


def test_plan_refuses_and_tiers():
    with pytest.raises(ValueError):
        plan({65: 1}, 64)
    assert plan({}, 64) == ([], 0) and [tier_of(s) for s in (1, 256, 257, 1024, 1025, 2048)] == [256, 256, 512, 1024, 2048, 2048]


@needs_vocabulary
def test_packing_query(spark):
    rng = random.Random(6)
    texts = ["word " * rng.randrange(1, 900) for _ in range(120)] + ["word " * 5000, "", None, "  "]
    df = documents(spark, texts).selectExpr("*", "1 as size", "2 as salt", "3 as rank")
    rows = packed(df).collect()
    sizes: dict[int, int] = {}
    places: dict[int, list] = {}
    for r in rows:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.tokens
        places.setdefault(r.container, []).append((r.offset, r.tokens))
    assert sizes == {i + 1: len(encoder().encode(t)) for i, t in enumerate(texts) if t}
    assert all(len([r for r in rows if r.doc_id == d]) == -(-n // CAPACITY) for d, n in sizes.items())
    for p in places.values():
        p.sort()
        assert all(a + s <= b for (a, s), (b, _) in zip(p, p[1:])) and p[-1][0] + p[-1][1] <= CAPACITY
    report = packing_report(df).first()
    tiers = {r.tier: r for r in packing_report(df).collect()}
    assert sum(r.containers for t, r in tiers.items() if t) == report.containers and sum(r.tokens for t, r in tiers.items() if t) == report.tokens
    assert report.containers == len(places) <= 1.05 * report.least_containers + 1
    assert packed(documents(spark, [])).count() == 0 and packing_report(documents(spark, [])).first().containers == 0


def corpus(n, seed):
    rng = random.Random(seed)
    phrases = {s: [f"{s}{i} {s}thing{i}" for i in range(8)] for s in ("law", "sport", "data")}
    shapes = ["We care about {} here.", "Ask us for {}!", "You bring {} along.", "Each day starts with {}."]
    texts, subjects = [], []
    for _ in range(n):
        mine = rng.sample(list(phrases), rng.choice([0, 1, 1, 1, 2]))
        lines = [rng.choice(shapes).format(rng.choice(phrases[s])) for s in mine for _ in range(5)]
        other = rng.choice([s for s in phrases if s not in mine] or ["law"])
        lines.append(f"The house next door deals in {rng.choice(phrases[other])}.")
        lines += ["Pets are welcome.", "Letters are read daily."]
        rng.shuffle(lines)
        texts.append(rng.choice(["\n", " "]).join(lines))
        subjects.append(set(mine))
    return texts, subjects


def test_heldout_subjects(spark):
    texts, subjects = corpus(500, 1)
    labelled = [(i + 1, s) for i in range(0, 500, 3) for s in sorted(subjects[i])]
    labels = spark.createDataFrame(labelled, "doc_id long, subject string")
    df = documents(spark, texts + ["", None, "  ", "x " * 50000]).selectExpr("*", "1 as phrase", "2 as subject")
    got = {(r.doc_id, r.subject) for r in found_subjects(df, labels).collect()}
    known = {d for d, _ in labelled}
    expected = {(i + 1, s) for i, ss in enumerate(subjects) for s in ss if i + 1 not in known}
    got = {g for g in got if subjects[g[0] - 1] or g[0] not in known}
    hit = len(got & expected)
    assert hit / len(expected) > 0.97 and hit / len(got) > 0.9


def test_large_models_are_joined_with_the_same_result(spark, monkeypatch):
    texts, subjects = corpus(200, 4)
    labels = spark.createDataFrame([(i + 1, s) for i in range(0, 200, 3) for s in sorted(subjects[i])], "doc_id long, subject string")
    df = documents(spark, texts)
    small = {tuple(r) for r in found_subjects(df, labels).collect()}
    monkeypatch.setattr(module, "BROADCAST_ROWS", 3)
    assert {tuple(r) for r in found_subjects(df, labels).collect()} == small != set()


def test_rounds_end_when_no_label_moves(spark, monkeypatch):
    texts, subjects = corpus(300, 5)
    labels = spark.createDataFrame([(i + 1, s) for i in range(0, 300, 4) for s in sorted(subjects[i])], "doc_id long, subject string")
    marks = []
    passed_on = module._looked_up
    monkeypatch.setattr(module, "_looked_up", lambda *a: marks.append(passed_on(*a)) or marks[-1])
    settled = {tuple(r) for r in found_subjects(documents(spark, texts), labels).collect()}
    assert 2 <= len(marks) < module.ROUNDS and marks[-1][1] == marks[-2][1]
    monkeypatch.setattr(module, "ROUNDS", len(marks) + 2)
    assert {tuple(r) for r in found_subjects(documents(spark, texts), labels).collect()} == settled


def test_nothing_to_learn(spark):
    labels = spark.createDataFrame([], "doc_id long, subject string")
    assert found_subjects(documents(spark, ["a b c"]), labels).count() == 0
    assert found_subjects(documents(spark, []), spark.createDataFrame([(1, "law")], "doc_id long, subject string")).count() == 0


def test_repair_and_sentences():
    assert repair("expÃ©rience lâ€™Ã©quipe Â£") == "expérience l’équipe £" and repair("Ãhnlich") == "Ãhnlich"
    assert list(sentences("Eins zwei.\nDrei<br/>vier • fünf")) == [["eins", "zwei"], ["drei"], ["vier"], ["funf"]] and list(sentences("")) == []
