import pytest

from tidemark.sources.drivers import Limits, Response, SourceError, bounded_get, enrich, first_answer, search


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        self.now += 1
        return self.now


def run(pages, plans, limits=None, **more):
    def fetch(query, site, offset, _seconds):
        page = pages[query][offset // 2]
        if isinstance(page, Exception):
            raise page
        return page

    def convert(raw):
        return {"id": raw["id"]}

    return search(plans, fetch, convert, lambda r: r["id"], limits or Limits(page_size=2), Clock(), **more)


ROW = lambda *ids: [{"id": i} for i in ids]


def test_a_search_reads_pages_until_one_is_short_or_repeats():
    out = run({"a": [ROW(1, 2), ROW(3)], "b": [ROW(5, 6), ROW(5, 6), ROW(7)], "c": [[]]}, [("a", "s"), ("b", "s"), ("c", "s")])
    assert [(o.query, o.page, o.status) for o in out.outcomes] == [("a", 0, "success"), ("a", 1, "success"), ("b", 0, "success"), ("b", 1, "success"), ("c", 0, "valid_empty")]
    assert set(out.watermarks) == {"a", "b", "c"} and len(out.rows) == 7


def test_failures_keep_the_watermark_and_pause_the_site():
    bad = SourceError("blocked", "http_403")
    pages = {"a": [ROW(1, 2), bad], "b": [bad], "c": [bad], "d": [ROW(9)], "e": [[{"no": 1}, {"id": 1}]]}
    out = run(pages, [(q, "s") for q in "abcd"] + [("e", "t")])
    assert [o.status for o in out.outcomes] == ["success", "blocked", "blocked", "blocked", "partial"]
    assert out.watermarks == {} and out.notes["s:paused"] == 1 and out.outcomes[-1].invalid == 1


def test_oldest_first_within_the_budget():
    pages = {q: [ROW(q)] for q in "abc"}
    out = run(pages, [(q, "s") for q in "abc"], Limits(requests=2, page_size=2), last_success={"a": 9.0, "b": 3.0}, is_due=lambda q: True)
    assert [o.query for o in out.outcomes] == ["c", "b"]
    assert run(pages, [("a", "s")], is_due=lambda q: False).notes["not_due"] == 1
    assert run(pages, [("a", "s")], Limits(seconds=1, page_size=2)).outcomes == []


def test_first_answer_falls_back():
    asked = []

    def ask(variant, backend):
        asked.append((backend, variant))
        if backend == "x":
            raise SourceError("timeout")
        return [{"id": 1}] if variant == "short" else []

    rows, outcomes = first_answer(["long", "short", "long"], ["y", "x"], ask, 9, {"x": 5.0})
    assert rows and asked == [("x", "long"), ("x", "short"), ("y", "long"), ("y", "short")] and [o.status for o in outcomes] == ["timeout", "timeout", "valid_empty", "success"]
    assert first_answer(["a"], ["y"], ask, 0) == ([], []) and first_answer(["a"], ["y"], ask, 3, cooling=["y"]) == ([], [])


def test_enrichment_uses_cache_then_services_and_pauses():
    def primary(card):
        raise SourceError("closed" if card["key"] == "gone" else "blocked")

    cards = [{"key": k} for k in ("hit", "gone", "a", "b")]
    found, outcomes, off = enrich(cards, lambda c: {"t": 0} if c["key"] == "hit" else None, [("p", primary), ("f", lambda c: {"t": 1})], Limits(), Clock())
    assert found == {"hit": {"t": 0}, "gone": {"t": 1}, "a": {"t": 1}, "b": {"t": 1}} and off == {"p"}
    assert [(o.query, o.site, o.status) for o in outcomes] == [("hit", "cache", "success"), ("gone", "p", "closed"), ("gone", "f", "success"), ("a", "p", "blocked"), ("a", "f", "success"), ("b", "f", "success")]
    found, outcomes, off = enrich(cards, lambda c: None, [("p", primary)], Limits(requests=2), Clock(), paused=["p"])
    assert found == {} and outcomes == [] and off == set()
    assert len(enrich(cards, lambda c: None, [("f", lambda c: {})], Limits(requests=2), Clock())[0]) == 2


def test_bounded_get():
    waits = []
    get = lambda *answers: (lambda it: lambda url: next(it))(iter(answers))
    page = lambda *answers, **k: bounded_get("https://a.example/x", ["a.example"], get(*answers), waits.append, **k)
    assert page(Response(503, retry_after=2), Response(302, location="/y"), Response(200, "ok")) == "ok" and waits == [2]
    for status, answers, more in (
        ("blocked", [Response(302, location="https://b.example/")], {}), ("blocked", [Response(302, location="/")] * 4, {}), ("blocked", [Response(429, retry_after=60)], {}), ("http_5xx", [Response(500)] * 2, {}),
        ("closed", [Response(404)], {}), ("parse_failed", [Response(200, "x" * 9)], {"most": 5}), ("challenge", [Response(200, "Verify you are human")], {}), ("blocked", [Response(403)], {}),
    ):
        with pytest.raises(SourceError) as error:
            page(*answers, **more)
        assert error.value.status == status
