"""Runs over sources: searches page by page, look-ups with a fall-back, bounded requests.

Plans are configuration-sized and requests cost seconds, so these loops run where the requests are
made; what they return are rows and outcomes for DataFrames. Every request goes through a function
that is passed in, and so does the clock; nothing here opens a connection.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

from tidemark.sources.listing import classify

#: Outcomes after which a source is left alone for a while, and those that say the item is gone.
TROUBLE = ("http_429", "blocked", "challenge", "timeout")
GONE = ("not_found", "closed")


class SourceError(RuntimeError):
    """A request that gave no usable answer."""

    def __init__(self, status: str, reason: str = "") -> None:
        super().__init__(f"{status}: {reason}")
        self.status, self.reason = status, reason


@dataclass
class Limits:
    """What a run may spend."""

    requests: int = 56
    seconds: float = 900.0
    pages: int = 3
    page_size: int = 25
    failures: int = 3
    reserve_seconds: float = 5.0


@dataclass
class Outcome:
    """One request: what was asked, how it went, what it brought."""

    query: str
    site: str
    status: str
    reason: str = ""
    raw: int = 0
    converted: int = 0
    invalid: int = 0
    seconds: float = 0.0
    page: int = 0


@dataclass
class Ledger:
    """Rows, outcomes, watermarks and notes of a run."""

    rows: list[dict] = field(default_factory=list)
    outcomes: list[Outcome] = field(default_factory=list)
    watermarks: dict[str, float] = field(default_factory=dict)
    notes: Counter = field(default_factory=Counter)


class Purse:
    """Requests and seconds that are left."""

    def __init__(self, limits: Limits, clock: Callable[[], float]) -> None:
        self.limits, self.clock, self.began, self.made = limits, clock, clock(), 0

    def seconds(self) -> float:
        return self.limits.seconds - (self.clock() - self.began)

    def open(self) -> bool:
        return self.made < self.limits.requests and self.seconds() >= self.limits.reserve_seconds


def search(
    plans: Iterable[tuple[str, str]], fetch: Callable[[str, str, int, float], list[dict]], convert: Callable[[dict], dict], identity: Callable[[dict], str], limits: Limits,
    clock: Callable[[], float], last_success: dict[str, float] | None = None, is_due: Callable[[str], bool] = lambda query: True,
) -> Ledger:
    """Run searches ``(query, site)``, the least recently successful first, within ``limits``.

    ``fetch(query, site, offset, seconds)`` returns one page or raises SourceError. A query stops at a
    short page or at one that shows nothing new; it moves its watermark only if all its pages were good.
    Rows that ``convert`` refuses are counted. A site with ``limits.failures`` failures in a row is skipped
    for the rest of the run; a page with a usable row sets it back.
    """
    out, purse, since = Ledger(), Purse(limits, clock), last_success or {}
    in_a_row: Counter = Counter()
    for query, site in sorted(plans, key=lambda p: since.get(p[0], float("-inf"))):
        if in_a_row[site] >= limits.failures:
            out.notes[f"{site}:paused"] += 1
            continue
        if not is_due(query):
            out.notes["not_due"] += 1
            continue
        seen: set[str] = set()
        complete = False
        for page in range(limits.pages):
            if not purse.open():
                out.notes["budget_exhausted"] += 1
                break
            purse.made += 1
            began = clock()
            one = Outcome(query, site, "success", page=page)
            out.outcomes.append(one)
            try:
                found = fetch(query, site, page * limits.page_size, purse.seconds())
            except SourceError as error:
                one.status, one.reason, one.seconds = error.status, error.reason, clock() - began
                in_a_row[site] += 1
                break
            rows = []
            for raw in found:
                try:
                    rows.append(convert(raw))
                except (KeyError, TypeError, ValueError):
                    one.invalid += 1
            fresh = {identity(r) for r in rows} - seen
            seen |= fresh
            one.raw, one.converted, one.seconds = len(found), len(rows), clock() - began
            one.status = "valid_empty" if not found else "partial" if one.invalid else "success"
            out.rows += rows
            in_a_row[site] = 0 if rows or not found else in_a_row[site] + 1
            if one.status == "partial":
                break
            complete = len(found) < limits.page_size or not fresh or page + 1 == limits.pages
            if complete:
                break
        if complete:
            out.watermarks[query] = clock()
        if not purse.open():
            break
    return out


def first_answer(variants: Sequence[str], backends: Sequence[str], ask: Callable[[str, str], list[dict]], budget: int, healthy: dict[str, float] | None = None, cooling: Iterable[str] = ()) -> tuple[list[dict], list[Outcome]]:
    """Rows of the first backend and query variant that answer, and the outcome of each request.

    Backends that worked last come first; those in ``cooling`` are left out; at most ``budget`` requests.
    No rows and a ``valid_empty`` outcome mean that a backend found nothing; no rows and none mean that nobody answered.
    """
    outcomes: list[Outcome] = []
    order = sorted((b for b in backends if b not in set(cooling)), key=lambda b: -(healthy or {}).get(b, float("-inf")))
    for backend, variant in ((b, v) for b in order for v in dict.fromkeys(variants)):
        if len(outcomes) >= budget:
            break
        try:
            rows = ask(variant, backend)
        except SourceError as error:
            outcomes.append(Outcome(variant, backend, error.status, error.reason))
            continue
        outcomes.append(Outcome(variant, backend, "success" if rows else "valid_empty", raw=len(rows)))
        if rows:
            return rows, outcomes
    return [], outcomes


def enrich(
    cards: Iterable[dict], cached: Callable[[dict], dict | None], services: Sequence[tuple[str, Callable[[dict], dict]]], limits: Limits, clock: Callable[[], float], paused: Iterable[str] = (),
) -> tuple[dict[str, dict], list[Outcome], set[str]]:
    """Details of cards: from the cache, else from the first service that has them.

    Returns details by ``key``, one outcome per request, and the services to leave alone next time: those
    that were in trouble, or failed ``limits.failures`` times in a row. Services share the requests and seconds
    of ``limits``. An item that a service reports gone isn't a failure of the service.
    """
    found: dict[str, dict] = {}
    outcomes: list[Outcome] = []
    off, in_a_row, purse = set(paused), Counter(), Purse(limits, clock)
    waiting = []
    for card in cards:
        hit = cached(card)
        if hit is not None:
            found[card["key"]] = hit
            outcomes.append(Outcome(card["key"], "cache", "success", converted=1))
        else:
            waiting.append(card)
    for card in waiting:
        for name, fetch in services:
            if name in off:
                continue
            if not purse.open():
                return found, outcomes, off - set(paused)
            purse.made += 1
            began = clock()
            one = Outcome(card["key"], name, "success")
            outcomes.append(one)
            try:
                found[card["key"]] = fetch(card)
                one.converted, in_a_row[name] = 1, 0
            except SourceError as error:
                one.status, one.reason = error.status, error.reason
                in_a_row[name] = 0 if error.status in GONE else in_a_row[name] + 1
                if error.status in TROUBLE or in_a_row[name] >= limits.failures:
                    off.add(name)
            one.seconds = clock() - began
            if one.converted:
                break
    return found, outcomes, off - set(paused)


@dataclass
class Response:
    """What a transport returns."""

    status: int
    text: str = ""
    location: str = ""
    retry_after: float | None = None


def bounded_get(url: str, domains: Sequence[str], get: Callable[[str], Response], wait: Callable[[float], None], attempts: int = 2, hops: int = 4, most: int = 5_000_000, patience: float = 10.0) -> str:
    """The text of a page, through at most ``hops`` redirects that stay on ``domains``; SourceError otherwise.

    429 and 5xx are tried again ``attempts`` times in all, after what the server asks for; a wait beyond
    ``patience`` means blocked. Texts above ``most`` characters and challenge pages are refused.
    """
    for _ in range(hops):
        host = (urlsplit(url).hostname or "").lower()
        if urlsplit(url).scheme not in ("http", "https") or not any(host == d or host.endswith("." + d) for d in domains):
            raise SourceError("blocked", "host_not_allowed")
        for left in reversed(range(attempts)):
            answer = get(url)
            if not left or not (answer.status == 429 or answer.status >= 500):
                break
            if (answer.retry_after or 0) > patience:
                raise SourceError("blocked", "wait_too_long")
            wait(1.0 if answer.retry_after is None else max(0.0, answer.retry_after))
        if answer.status in (301, 302, 303, 307, 308):
            url = urljoin(url, answer.location)
            continue
        kind = classify(answer.status, answer.text)
        if kind != "success":
            raise SourceError("closed" if answer.status in (404, 410) else kind, f"http_{answer.status}")
        if len(answer.text) > most:
            raise SourceError("parse_failed", "too_large")
        return answer.text
    raise SourceError("blocked", "too_many_redirects")
